"""Versions that arrive over time: gate, score cache and index kept up as they come."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import content_hash
from ..operators import index_table, indexing


def changed_only(versions: DataFrame, path: str = "path", seq: str = "version_seq", body: str = "body") -> DataFrame:
    """Versions of a stream that differ from the one before them in their document: path, seq, body_hash, nth.

    The state of a document is its last sequence number, hash and count. Versions of one batch are
    taken in order; one that comes after a later one is left out.
    """
    hashed = versions.select(F.col(path).alias("path"), F.col(seq).cast("long").alias("seq"), content_hash(F.col(body)).alias("body_hash"))

    def gate(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, digest, nth = state.get if state.exists else (-1, "", 0)
        rows = []
        for version, own in sorted((v, h) for frame in frames for v, h in zip(frame["seq"], frame["body_hash"])):
            if version <= last:
                continue
            if own != digest:
                nth += 1
                rows.append((key[0], version, own, nth))
            last, digest = int(version), own
        state.update((last, digest, nth))
        yield pd.DataFrame(rows, columns=["path", "seq", "body_hash", "nth"])

    kind = versions.schema[path].dataType.simpleString()
    return hashed.groupBy("path").applyInPandasWithState(gate, f"path {kind}, seq long, body_hash string, nth int", "seq long, body_hash string, nth int", "append", GroupStateTimeout.NoTimeout)


def keep_scored(units: DataFrame, score: Callable[[DataFrame], DataFrame], cache: str, checkpoint: str) -> StreamingQuery:
    """Score the units (key, text) of a stream that the table at ``cache`` lacks, and append them; a batch that runs again adds nothing twice."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["key"])
        try:
            fresh = fresh.join(spark.read.parquet(cache).select("key"), "key", "left_anti")
        except Exception as error:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(error):
                raise
        score(fresh).write.mode("append").parquet(cache)

    return units.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_index(entries: DataFrame, path: str, embedder: indexing.Embedder, checkpoint: str) -> StreamingQuery:
    """Keep an index up with a stream of entries (id, seq, deleted, embed, embed_hash, text, metadata): the last of each id counts, deleted ones go.

    A batch is one step of :func:`clauseloom.operators.indexing.apply_changes`: it reads and writes its own entries alone, those whose text stayed keep
    their vectors, and one that runs again after a failure changes nothing more. Now and then the index is compacted.
    """

    def step(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("id").agg(F.max_by(F.struct("deleted", "embed", "embed_hash", "text", "metadata"), "seq").alias("e")).select("id", "e.*")
        indexing.apply_changes(batch.sparkSession, last, path, number, embedder)
        index_table.compact(index_table.Table(batch.sparkSession, path))

    return entries.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
