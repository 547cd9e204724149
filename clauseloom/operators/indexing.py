"""Vector indexes as tables: embedding by length, cached vectors, and upkeep as entries come and go."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import is_deletion
from .index_table import Table, change, rows_of

#: Texts of a batch, and limits of tokens that batches are padded to.
BATCH, BUCKETS = 32, (128, 256, 512, 768, 1024)

Embedder = Callable[[list[str]], list[list[float]]]


def embed(entries: DataFrame, text: str, embedder: Embedder, prompt: str = "", size: Callable[[str], int] = len, batch: int = BATCH, only: str | None = None) -> DataFrame:
    """``entries`` with vector. Texts go to ``embedder`` in batches of similar ``size``, each with ``prompt`` before it; queries take another prompt than documents do.

    An embedder is loaded in the tasks. A vector that is zero or not finite raises. With ``only``, a column, rows for which it is not true keep the vector that they have.
    """
    names = [c for c in entries.columns if c != "vector"]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [prompt + (t or "") for t in frame[text]]
            asked = range(len(texts)) if only is None else [n for n, on in enumerate(frame[only]) if on]
            order = sorted(asked, key=lambda n: (next((b for b in BUCKETS if b >= size(texts[n])), BUCKETS[-1]), n))
            vectors: list = [None] * len(texts) if only is None else list(frame["vector"])
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                for n, v in zip(chosen, embedder([texts[n] for n in chosen])):
                    if not any(v) or not all(abs(x) < float("inf") for x in v):
                        raise ValueError("an embedder gave a vector that is zero or not finite")
                    vectors[n] = list(map(float, v))
            yield frame.assign(vector=vectors)[[*names, "vector"]]

    kinds = ", ".join(f"`{c}` {entries.schema[c].dataType.simpleString()}" for c in names)
    return entries.mapInPandas(run, f"{kinds}, vector array<double>")


def cached_vectors(texts: DataFrame, cache: DataFrame, embedder: Embedder, model: str, text: str = "text", prompt: str = "") -> tuple[DataFrame, DataFrame]:
    """``texts`` with vector, each distinct text embedded once, and the rows (key, vector) that the cache lacked. A key tells models and prompts apart."""
    key = F.sha2(F.concat_ws(":", F.lit(model), F.lit(prompt), F.col(text)), 256)
    keyed = texts.withColumn("__key", key)
    missing = keyed.select(F.col("__key").alias("key"), F.col(text).alias("__text")).dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    fresh = embed(missing, "__text", embedder, prompt).select("key", "vector").checkpoint()
    known = cache.select("key", "vector").unionByName(fresh)
    return keyed.join(known.withColumnRenamed("key", "__key"), "__key").drop("__key"), fresh


_COLUMNS = ["id", "embed_hash", "text", "metadata", "vector"]


def read_index(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The index as it was after step ``number``, or is now: id, embed_hash, text, metadata (map) and vector."""
    found = rows_of(Table(spark, path), number)
    kinds = "id string, embed_hash string, text string, metadata map<string,string>, vector array<double>"
    return spark.createDataFrame([], kinds) if found is None else found.select(*_COLUMNS)


def upsert(spark: SparkSession, wanted: DataFrame, path: str, number: int, embedder: Embedder) -> DataFrame:
    """Bring the index at ``path`` to ``wanted`` (id, embed, embed_hash, text, metadata) as step ``number`` and return the counts of each action.

    Only texts whose hash is new are embedded; others keep their vectors and take the new metadata; entries that are no longer wanted go. Entries that
    stay as they are are not written. A step that has been made returns its counts and changes nothing; one that broke off runs anew.
    """
    return _step(spark, wanted.withColumn("deleted", F.lit(False)), True, path, number, embedder)


def apply_changes(spark: SparkSession, changes: DataFrame, path: str, number: int, embedder: Embedder) -> DataFrame:
    """As :func:`upsert`, of ``changes`` (its columns and deleted): entries of other ids stay, and only these are looked up and written."""
    return _step(spark, changes, False, path, number, embedder)


def _said() -> Column:
    """What an entry says besides what is embedded, as a digest."""
    return F.unhex(F.sha2(F.to_json(F.struct("text", F.array_sort(F.map_entries("metadata")).alias("metadata"))), 256))


def _step(spark: SparkSession, wanted: DataFrame, whole: bool, path: str, number: int, embedder: Embedder) -> DataFrame:
    """One pass: wanted entries meet what is held, are counted, embedded where they are new, and written where they differ."""
    table = Table(spark, path)
    if number not in table.versions():
        held = rows_of(table, max((n for n in table.versions() if n < number), default=-1))
        # a text that is embedded as it is moves once
        embedded = F.when(~F.col("embed").eqNullSafe(F.col("text")), F.struct("embed")).alias("embed")
        new = wanted.select("id", "deleted", embedded, "embed_hash", "text", "metadata")
        if held is None:
            met = new.withColumns({"old_hash": F.lit(None).cast("string"), "said": F.lit(None).cast("binary"), "vector": F.lit(None).cast("array<double>"), "held": F.lit(False)})
        else:
            old = held.select("id", F.col("embed_hash").alias("old_hash"), _said().alias("said"), "vector", F.lit(True).alias("held"))
            met = new.join(old, "id", "full_outer" if whole else "left")
        gone, was = F.coalesce("deleted", F.lit(True)), F.coalesce("held", F.lit(False))
        action = F.when(gone & was, "delete").when(~gone & ~was, "insert").when(~gone & ~F.col("embed_hash").eqNullSafe(F.col("old_hash")), "embed").when(~gone, "metadata")
        seen = Observation()
        acts = ("delete", "embed", "insert", "metadata")
        named = met.withColumn("action", action).observe(seen, *(F.count(F.when(F.col("action") == a, 1)).alias(a) for a in acts))
        fresh = F.col("action").isin("insert", "embed")
        rows = named.where(fresh | (F.col("action") == "delete") | ((F.col("action") == "metadata") & ~_said().eqNullSafe(F.col("said"))))
        kept = lambda c: F.when(F.col("action") != "delete", F.col(c)).alias(c)
        texts = F.when(F.col("embed").isNull(), F.col("text")).otherwise(F.col("embed.embed")).alias("embed")
        ready = rows.select("id", *map(kept, _COLUMNS[1:]), (F.col("action") == "delete").alias("deleted"), F.when(fresh, texts).alias("embed"), fresh.alias("fresh"))
        change(table, number, embed(ready, "embed", embedder, only="fresh").select(*_COLUMNS, "deleted"), lambda: {a: n for a, n in seen.get.items() if n})
    return spark.createDataFrame(sorted(table.manifest(number)["counts"].items()), "action string, ids long")


def fetch(index: DataFrame, groups: DataFrame, group: str = "group") -> DataFrame:
    """All entries of an index that belong to one of ``groups``."""
    return index.join(groups.select(group).distinct(), index["metadata"][group] == groups[group], "left_semi")


def case_entries(pairs: DataFrame, releases: DataFrame, chars: int = 2000) -> DataFrame:
    """Index entries of corrected cases: id (``doc#n`` in order), text, embed (its first ``chars``), embed_hash (of the whole) and metadata.

    ``pairs``: doc (``date_number``), nth, before, after and issue; ``releases``: number, title, target and field. A text after correction that says no more than that it was
    deleted is empty.
    """
    number = F.substring_index("doc", "_", -1)
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    named = pairs.withColumn("number", number).join(releases, "number", "left")
    text = trim(F.col("before"))
    after = F.when(is_deletion(trim(F.col("after"))), "").otherwise(trim(F.col("after")))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return named.select(
        F.concat_ws("#", "doc", F.col("nth").cast("string")).alias("id"), text.alias("text"), F.substring(text, 1, chars).alias("embed"), F.substring(F.sha2(text, 256), 1, 16).alias("embed_hash"),
        F.create_map(F.lit("date"), F.substring("doc", 1, 10), F.lit("number"), "number", F.lit("title"), blank("title"), F.lit("target"), blank("target"), F.lit("field"), blank("field"), F.lit("issue"), blank("issue"), F.lit("after"), after).alias("metadata"),
    )
