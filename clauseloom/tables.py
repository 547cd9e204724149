"""Input tables, and the shared shapes that queries derive from them."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Whether Spark deletes a query's shuffle files when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the folder that the session names; where it names none, to a temporary one, if it runs on this machine alone."""
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="clauseloom-"))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once beside the checkpoints, and read from there: what came before is not worked out again, also where an executor is lost. Shuffle files of the write go when it has ended."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a table of :func:`stored` whose last reader has been written itself."""
    spark = table.sparkSession
    for folder in {name.rpartition("/")[0] for name in table.inputFiles()}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def document_lines(docs: DataFrame) -> DataFrame:
    """One row for each line: doc_id, source, lang, idx (from 0), line. A null text has no lines."""
    return docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("idx", "line"))


#: DuckDB forms of :func:`document_lines` and of the version chain, as common table expressions.
LINES_SQL = """lines as (select doc_id, source, lang, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as idx from documents)"""
CHAIN_SQL = (
    LINES_SQL
    + """, chain as (
select doc_id, 1 as version_seq, idx, line from lines
union all select doc_id, 2, idx, line from lines where idx % 5 <> 3
union all select doc_id, v, idx, case when idx % 7 = 2 then line || ' (rev)' else line end from lines, (values (3), (4)) t(v) where idx % 5 <> 3)"""
)


def version_chain(docs: DataFrame, of: Callable[[Column], Column] | None = None) -> DataFrame:
    """Four versions of each document, as rows of clauses: doc_id, version_seq, idx, line, or in its place what ``of`` makes of it, worked out once for each text of a line.

    The second leaves out every fifth line, the third revises every seventh, the fourth is the third again.
    """
    of = of or (lambda line: line)
    kept, other = F.col("idx") % 5 != 3, F.col("idx") % 7 == 2
    lines = document_lines(docs).withColumn("text", of(F.col("line")))
    lines = lines.withColumn("revised", F.when(other, of(F.concat("line", F.lit(" (rev)")))).otherwise(F.col("text")))
    versions = F.filter(
        F.array(
            F.struct(F.lit(1).alias("version_seq"), F.col("text"), F.lit(True).alias("kept")),
            F.struct(F.lit(2).alias("version_seq"), F.col("text"), kept.alias("kept")),
            *(F.struct(F.lit(v).alias("version_seq"), F.col("revised").alias("text"), kept.alias("kept")) for v in (3, 4)),
        ),
        lambda v: v["kept"],
    )
    each = lines.select("doc_id", "idx", F.explode(versions).alias("v"))
    return each.select("doc_id", F.col("v.version_seq").alias("version_seq"), "idx", F.col("v.text").alias("line"))
