"""The history of documents laid out for look-ups: tables in buckets by what is asked for, sorted within them.

A question joins a bucketed table on exactly the columns that it is bucketed by, so that only the question is moved: timelines and
latest changes by document and lineage, changes by their ids, versions by document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of each table.
BUCKETS = 64
# Tables of the store, what each is bucketed by, and what it is sorted by after that.
LAYOUT = {"changes": (["path", "lineage"], ["version_date", "id"]), "keys": (["id"], []), "clauses": (["path", "lineage"], ["id"]), "versions": (["path"], ["version_date"])}


@dataclass(frozen=True)
class HistoryStore:
    """Tables of one history in the session's catalogue, ``<name>_<table>``, of so many buckets each."""

    spark: SparkSession
    name: str
    buckets: int = BUCKETS

    def table(self, table: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{table}")

    def _asked(self, table: str, asked: DataFrame) -> DataFrame:
        """Rows of a table that ``asked`` names by what it is bucketed by; the question is dealt as the table is."""
        by = LAYOUT[table][0]
        return self.table(table).join(asked.select(by).repartition(self.buckets, *by), by, "left_semi")

    def timelines(self, asked: DataFrame) -> DataFrame:
        """All changes of the lineages asked about (path, lineage)."""
        return self._asked("changes", asked)

    def latest(self) -> DataFrame:
        """The newest change of each lineage: path, lineage, id, version_date."""
        newest = F.max(F.struct("version_date", "id")).alias("n")
        return self.table("changes").groupBy("path", "lineage").agg(newest).select("path", "lineage", "n.id", "n.version_date")

    def changes(self, asked: DataFrame) -> DataFrame:
        """The changes that ``asked`` names by id."""
        return self._asked("keys", asked)

    def current(self, asked: DataFrame) -> DataFrame:
        """The current clauses of the lineages asked about (path, lineage)."""
        return self._asked("clauses", asked)

    def versions(self, asked: DataFrame) -> DataFrame:
        """The versions of the documents asked about (path)."""
        return self._asked("versions", asked)


def write_store(changes: DataFrame, clauses: DataFrame, name: str, folder: str, buckets: int = BUCKETS) -> HistoryStore:
    """Write ``changes`` (path, lineage, id, version_date and more) and ``clauses`` (path, lineage, id and more) as a :class:`HistoryStore`, in place of one of that name.

    Each bucket is one file. Rows whose path or lineage is null are kept, but found by id alone, as no question can name them.
    """
    versions = changes.groupBy("path", "version_date").agg(F.count("*").alias("changed"))
    for table, rows in {"changes": changes, "keys": changes, "clauses": clauses, "versions": versions}.items():
        by, order = LAYOUT[table]
        dealt = rows.repartition(buckets, *by).write.mode("overwrite").bucketBy(buckets, *by).sortBy(*by, *order)
        dealt.option("path", f"{folder.rstrip('/')}/{table}").saveAsTable(f"{name}_{table}")
    return HistoryStore(changes.sparkSession, name, buckets)
