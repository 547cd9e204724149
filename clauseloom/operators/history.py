"""The history of documents as tables, and the questions that are asked of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import article_of
from ..sources.frontmatter import company
from .entries import change_entries


def build(records: DataFrame, current: DataFrame, cards: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables documents, versions, changes, unit_changes and clauses of a scan's records and its current clauses; ``cards`` (path, title and more) say what documents are.

    A version counts its changes, the initial one none. Changes get ids of path, clause, date and kind; a clause's history also goes by its article.
    """
    changed = F.col("change_type") != "initial"
    versions = records.groupBy("path", "seq", "version_date").agg(F.count(F.when(changed, 1)).alias("changed"))
    documents = versions.groupBy("path").agg(F.count("*").alias("versions"), F.min("version_date").alias("first_version"), F.max("version_date").alias("latest_version"))
    documents = documents.withColumn("company", company(F.col("path")))
    documents = documents if cards is None else documents.join(cards, "path", "left")
    named = change_entries(records, "path", "clause_id", "version_date", "change_type", "seq")
    changes = named.withColumn("article", article_of(F.col("clause_id"))).withColumn("company", company(F.col("path")))
    units = changes.select(F.col("id").alias("change_id"), F.explode("unit_changes").alias("u")).select("change_id", "u.*")
    clauses = current.withColumn("id", F.concat_ws("::", "path", "clause_id")).withColumn("company", company(F.col("path")))
    return {"documents": documents, "versions": versions, "changes": changes.drop("unit_changes"), "unit_changes": units, "clauses": clauses}


def stats(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name and n of each table."""
    each = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, rows in tables.items()]
    out = each[0]
    for one in each[1:]:
        out = out.unionByName(one)
    return out


def by_key(rows: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Rows that ``asked`` names; what does not exist is left out."""
    return rows.join(asked.select(key).distinct(), key, "left_semi")


def versions_of(changes: DataFrame) -> DataFrame:
    """For each path and date, how many changes and how many additions there were."""
    return changes.groupBy("path", "version_date").agg(F.count("*").alias("changed"), F.count(F.when(F.col("change_type") == "added", 1)).alias("added"))


def last_versions(versions: DataFrame, most: int = 30) -> DataFrame:
    """The last ``most`` dates of each path; back counts from the newest."""
    back = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("version_date")))
    return versions.select("path", "version_date").distinct().withColumn("back", back.cast("long")).where(F.col("back") <= most)


def timeline(changes: DataFrame, by: list[str], order: list[str], inside: Column) -> DataFrame:
    """Each history's changes that are ``inside`` a period, or all of a history that has none there: adds place and date_matched."""
    marked = changes.withColumn("inside", inside)
    some = F.max(F.col("inside").cast("int")).over(Window.partitionBy(*by))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    shown = marked.withColumn("some", some).where("inside or some = 0")
    return shown.withColumn("place", place).withColumn("date_matched", F.col("some") == 1).drop("inside", "some")


def timeline_of(changes: DataFrame, clauses: DataFrame, asked: DataFrame) -> DataFrame:
    """Changes of the clauses that are asked about (path, clause_id, and lineage where it is known): of their lineage; of their article where they have no current clause to tell it."""
    known = clauses.select("path", "clause_id", F.col("lineage").alias("held"))
    named = asked.join(known, ["path", "clause_id"], "left").withColumn("lin", F.coalesce("lineage", "held"))
    own = named.where("lin is not null").select("path", F.col("clause_id").alias("asked"), F.col("lin").alias("lineage"))
    rest = named.where("lin is null").select("path", F.col("clause_id").alias("asked"), article_of(F.col("clause_id")).alias("article"))
    return changes.join(own, ["path", "lineage"]).unionByName(changes.join(rest, ["path", "article"]))


def changes_between(changes: DataFrame, first: str | None = None, last: str | None = None, month_day: str | None = None, companies: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Changes of a period, of a month or day of any year, of companies or of one document; each condition only where it is given. No companies at all give no changes."""
    day, out = F.col("version_date"), F.lit(True)
    out = out & (day >= F.lit(first).cast("date")) if first else out
    out = out & (day <= F.lit(last).cast("date")) if last else out
    out = out & F.date_format(day, "MM-dd").startswith(month_day) if month_day else out
    out = out & (F.col("company").isin(*companies) if companies else F.lit(False)) if companies is not None else out
    return changes.where(out & (F.col("path") == path) if path else out)


def newest(changes: DataFrame, most: int) -> DataFrame:
    """The ``most`` newest changes, by id within a day: a report."""
    return changes.orderBy(F.desc("version_date"), "id").limit(most)


def latest_of(rows: DataFrame, by: list[str]) -> DataFrame:
    """The newest row's id and date of each lineage."""
    return rows.groupBy(*by).agg(F.max_by("id", F.struct("version_date", "id")).alias("id"), F.max("version_date").alias("version_date"))


def latest_clause(clauses: DataFrame, asked: DataFrame) -> DataFrame:
    """The current clause of each lineage asked about (path, lineage), the smallest id where it has several; lineages that ended give none."""
    held = clauses.join(asked.select("path", "lineage").where("lineage is not null").distinct(), ["path", "lineage"], "left_semi")
    first = F.row_number().over(Window.partitionBy("path", "lineage").orderBy("id"))
    return held.withColumn("__n", first).where("__n = 1").drop("__n")


def alerts(flagged: DataFrame, by: list[str], score: str, key: str = "id") -> DataFrame:
    """What became unfavourable on each day of each path: triggers (ids in order) and the lowest score."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")), ",")
    return flagged.where("flag = 'became'").groupBy(*by).agg(lines.alias("triggers"), F.min(score).alias("lowest"))


def flagged(facts: DataFrame, kind: str, score: str) -> DataFrame:
    """For each path how many changes were flagged so, the latest day, and the lowest score."""
    return facts.where(F.col("flag") == kind).groupBy("path").agg(F.count("*").alias("changes"), F.max("version_date").alias("latest"), F.min(score).alias("lowest"))


def alert_texts(records: DataFrame) -> DataFrame:
    """A Markdown section for each record that became unfavourable, newest first within a path: path, version_date, place and section."""
    triggers = F.filter("unit_changes", lambda u: u["flag"] == "became")
    signed = lambda x: F.format_string("%+.2f", x)
    cause = F.transform(triggers, lambda u: F.concat(F.lit("- cause: "), u["clause_id"], F.when(u["change_type"] == "added", " added, score ").otherwise(F.concat(F.lit(" score "), signed(u["old_score"]), F.lit(" → "))), signed(u["favor_score"])))
    quoted = F.substring(F.replace(F.array_join(F.transform(triggers, lambda u: u["text"]), "\n\n"), F.lit("\n"), F.lit("\n> ")), 1, 800)
    head = F.concat(F.lit("## "), "clause_id", F.lit(" — "), F.when(F.col("change_type") == "added", "unfavourable clause added").otherwise("changed to the worse"))
    facts = F.concat(F.lit("- document: `"), "path", F.lit("` · version: "), F.col("version_date").cast("string"), F.coalesce(F.concat(F.lit(" · act until "), F.col("action_deadline").cast("string")), F.lit("")))
    score = F.concat(F.lit("- score: "), signed(F.col("favor_score")))
    place = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("version_date"), "clause_id")).cast("long")
    lines = F.concat(F.array(head, facts, score), cause, F.array(F.lit(""), F.concat(F.lit("> "), quoted)))
    return records.where("became_unfavorable").withColumn("place", place).select("path", "version_date", "place", F.array_join(lines, "\n").alias("section"))
