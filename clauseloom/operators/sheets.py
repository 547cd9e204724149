"""Sheets for people: changes to review, units to label, changes to ask questions about. Sampling goes by hashes, so a sheet can be made again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import article_of
from .views import changed_words

# Characters of a sheet's texts, of texts that can be labelled, and what makes a change worth a question.
SHEET_CHARS, LABEL_CHARS, SUBSTANTIVE_CHARS, SAME = 1500, (40, 1500), 80, 0.95
CURRENT_CHARS, CANDIDATE_CHARS, CANDIDATE_SAME = (80, 3000), 60, 0.97
KINDS = ("dated", "undated", "deleted", "renumbered", "doc")


def in_turn(rows: DataFrame, pool: list[str], key: list[str], most: int, order: list | None = None) -> DataFrame:
    """``most`` rows, pools in turn: adds turn (a row's place in its pool, by ``order`` or else by the hash of its key). No pool is sorted beyond ``most``."""
    within = order or [F.md5(F.concat_ws("#", *(F.col(k).cast("string") for k in key)))]
    turn = F.row_number().over(Window.partitionBy(*pool).orderBy(*within, *key)).cast("long")
    return rows.withColumn("turn", turn).where(F.col("turn") <= most).orderBy("turn", *pool).limit(most)


def review_rows(records: DataFrame) -> DataFrame:
    """``records`` (change_type, text, old_text) as a reviewer sees them: changed_words of modified ones, old_text and new_text cut to what a cell takes."""
    gone, modified = F.col("change_type") == "removed", F.col("change_type") == "modified"
    cut = lambda c: F.substring(c, 1, SHEET_CHARS)
    words = changed_words(F.when(modified, F.col("old_text")), F.when(modified, F.col("text")))
    old = F.coalesce(F.col("old_text"), F.when(gone, F.col("text")), F.lit(""))
    return records.withColumn("changed_words", F.when(modified, words).otherwise("")).withColumn("new_text", F.when(gone, "").otherwise(cut(F.col("text")))).withColumn("old_text", cut(old))


def drop_review(records: DataFrame, keys: list[str]) -> DataFrame:
    """Modified units that became unfavourable, the steepest drop first: ``keys``, clause_id, old_score, favor_score, score_delta, changed_words, old_text, new_text, place."""
    each = records.select(*keys, F.explode("unit_changes").alias("u")).where("u.flag = 'became' and u.change_type = 'modified'").select(*keys, "u.*")
    cut = lambda c: F.substring(c, 1, SHEET_CHARS)
    place = F.row_number().over(Window.partitionBy(*keys[:1]).orderBy("score_delta", *keys, "clause_id")).cast("long")
    rows = each.withColumn("changed_words", changed_words(F.col("old_text"), F.col("text"))).withColumn("place", place)
    return rows.select(*keys, "clause_id", "old_score", "favor_score", "score_delta", "changed_words", cut(F.col("old_text")).alias("old_text"), cut(F.col("text")).alias("new_text"), "place")


def label_sample(units: DataFrame, kind: str, key: list[str], text: str = "text", most: int = 50) -> DataFrame:
    """Units to label by hand, kinds of documents in turn, without scores: adds id from 1."""
    fit = units.where(F.length(text).between(*LABEL_CHARS))
    rows = in_turn(fit, [kind], key, most)
    order = Window.partitionBy(F.lit(1)).orderBy("turn", kind)  # at most ``most`` rows
    return rows.withColumn("id", F.row_number().over(order).cast("long"))


def is_substantive(change_type: Column, similarity: Column, text: Column) -> Column:
    """A change that someone may ask about: long enough, and if modified, not nearly the same."""
    long = F.length(text) >= SUBSTANTIVE_CHARS
    return F.when(change_type == "modified", long & (F.coalesce(similarity, F.lit(1.0)) < SAME)).otherwise(long)


def question_candidates(current: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clauses (text) and changes (change_type, similarity, text) that questions can be drawn from."""
    some = F.col("change_type").isin("added", "removed") | ((F.col("change_type") == "modified") & (F.coalesce("similarity", F.lit(1.0)) < CANDIDATE_SAME))
    return current.where(F.length("text").between(*CURRENT_CHARS)), changes.where(some & (F.length("text") >= CANDIDATE_CHARS))


def history_candidates(changes: DataFrame, current: DataFrame, versions: DataFrame) -> DataFrame:
    """What each kind of history question can be asked about: kind, path, lineage, id, version_date (one row for each kind and history or document).

    dated: any substantive addition or modification; undated: the last substantive change of a history with two or more; deleted: a substantive removal whose
    history has no current clause; renumbered: the last substantive change of a history whose article changed its number; doc: each
    document of three versions or more, with its last. ``changes``: path, lineage, id, version_date, clause_id, change_type, similarity, text; ``current``: path,
    lineage; ``versions``: path, version_date.
    """
    rows = changes.withColumn("good", is_substantive(F.col("change_type"), F.col("similarity"), F.col("text"))).withColumn("article", article_of(F.col("clause_id")))
    named = ["path", "lineage", "id", "version_date"]
    single = lambda kind, found: found.select(F.lit(kind).alias("kind"), *named)
    dated = single("dated", rows.where("good and change_type in ('modified', 'added')"))
    gone = single("deleted", rows.where("good and change_type = 'removed'").join(current.select("path", "lineage").distinct(), ["path", "lineage"], "left_anti"))
    last = F.max(F.when(F.col("good"), F.struct("version_date", "id")))
    each = rows.groupBy("path", "lineage").agg(F.count("*").alias("n"), F.countDistinct("article").alias("articles"), last.alias("last")).where("last is not null")
    each = each.select("path", "lineage", "n", "articles", "last.*")
    docs = versions.groupBy("path").agg(F.count("*").alias("n"), F.max("version_date").alias("version_date")).where("n >= 3").join(rows.select("path").distinct(), "path", "left_semi")
    docs = docs.select(F.lit("doc").alias("kind"), "path", F.lit(None).cast(changes.schema["lineage"].dataType).alias("lineage"), F.lit(None).cast(changes.schema["id"].dataType).alias("id"), "version_date")
    return dated.unionByName(single("undated", each.where("n >= 2"))).unionByName(gone).unionByName(single("renumbered", each.where("articles > 1"))).unionByName(docs)


def without_vague_pair(questions: DataFrame, key: str = "id", variant: str = "variant", source: str = "src_id", verdict: str = "verdict", accepted: str = "accepted") -> DataFrame:
    """Accepted questions in their first wording that no vague wording has been made of yet."""
    done = questions.where(F.col(variant) == "vague").select(F.col(source).alias(key)).distinct()
    return questions.where(F.col(variant).isNull() & (F.trim(verdict) == accepted)).join(done, key, "left_anti")
