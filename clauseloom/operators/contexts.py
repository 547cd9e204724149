"""Evidence as a language model reads it: blocks of clauses, histories, changes, versions and statutes, and the note of what is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import law_display
from .changes import head_and_tail

# Words for kinds of changes, characters of parts, how many versions are listed, what stands between blocks, and the note.
CHANGE_WORDS = {"added": "추가", "removed": "삭제", "modified": "수정"}
RELATED_CHARS, ITEM_CHARS, VERSIONS_SHOWN, BETWEEN = 1500, 1500, 30, "\n\n---\n\n"
NOTE = "이 조항은 최신이 아닐 수 있습니다."
HEAD, TAIL = 2, 6


def change_word(change_type: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in CHANGE_WORDS.items() for x in pair))[change_type]


def _effective(effective: Column, day: Column) -> Column:
    return F.when(effective.isNotNull() & (effective != day), F.concat(F.lit(", 시행 "), effective.cast("string"))).otherwise("")


def clause_blocks(clauses: DataFrame) -> DataFrame:
    """Block of each clause (question, tag, label, clause_id, title, version_date, text, also_in, related): what it is, what says the same, its text, and the articles it refers to.

    ``also_in``: array of names; ``related``: array of (clause_id, title, text).
    """
    same = F.when(F.size("also_in") > 0, F.concat(F.lit(" · 같은 내용: "), F.array_join("also_in", ", "))).otherwise("")
    head = F.concat(F.lit("["), "tag", F.lit("] "), "label", F.lit(" "), "clause_id", F.lit(" "), "title", F.lit(" (수집본 "), F.col("version_date").cast("string"), F.lit(" 버전)"), F.coalesce(same, F.lit("")))
    more = F.transform(F.coalesce("related", F.array().cast(clauses.schema["related"].dataType)), lambda r: F.concat(F.lit("\n\n(참조 "), r["clause_id"], F.lit(" "), r["title"], F.lit(")\n"), F.substring(r["text"], 1, RELATED_CHARS)))
    return clauses.select("question", "tag", F.concat(head, F.lit("\n"), "text", F.array_join(more, "")).alias("block"))


def timeline_blocks(histories: DataFrame, newest_first: bool = False) -> DataFrame:
    """Block of each history (question, tag, label, total, matched, period, id, version_date, effective_date, change_type, clause_id, body: a row for each change).

    Of a long history the oldest ``HEAD`` and newest ``TAIL`` changes are shown, with how many stand between. ``period``: the time asked for, null where there is none;
    ``matched``: whether the changes lie in it.
    """
    own = ["question", "tag"]
    counted = histories.withColumn("__key", F.concat_ws("\x01", *own)).withColumn("__n", F.count("*").over(Window.partitionBy(*own)))
    shown = head_and_tail(counted, "__key", ["version_date", "id"], HEAD, TAIL)
    nth = F.row_number().over(Window.partitionBy(*own).orderBy("version_date", "id"))
    item = F.concat(F.lit("· "), F.col("version_date").cast("string"), F.lit(" 개정 ("), change_word(F.col("change_type")), _effective(F.col("effective_date"), F.col("version_date")), F.lit(") ["), "clause_id", F.lit("]\n"), "body")
    rows = shown.withColumn("nth", nth).groupBy(*own, "label", "total", "matched", "period", "__n").agg(F.array_sort(F.collect_list(F.struct("nth", item.alias("item")))).alias("items"))
    items = F.transform("items", lambda i: i["item"])
    left = F.col("__n") - F.size("items")
    gap = F.array(F.concat(F.lit("(중간 변경 "), left.cast("string"), F.lit("건 생략)")))
    whole = F.when(left > 0, F.concat(F.slice(items, 1, HEAD), gap, F.slice(items, HEAD + 1, TAIL))).otherwise(items)
    note = F.concat(
        F.lit("전체 "), F.col("total").cast("string"), F.lit("건"),
        F.when(F.col("period").isNull(), "").when(F.col("matched"), F.concat(F.lit(", 질문한 기간("), "period", F.lit(") 해당 "), F.col("__n").cast("string"), F.lit("건"))).otherwise(F.concat(F.lit(", 질문한 기간("), "period", F.lit(")에는 변경 없음 → 전체 표시"))),
    )
    head = F.concat(F.lit("["), "tag", F.lit("] "), "label", F.lit(" — 변경 이력 ("), note, F.lit(")"))
    return rows.select(*own, F.array_join(F.concat(F.array(head), F.reverse(whole) if newest_first else whole), "\n").alias("block"))


def version_blocks(versions: DataFrame, newest_first: bool = False) -> DataFrame:
    """Block of each document's versions (question, tag, title, path, version_date, effective_date, changed: a row for each version): the last ``VERSIONS_SHOWN`` of them, the very first as such."""
    own = ["question", "tag"]
    order = Window.partitionBy(*own).orderBy("version_date")
    ranked = versions.withColumn("nth", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy(*own)))
    what = F.when(F.col("nth") == 1, "최초 수집").otherwise(F.concat(F.lit("조항 "), F.col("changed").cast("string"), F.lit("개 변경")))
    line = F.concat(F.lit("· "), F.col("version_date").cast("string"), F.lit(" ("), what, _effective(F.col("effective_date"), F.col("version_date")), F.lit(")"))
    last = F.when(F.col("nth") > F.col("n") - VERSIONS_SHOWN, F.struct("nth", line.alias("line")))
    rows = ranked.groupBy(*own, "title", "path", "n").agg(F.min("version_date").alias("a"), F.max("version_date").alias("b"), F.array_sort(F.collect_list(last)).alias("lines"))
    head = F.concat(
        F.lit("["), "tag", F.lit("] "), F.coalesce("title", "path"), F.lit(" ("), "path", F.lit(") 개정 이력: 버전 "), F.col("n").cast("string"), F.lit("개, 최초 "), F.col("a").cast("string"), F.lit(", 마지막 수집본 "), F.col("b").cast("string")
    )
    lines = F.transform("lines", lambda x: x["line"])
    return rows.select(*own, F.array_join(F.concat(F.array(head), F.reverse(lines) if newest_first else lines), "\n").alias("block"))


def law_blocks(laws: DataFrame) -> DataFrame:
    """Block of each statute article (question, tag, law, category, article, as_of, effective, cited_by, by_title, text); as_of is null for the law of today."""
    basis = F.when(F.col("as_of").isNull(), "현행").otherwise(F.concat(F.lit("약관 버전 "), F.col("as_of").cast("string"), F.lit(" 당시")))
    head = F.concat(F.lit("["), "tag", F.lit("] 법령 "), law_display(F.col("law"), F.col("category")), F.lit(" "), "article", F.lit(" ("), basis, F.lit(" 시행 중인 판, 시행 "), F.coalesce(F.col("effective").cast("string"), F.lit("미상")), F.lit(")"))
    by = F.when(F.size("cited_by") > 0, F.concat(F.lit("(인용한 약관: "), F.array_join("cited_by", ", "), F.lit(")\n"))).otherwise("")
    how = F.when(F.col("by_title"), "(주의: 약관은 법령 이름만 들었고, 이 조문은 제목이 인용 문맥과 맞아 찾은 것이다)\n").otherwise("")
    return laws.select("question", "tag", F.concat(head, F.lit("\n"), by, how, "text").alias("block"))


def contexts(blocks: list[DataFrame]) -> DataFrame:
    """The context of each question: its blocks in order of kind and number of their tags."""
    whole = blocks[0]
    for more in blocks[1:]:
        whole = whole.unionByName(more)
    place = F.struct(F.instr(F.lit("CTHDL"), F.left("tag", F.lit(1))).alias("kind"), F.substring("tag", 2, 9).cast("int").alias("n"), F.col("block").alias("block"))
    return whole.groupBy("question").agg(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda b: b["block"]), BETWEEN).alias("context"))


def version_notes(cited: DataFrame, latest: DataFrame) -> DataFrame:
    """What each answer is to say of the versions it knows: question and note.

    ``cited``: question, tag, place, path, name, version_date (text); statutes (tags L) do not count. The date is that of ``latest`` (path, latest_version), else, of clauses and
    lists of versions alone, the evidence's own.
    """
    kind = F.left("tag", F.lit(1))
    rows = cited.where(kind != "L").join(latest, "path", "left")
    day = F.coalesce(F.col("latest_version").cast("string"), F.when(kind.isin("C", "D"), F.col("version_date").cast("string")))
    each = rows.groupBy("question", "path").agg(F.min("place").alias("place"), F.min_by("name", "place").alias("name"), F.min_by(day, F.struct(day.isNull(), "place")).alias("day"))
    item = F.when(F.col("day").isNull(), F.col("name")).otherwise(F.concat("name", F.lit(" "), "day", F.lit(" 버전")))
    found = each.groupBy("question").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", item.alias("item")))), lambda s: s["item"]).alias("items"))
    one = F.concat(F.lit("※ 현재 제가 알고 있는 버전은 "), F.col("items")[0], F.lit("입니다. " + NOTE))
    several = F.concat(F.lit("※ 현재 제가 알고 있는 버전은 다음과 같습니다. 이 조항들은 최신이 아닐 수 있습니다.\n"), F.array_join(F.transform("items", lambda i: F.concat(F.lit("· "), i)), "\n"))
    return found.select("question", F.when(F.size("items") == 1, one).otherwise(several).alias("note"))


def with_note(answer: Column, note: Column) -> Column:
    """An answer with its note behind it; as it is where there is none."""
    return F.when(note.isNull(), answer).otherwise(F.concat(F.regexp_replace(answer, r"(?U)\s+$", ""), F.lit("\n\n"), note))


def used_tags(answer: Column) -> Column:
    """Tags of the evidence that an answer cites, once each, in order."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[([CTHDL]\d+)\]"), F.lit(1)))
