"""Readable changes: lossless differences, folded and clipped views, and their text form."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_list, let
from .scoring import LIST_SKIP_CHARS

# What counts as one word; lines that differ by more characters are not compared by words; what stays of equal runs; limits of a view.
WORD = r"\s+|[가-힣]+|[A-Za-z]+|\d+|."
WORD_CHARS, CONTEXT, FOLD, VIEW_CHARS = 20_000, 120, 400, 30_000
TEXT_CONTEXT, TEXT_FOLD, TEXT_WORD_CHARS, DIFF_CHARS = 60, 160, 4000, 20_000
OPS = "array<struct<kind:string,text:string>>"


def opcodes(one: list[str], two: list[str]) -> list[tuple[str, int, int, int, int]]:
    """Those of ``difflib.SequenceMatcher``, without its search where the longest common run is known to be the common start.

    That is so where the start is one side whole, or half of one side or more and what ends it there does not occur on the other side: any longer run would hold that element. Sides that share nothing have no run.
    """
    start = next((n for n, (x, y) in enumerate(zip(one, two)) if x != y), min(len(one), len(two)))
    rest = len(one) - start, len(two) - start
    if start and (not all(rest) or (rest[0] <= start and one[start] not in two) or (rest[1] <= start and two[start] not in one)):
        out = [("equal", 0, start, 0, start)]
        if any(rest):
            alone = not all(rest)
            tail = [("insert" if rest[1] else "delete", 0, rest[0], 0, rest[1])] if alone else opcodes(one[start:], two[start:])
            out += [(tag, i + start, j + start, k + start, m + start) for tag, i, j, k, m in tail]
        return out
    if one and two and set(one).isdisjoint(two):
        return [("replace", 0, len(one), 0, len(two))]
    return difflib.SequenceMatcher(None, one, two, autojunk=False).get_opcodes()


def difference(a: str, b: str, word_chars: int = WORD_CHARS) -> list[tuple[str, str]]:
    """(kind, text) with kinds eq, del and ins: eq and del make up ``a``, eq and ins make up ``b``. Lines first, then words within lines that were replaced."""
    found: list[list[str]] = []

    def add(kind: str, text: str) -> None:
        if text and found and found[-1][0] == kind:
            found[-1][1] += text
        elif text:
            found.append([kind, text])

    def walk(one: list[str], two: list[str], by_words: bool) -> None:
        for tag, i, j, k, m in opcodes(one, two):
            old, new = "".join(one[i:j]), "".join(two[k:m])
            if tag == "equal":
                add("eq", old)
            elif tag == "replace" and by_words and len(old) + len(new) <= word_chars:
                walk(re.findall(WORD, old, re.DOTALL), re.findall(WORD, new, re.DOTALL), False)
            else:
                add("del", old)
                add("ins", new)

    walk(a.splitlines(keepends=True), b.splitlines(keepends=True), True)
    return [(kind, text) for kind, text in found]


def lossless_diff(old: Column, new: Column, word_chars: int = WORD_CHARS) -> Column:
    """:func:`difference` of two columns, null texts empty: array of (kind, text)."""

    @F.pandas_udf(OPS)
    def ops(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "text": t} for k, t in difference(x, y, word_chars)] for x, y in zip(a.fillna(""), b.fillna(""))])

    return ops(old, new)


def fold(ops: Column, context: int = CONTEXT, least: int = FOLD) -> Column:
    """Operations (kind, text, n) where equal runs of ``least`` characters keep ``context`` next to a change; ``skip`` says how many characters went.

    Nothing is kept before the first change or behind the last beyond their context, and a run of which little would go stays whole.
    """
    piece = lambda kind, text, n: F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), text.alias("text"), n.cast("int").alias("n"))

    def one(op: Column, at: Column, of: Column) -> Column:
        size = F.length(op["text"])
        head = F.when(at > 0, F.lit(context)).otherwise(0)
        tail = F.when(at < of - 1, F.lit(context)).otherwise(0)
        gone = size - head - tail
        parts = F.array(piece("eq", F.substring(op["text"], F.lit(1), head), head), piece("skip", F.lit(""), gone), piece("eq", F.right(op["text"], tail), tail))
        parts = F.filter(parts, lambda p: (p["kind"] == "skip") | (p["n"] > 0))
        return F.when((op["kind"] != "eq") | (size < least) | (gone < least // 2), F.array(piece(op["kind"], op["text"], size))).otherwise(parts)

    return let(ops, lambda every: F.flatten(F.transform(every, lambda op, at: one(op, at, F.size(every)))))


def clip(folded: Column, limit: int = VIEW_CHARS) -> Column:
    """Operations of :func:`fold` up to ``limit`` characters; ``cut`` at the end says how many are left."""
    shown = lambda op: F.when(op["kind"] == "skip", F.lit(0)).otherwise(op["n"])
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<kind:string,text:string,n:int>>").alias("out"))

    def add(state: Column, op: Column) -> Column:
        room = F.greatest(F.lit(limit) - state["used"], F.lit(0))
        part = F.struct(op["kind"].alias("kind"), F.substring(op["text"], F.lit(1), room).alias("text"), F.least(op["n"], room).cast("int").alias("n"))
        fits = state["used"] + shown(op) <= limit
        open_ = state["used"] <= limit
        kept = F.when(~open_, state["out"]).when(fits, F.array_append(state["out"], op)).when(room > 0, F.array_append(state["out"], part)).otherwise(state["out"])
        # beyond the limit by one where something was cut, so that nothing follows
        used = F.when(open_ & fits, state["used"] + shown(op)).otherwise(F.lit(limit + 1))
        return F.struct(used.cast("int").alias("used"), kept.alias("out"))

    def whole(ops: Column) -> Column:
        total = F.aggregate(ops, F.lit(0), lambda n, op: n + shown(op))
        cut = F.aggregate(ops, start, add)["out"]
        rest = F.struct(F.lit("cut").alias("kind"), F.lit("").alias("text"), (total - limit).cast("int").alias("n"))
        return F.when(total > limit, F.array_append(cut, rest)).otherwise(cut)

    return let(folded, whole)


def view(old: Column, new: Column, limit: int = VIEW_CHARS) -> Column:
    """The folded and clipped difference of two texts."""
    return clip(fold(lossless_diff(old, new)), limit)


def is_changed(ops: Column) -> Column:
    return F.exists(ops, lambda op: op["kind"].isin("del", "ins"))


def sides_of(kind: Column, text: Column, old_text: Column) -> Column:
    """``struct(before, after)`` of a change record, whose text is the removed or added one where there is only one."""
    text, old = F.coalesce(text, F.lit("")), F.coalesce(old_text, F.lit(""))
    return F.struct(F.when(kind == "added", "").when(kind == "removed", text).otherwise(old).alias("before"), F.when(kind == "removed", "").otherwise(text).alias("after"))


def is_bulky(text: Column, company_list: Column) -> Column:
    """A text whose comparison says little: very long, or a long list."""
    return (F.length(text) > DIFF_CHARS) | ((F.length(text) > LIST_SKIP_CHARS) & (is_list(text) | company_list))


def is_diffable(change_type: Column, old: Column, new: Column, old_bulky: Column, new_bulky: Column) -> Column:
    """A modification whose both texts are known and worth comparing."""
    return (change_type == "modified") & (F.coalesce(F.length(old), F.lit(0)) > 0) & new.isNotNull() & ~old_bulky & ~new_bulky


def change_views(changes: DataFrame, clauses: DataFrame) -> DataFrame:
    """Each change (path, lineage, id, change_type, text, old_text) as it is shown: change, and latest, its text against the current one of its lineage, with same; null where the clause has gone.

    ``clauses``: path, lineage, clause_id and text of the last versions, one of each lineage.
    """
    now = clauses.select("path", "lineage", F.col("clause_id").alias("now_id"), F.coalesce("text", F.lit("")).alias("now"))
    met = changes.join(now, ["path", "lineage"], "left").withColumn("s", sides_of(F.col("change_type"), F.col("text"), F.col("old_text")))
    kept = F.col("now").isNotNull() & (F.col("change_type") != "removed")
    rows = met.withColumn("ops", lossless_diff(F.col("s.before"), F.col("s.after"))).withColumn("later", lossless_diff(F.when(kept, F.col("s.after")), F.when(kept, F.col("now"))))
    shown = lambda ops: clip(fold(F.col(ops)))
    latest = F.when(kept, F.struct(F.col("now_id").alias("clause_id"), (~is_changed(F.col("later"))).alias("same"), shown("later").alias("diff")))
    return rows.select("path", "lineage", "id", "change_type", shown("ops").alias("change"), latest.alias("latest"))


def diff_text(old: Column, new: Column) -> Column:
    """A change as one text: [-left out-], {+put in+}, and how many characters between stay as they were."""
    ops = fold(lossless_diff(old, new, TEXT_WORD_CHARS), TEXT_CONTEXT, TEXT_FOLD)
    write = lambda op: (
        F.when(op["kind"] == "eq", op["text"])
        .when(op["kind"] == "del", F.concat(F.lit("[-"), op["text"], F.lit("-]")))
        .when(op["kind"] == "ins", F.concat(F.lit("{+"), op["text"], F.lit("+}")))
        .otherwise(F.concat(F.lit("(…"), op["n"].cast("string"), F.lit("자 같음…)")))
    )
    return F.array_join(F.transform(ops, write), "")


def change_body(diffable: Column, old: Column, new: Column, plain: Column, limit: int) -> Column:
    """The difference of a change where it can be shown, else its stored text without the first line; beyond ``limit`` characters with a note of what is left."""
    body = F.when(diffable, diff_text(F.when(diffable, old), F.when(diffable, new))).otherwise(F.regexp_replace(plain, r"^[^\n]*\n", ""))
    note = F.concat(F.lit("\n…(이하 "), F.format_number(F.length(body) - limit, 0), F.lit("자 생략)"))
    return F.when(F.length(body) > limit, F.concat(F.substring(body, 1, limit), note)).otherwise(body)


def changed_words(old: Column, new: Column, most: int = 4) -> Column:
    """Up to ``most`` changed places as 'old' → 'new', and how many more there are."""

    @F.pandas_udf("string")
    def write(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a.fillna(""), b.fillna("")):
            one, two = x.split(), y.split()
            places = [f"'{' '.join(one[i:j])[:60]}' → '{' '.join(two[k:m])[:60]}'" for tag, i, j, k, m in difflib.SequenceMatcher(None, one, two, autojunk=False).get_opcodes() if tag != "equal"]
            out.append("; ".join(places[:most]) + (f" 외 {len(places) - most}곳" if len(places) > most else ""))
        return pd.Series(out)

    return write(old, new)


def correction(before: Column, after: Column) -> Column:
    """Both texts of a correction in runs (text, changed), compared by words and marks alone; white space goes with the word behind it."""

    @F.pandas_udf("struct<before:array<struct<text:string,changed:boolean>>,after:array<struct<text:string,changed:boolean>>>")
    def runs(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for texts in zip(a.fillna(""), b.fillna("")):
            words = [[m.span() for m in re.finditer(r"\w+|[^\w\s]", t)] for t in texts]
            named = [[t[i:j] for i, j in own] for t, own in zip(texts, words)]
            edges = [[0, *(i for i, _ in own[1:]), len(t)] for t, own in zip(texts, words)]
            out: tuple[list, list] = ([], [])
            for tag, *at in difflib.SequenceMatcher(None, *named, autojunk=False).get_opcodes():
                for n, (i, j) in enumerate((at[:2], at[2:])):
                    if i < j:
                        out[n].append({"text": texts[n][edges[n][i] : edges[n][j]], "changed": tag != "equal"})
            for n in (0, 1):
                if not words[n] and texts[n]:
                    out[n].append({"text": texts[n], "changed": False})
            rows.append(out)
        return pd.DataFrame(rows, columns=["before", "after"])

    return runs(before, after)


def one_side(ops: Column, kind: str, limit: int = 600) -> Column:
    """What one column of a comparison shows: equal runs and those of ``kind`` (del or ins), ``limit`` characters at most."""
    own = F.filter(ops, lambda op: op["kind"].isin("eq", kind))
    start = F.struct(F.lit(0).alias("used"), F.array().cast(OPS).alias("out"))

    def add(state: Column, op: Column) -> Column:
        text = F.substring(op["text"], F.lit(1), F.lit(limit) - state["used"])
        kept = F.array_append(state["out"], F.struct(op["kind"].alias("kind"), text.alias("text")))
        return F.when(state["used"] >= limit, state).otherwise(F.struct((state["used"] + F.length(text)).cast("int").alias("used"), kept.alias("out")))

    return F.aggregate(own, start, add)["out"]
