"""Text columns: normalisation for comparison, keys, tokens, detectors. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spaces that count as one, lines that pages change by themselves, punctuation written alike, and leading enumerators.
SPACES = "  -​  　ㅤ﻿\t "
DYNAMIC_LINES = [r"^(최종\s*)?(수정|업데이트|조회)\s*(일시|시각|수)\s*[:：].*$", r"(?i)^(인쇄하기|목록|맨\s*위로|top)$"]
PUNCTUATION = {"“": '"', "”": '"', "‘": "'", "’": "'", "ㆍ": "·", "・": "·", "∙": "·", "–": "-", "—": "-"}
ENUMERATOR = r"^\s*([①-⑳]|\(\d+\)|\[\d+\]|\d+\.)\s*"
# A document's kind by words of its title without spaces, in this order. All groups need one of their words.
DOCUMENT_KINDS = [
    ("동의서", [["동의"]]),
    ("개인정보처리방침", [["개인정보"], ["방침", "고지"]]),
    ("부가서비스", [["재화", "포인트", "멤버십", "유료"]]),
    ("운영정책", [["운영"], ["정책", "원칙", "기준"]]),
    ("대회 규정", [["규정", "규약", "규율"]]),
    ("약관", [["약관", "이용기준"]]),
]
OTHER_KIND = "기타"
# What makes a text a list.
TABLE_SHARE, LIST_LINES, LIST_LINE_CHARS = 0.8, 15, 25


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize(text: Column) -> Column:
    """Text as it is compared: one kind of line end, space and quote; no heading marks, blank or dynamic lines."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    lines = F.transform(lines, lambda s: F.trim(F.regexp_replace(s, f"[{SPACES}]+", " ")))
    lines = F.transform(lines, lambda s: F.regexp_replace(s, r"^#{1,6}\s+", ""))
    lines = F.transform(lines, lambda s: F.when(s.startswith("|"), F.regexp_replace(s, r"\s*\|\s*", " | ")).otherwise(s))
    lines = F.filter(lines, lambda s: (s != "") & ~s.rlike("|".join(f"({p})" for p in DYNAMIC_LINES)))
    return F.array_join(F.transform(lines, lambda s: F.translate(s, "".join(PUNCTUATION), "".join(PUNCTUATION.values()))), "\n")


def match_key(text: Column) -> Column:
    """Key of a clause that stays when it is numbered or spaced differently."""
    return F.regexp_replace(F.regexp_replace(normalize(text), ENUMERATOR, ""), r"(?U)\s+", "")


def content_hash(text: Column) -> Column:
    return F.sha2(normalize(text), 256)


def document_kind(title: Column, kinds=DOCUMENT_KINDS, other: str = OTHER_KIND) -> Column:
    """The first kind whose word groups the title meets."""
    squeezed = F.replace(title, F.lit(" "), F.lit(""))
    out = F.lit(None).cast("string")
    for label, groups in reversed(kinds):
        met = F.lit(True)
        for words in groups:
            one = F.lit(False)
            for w in words:
                one = one | F.contains(squeezed, F.lit(w))
            met = met & one
        out = F.when(met, F.lit(label)).otherwise(out)
    return F.coalesce(out, F.lit(other))


def full_lines(text: Column) -> Column:
    """Lines without white space around them, blank ones left out."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda s: s != "")


def table_share(text: Column) -> Column:
    lines = full_lines(text)
    return F.size(F.filter(lines, lambda s: s.startswith("|"))) / F.size(lines)


def is_list(text: Column) -> Column:
    """Mostly table lines, or many short ones."""
    lines = full_lines(text)
    count = F.size(lines)
    chars = F.aggregate(lines, F.lit(0), lambda n, s: n + F.length(s))
    return F.when(count > 0, (table_share(text) >= TABLE_SHARE) | ((count >= LIST_LINES) & (chars / count <= LIST_LINE_CHARS))).otherwise(F.lit(False))


def first_line(text: Column) -> Column:
    return F.coalesce(F.try_element_at(full_lines(text), F.lit(1)), F.lit(""))


def clip(text: Column, limit: int, note: str) -> Column:
    """Text of at most ``limit`` characters, with a note where some were cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(note))).otherwise(text)


def tokens(text: Column) -> Column:
    """Search terms in order: runs of a-z and digits, then pairs of neighbouring Hangul syllables, spaces between them left out."""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), F.lit(1))
    return F.concat(words, neighbour_pairs(F.regexp_replace(low, "[^가-힣]+", "")))


def neighbour_pairs(text: Column) -> Column:
    """All pairs of neighbouring characters in order; a text of fewer than two has none."""
    return let(F.split(text, ""), lambda c: F.when(F.length(text) >= 2, F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda x, y: F.concat(x, y))).otherwise(F.array().cast("array<string>")))


def overlap_ratio(question: Column, text: Column) -> Column:
    """Share of the question's distinct terms that the text has, to three places."""
    asked = F.array_distinct(tokens(question))
    common = F.size(F.array_intersect(asked, tokens(text)))
    return F.when(F.size(asked) > 0, F.round(common / F.size(asked), 3)).otherwise(F.lit(0.0))


def references(text: Column, own: Column, known: Column, pattern: str = r"(제\d+조(?:의\d+)?)") -> Column:
    """Distinct references of ``pattern`` in order, without the clause itself, that are ``known`` in the document."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
    return F.array_intersect(F.array_except(found, F.array(own)), known)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def probabilities_to_score(weights: Column, levels=(-2.0, -1.0, 0.0, 1.0, 2.0)) -> Column:
    """Expected level and confidence of unnormalised probabilities, to three places; all zero counts as the neutral level."""
    return let(weights, lambda w: _score(w, levels))


def _score(weights: Column, levels) -> Column:
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    neutral = F.array(*(F.lit(1.0 if v == 0 else 0.0) for v in levels))
    share = F.when(total > 0, F.transform(weights, lambda x: x / total)).otherwise(neutral)
    expected_of = lambda share: F.aggregate(F.zip_with(share, F.array(*map(F.lit, levels)), lambda p, v: p * v), F.lit(0.0), lambda s, x: s + x)
    return let(share, lambda p: F.struct(F.round(expected_of(p), 3).alias("favor_score"), F.round(F.array_max(p), 3).alias("favor_confidence"), F.transform(p, lambda x: F.round(x, 4)).alias("probs")))
