"""Places of regular-expression matches by built-in functions alone.

A text split at a pattern and the list of its matches alternate, so the sizes of both say
where each match stands. Sizes go to rows of their own, and a running sum per text and kind
gives positions in one pass however many matches a text has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match_sizes(text: Column, pattern: Column, size=F.length, group: int | None = None) -> Column:
    """One struct for each leftmost non-overlapping match, in order: ``gap`` (size of the text
    since the match before), ``hit`` (its size) and ``inner`` (size of ``group``, or of the
    match). The pattern never matches an empty string."""
    gaps = F.transform(F.split(text, pattern, -1), lambda s: size(s).cast("int"))
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    inner = hits if group is None else F.regexp_extract_all(text, pattern, F.lit(group))
    count = lambda a: F.transform(a, lambda s: size(s).cast("int"))
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), count(hits).alias("hit"), count(inner).alias("inner"))
    return F.when(F.regexp_like(text, pattern), pairs)


def positions(matches: DataFrame, keys: list[str]) -> DataFrame:
    """``start`` and ``end`` of every row of ``matches``, which has ``keys``, ``nth``, ``gap`` and ``hit``."""
    upto = Window.partitionBy(*keys).orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("hit")).over(upto)
    return matches.withColumn("end", end).withColumn("start", F.col("end") - F.col("hit"))
