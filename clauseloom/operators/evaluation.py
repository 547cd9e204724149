"""Evaluation of rankings and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_relevant(ranked: DataFrame, gold: DataFrame, query: str, key: str) -> DataFrame:
    """query and rank of its first relevant result; null where none is."""
    hits = ranked.join(gold, [query, key], "left_semi").groupBy(query).agg(F.min("rank").alias("rank"))
    return gold.select(query).union(ranked.select(query)).distinct().join(hits, query, "left")


def recall_and_mrr(ranks: DataFrame, by: list[str], cuts: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Recall at each cut and mean reciprocal rank, by group and (group null) over all."""
    at = [F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in cuts]
    return ranks.rollup(*by).agg(F.count("*").alias("questions"), *at, F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def threshold_sweep(labelled: DataFrame, truth: str, score: str, thresholds: DataFrame) -> DataFrame:
    """precision, recall and f1 of ``score <= threshold`` for each threshold of a small table, best first (the lowest of equal ones)."""
    swept = labelled.select(truth, score).crossJoin(F.broadcast(thresholds))
    said = F.col(score) <= F.col("threshold")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sums = swept.groupBy("threshold").agg(count(said & F.col(truth)).alias("tp"), count(said & ~F.col(truth)).alias("fp"), count(~said & F.col(truth)).alias("fn"))
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    return sums.withColumn("f1", f1).withColumn("place", F.row_number().over(Window.orderBy(F.desc("f1"), "threshold")).cast("long"))


def agreement(labelled: DataFrame, human: str, model: str, by: list[str]) -> DataFrame:
    """Mean absolute error, exact and within-one agreement of levels."""
    apart = F.abs(F.col(human) - F.col(model))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return labelled.groupBy(*by).agg(F.count("*").alias("labels"), F.avg(apart).alias("mae"), share(apart == 0).alias("exact"), share(apart <= 1).alias("within_one"))


def within_budget(ranked: DataFrame, query: str, length: str, budget: int) -> DataFrame:
    """Results in rank order until ``budget`` characters are used, the last one cut to what is left: adds used."""
    before = F.coalesce(F.sum(length).over(Window.partitionBy(query).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranked.withColumn("before", before).where(F.col("before") < budget).withColumn("used", F.least(F.col(length), budget - F.col("before"))).drop("before")
