"""Extensions beyond the document engine: relational and event-time queries over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import events as S
from ..tables import table


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    money = lambda c, name: F.round(F.sum(c), 2).alias(name)
    return items.groupBy("l_returnflag", "l_linestatus").agg(
        money(F.col("l_quantity"), "sum_qty"), money(F.col("l_extendedprice"), "sum_base"), money(net, "sum_net"), money(net * (1 + F.col("l_tax")), "sum_charge"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count("*").alias("items")
    )


def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("items"))


def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


def order_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    late = items.where("l_returnflag = 'R'").select("l_partkey")
    early = items.where("l_returnflag = 'A'").select("l_partkey")
    rows = [("both", late.intersect(early)), ("returned_only", late.subtract(early)), ("either", late.union(early).distinct())]
    out = None
    for name, keys in rows:
        one = keys.agg(F.count("*").alias("parts")).select(F.lit(name).alias("side"), "parts")
        out = one if out is None else out.unionByName(one)
    return out


def event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tumbling(table(spark, sf_dir, "events"), "1 hour").select(F.col("window.start").alias("hour"), "event_type", "n", F.round("v", 6).alias("v"))


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sessions(table(spark, sf_dir, "events"), "30 minutes").select("user_id", F.col("session.start").alias("first"), "n")


QUERIES = {
    "pricing_summary": (
        pricing_summary,
        """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_net,
round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as sum_charge, round(avg(l_discount), 6) as avg_discount, count(*) as items from lineitem where l_shipdate <= timestamp '1998-09-02' group by all""",
    ),
    "revenue_by_nation": (
        revenue_by_nation,
        """select r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as items from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name, n_name""",
    ),
    "customers_without_orders": (customers_without_orders, "select c_custkey, c_mktsegment from customer where c_custkey not in (select o_custkey from orders)"),
    "order_cube": (order_cube, "select o_orderstatus, o_orderpriority, count(*) as orders, round(sum(o_totalprice), 2) as total from orders group by cube (o_orderstatus, o_orderpriority)"),
    "set_operations": (
        set_operations,
        """with r as (select distinct l_partkey from lineitem where l_returnflag = 'R'), a as (select distinct l_partkey from lineitem where l_returnflag = 'A')
select 'both' as side, count(*) as parts from (select * from r intersect select * from a) union all select 'returned_only', count(*) from (select * from r except select * from a) union all select 'either', count(*) from (select * from r union select * from a)""",
    ),
    "event_hours": (event_hours, "select date_trunc('hour', ts) as hour, event_type, count(*) as n, round(sum(value), 6) as v from events group by all"),
    "event_sessions": (
        event_sessions,
        """with g as (select user_id, ts, case when ts - lag(ts) over w < interval 30 minutes then 0 else 1 end n from events window w as (partition by user_id order by ts)), s as (select user_id, ts, sum(n) over (partition by user_id order by ts range between unbounded preceding and current row) k from g)
select user_id, min(ts) as first, count(*) as n from s group by user_id, k""",
    ),
}
