"""Interaction edges, posts and dimensions derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import scratch_path
from .. import KEY

_written: dict[tuple[str, str], str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def derive_edges(spark: SparkSession, sf: str, grain: str = "month") -> DataFrame:
    """Successive suppliers, and successive parts, of an order: two graphs per period.

    The discount of the first line stands for the toxicity of an interaction.
    """
    day = F.to_date(F.date_trunc(grain, "o_orderdate")).alias("month_start")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    lines = table(spark, sf, "lineitem").select("l_orderkey", *order)
    following = Window.partitionBy("l_orderkey").orderBy(*order)

    # Numbers until the arcs are counted: they make smaller rows to shuffle than the names do.
    def graph(name: int, column: str):
        return F.struct(F.lit(name).cast("byte").alias("graph"), F.col(column).alias("source"), F.lead(column).over(following).alias("target"))

    steps = lines.select("l_orderkey", F.col("l_discount").alias("tox"), graph(0, "l_suppkey").alias("s"), graph(1, "l_partkey").alias("p"))
    steps = steps.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), day), "l_orderkey")
    arcs = steps.select("month_start", "tox", F.inline(F.array("s", "p"))).where(F.col("target").isNotNull())
    counted = arcs.groupBy("graph", "month_start", "source", "target").agg(
        F.count(F.lit(1)).alias("weight"), F.round(F.sum("tox"), 6).alias("sum_toxicity"),
        F.round(F.avg("tox"), 6).alias("avg_toxicity"))
    return counted.select(F.when(F.col("graph") == 0, "supplier").otherwise("part").alias("graph_id"), "month_start",
                          F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"),
                          "weight", "sum_toxicity", "avg_toxicity")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """The edge table, written once per application, as the queries find it in a warehouse."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _written:
        path = scratch_path(spark, "edges")
        derive_edges(spark, sf).write.parquet(path)
        _written[key] = path
    return spark.read.parquet(_written[key])


def tweets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("tweet_id"),
        (F.col("doc_id") % 97).cast("string").alias("user_id"),
        F.timestamp_add("HOUR", (F.col("doc_id") * 7).cast("int"), F.lit("2021-01-01").cast("timestamp")).alias("recorded_at"),
        "text")


def politicians(spark: SparkSession, sf: str) -> DataFrame:
    """Every fourth supplier is a politician, its nation the party."""
    supplier, nation = table(spark, sf, "supplier"), table(spark, sf, "nation")
    return (supplier.where(F.col("s_suppkey") % 4 == 0)
            .join(nation, supplier.s_nationkey == nation.n_nationkey)
            .select(F.col("s_suppkey").cast("string").alias("twitter_handle"), F.col("s_name").alias("official_name"),
                    F.col("n_name").alias("party")))


def hashtags(spark: SparkSession, sf: str) -> DataFrame:
    """Event keys, market segments and nations as hashtags, with their number of distinct users."""
    events = table(spark, sf, "events").select(
        F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("hashtag"), F.col("user_id").alias("user"))
    customer = table(spark, sf, "customer").join(
        table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    named = customer.select(F.explode(F.array(F.lower("n_name"), F.lower("c_mktsegment"))).alias("hashtag"),
                            F.col("c_custkey").alias("user"))
    return (events.unionByName(named).where(F.col("hashtag").isNotNull())
            .groupBy("hashtag").agg(F.count_distinct("user").alias("politician_users")))
