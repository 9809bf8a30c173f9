"""Statistics over monthly metric series: correlations, regression, lags.

A series has one row per month, so frames here are small whatever the graphs' size;
they are still grouped by graph and metric pair, never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import correlation
from ..functions.significance import correlation_p

# The metrics analysed, and the longest lag in months.
METRICS = ("modularity", "network_avg_toxicity", "transitivity", "assortativity", "max_core_number",
           "rich_club_coefficient", "average_clustering", "connected_components", "density")
MAX_LAG = 3
PAIR = ["graph_id", "metric1", "metric2"]


def available(table: DataFrame, metrics: tuple[str, ...] = METRICS) -> tuple[DataFrame, list[str], list[str]]:
    """Month and those metrics that exist, with the names present and missing."""
    present = [m for m in metrics if m in table.columns]
    keep = [c for c in ("graph_id", "month_start") if c in table.columns]
    return table.select(*keep, *present), present, [m for m in metrics if m not in table.columns]


def long_form(table: DataFrame, metrics: list[str]) -> DataFrame:
    """Rows (graph, month, metric, value), with the metric's position and the month's index."""
    rows = table.select("graph_id", "month_start", *[F.col(m).cast("double") for m in metrics])
    rows = rows.unpivot(["graph_id", "month_start"], metrics, "metric", "value")
    place = F.array_position(F.array(*[F.lit(m) for m in metrics]), F.col("metric"))
    t = F.row_number().over(Window.partitionBy("graph_id", "metric").orderBy("month_start"))
    return rows.withColumn("place", place).withColumn("t", t)


def zscore(value: Column, *keys: str) -> Column:
    """Deviation from the mean in sample standard deviations; null where nothing varies."""
    w = Window.partitionBy(*keys)
    return F.try_divide(value - F.avg(value).over(w), F.nullif(F.stddev_samp(value).over(w), F.lit(0.0)))


def trends(table: DataFrame, metrics: list[str]) -> DataFrame:
    return long_form(table, metrics).select("graph_id", "month_start", "metric",
                                            zscore(F.col("value"), "graph_id", "metric").alias("normalized"))


def average_rank(value: str, keys: list[str]) -> Column:
    """Rank with ties sharing their mean."""
    first = F.rank().over(Window.partitionBy(*keys).orderBy(value))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return first + (ties - 1) / 2


def pairs(long: DataFrame, lags: int = 0, ordered: bool = False) -> DataFrame:
    """(x, y) per metric pair and month, complete cases; with ``lags`` x runs ahead of y by 0 to that many months."""
    left = long.select("graph_id", F.col("metric").alias("metric1"), F.col("place").alias("place1"), "t",
                       "month_start", F.col("value").alias("x"))
    right = long.select("graph_id", F.col("metric").alias("metric2"), F.col("place").alias("place2"),
                        F.col("t").alias("t2"), F.col("value").alias("y"))
    left = left.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(lags)))).withColumn("t2", F.col("t") - F.col("lag"))
    want = F.col("place1") != F.col("place2") if ordered else F.col("place1") < F.col("place2")
    joined = left.join(right, ["graph_id", "t2"]).where(want & F.col("x").isNotNull() & F.col("y").isNotNull())
    return joined.select(*PAIR, "lag", "month_start", "x", "y")


def _with_ranks(points: DataFrame) -> DataFrame:
    keys = [*PAIR, "lag"]
    return points.withColumn("rx", average_rank("x", keys)).withColumn("ry", average_rank("y", keys))


def _normal(points: DataFrame, normalize: bool) -> DataFrame:
    """z-scores inside each pair and lag, after incomplete cases are gone."""
    if not normalize:
        return points
    keys = [*PAIR, "lag"]
    return points.withColumn("x", zscore(F.col("x"), *keys)).withColumn("y", zscore(F.col("y"), *keys))


def _fit() -> list[Column]:
    return [F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
            F.regr_r2("y", "x").alias("r_squared")]


def measures(long: DataFrame, normalize: bool = True, p_values: bool = True) -> DataFrame:
    """Pearson, Spearman and the straight-line fit of each metric pair."""
    points = _normal(_with_ranks(pairs(long)), normalize)
    result = points.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("n"), correlation(F.col("x"), F.col("y")).alias("pearson_r"),
        correlation(F.col("rx"), F.col("ry")).alias("spearman_r"), *_fit())
    if p_values:
        result = (result.withColumn("pearson_p", correlation_p("pearson_r", "n"))
                  .withColumn("spearman_p", correlation_p("spearman_r", "n")))
    return result


def lagged(long: DataFrame, max_lag: int = MAX_LAG, normalize: bool = True) -> DataFrame:
    """Spearman correlation and R² of every ordered pair at each lag."""
    points = _normal(_with_ranks(pairs(long, max_lag, ordered=True)), normalize)
    return points.groupBy(*PAIR, "lag").agg(
        correlation(F.col("rx"), F.col("ry")).alias("correlation"), F.regr_r2("y", "x").alias("r_squared"))


def strongest_lag(lags: DataFrame) -> DataFrame:
    """The lag of greatest absolute correlation, the first on ties."""
    best = F.max_by(F.struct("lag", "correlation", "r_squared"),
                    F.struct(F.round(F.abs("correlation"), 12), -F.col("lag"))).alias("best")
    return lags.where(F.col("correlation").isNotNull()).groupBy(*PAIR).agg(best).select(*PAIR, "best.*")


def correlation_matrix(long: DataFrame) -> DataFrame:
    """Spearman correlation of all ordered pairs, the diagonal included."""
    off = _with_ranks(pairs(long, ordered=True)).groupBy(*PAIR).agg(
        correlation(F.col("rx"), F.col("ry")).alias("correlation"))
    same = (long.where(F.col("value").isNotNull()).groupBy("graph_id", F.col("metric").alias("metric1"))
            .agg(F.when(F.stddev_pop("value") > 0, 1.0).alias("correlation"))
            .select("graph_id", "metric1", F.col("metric1").alias("metric2"), "correlation"))
    return off.unionByName(same)


def regression_points(long: DataFrame, normalize: bool = True) -> DataFrame:
    """Points of each pair with the fitted value."""
    points = _normal(pairs(long), normalize)
    fit = points.groupBy(*PAIR).agg(*_fit())
    return points.join(fit, PAIR).select(
        *PAIR, "month_start", "x", "y", (F.col("slope") * F.col("x") + F.col("intercept")).alias("fitted"))


def report(table: DataFrame, metrics: tuple[str, ...] = METRICS, normalize: bool = True) -> DataFrame:
    """All measures of each pair with its strongest lag."""
    kept, present, _ = available(table, metrics)
    long = long_form(kept, present)
    best = strongest_lag(lagged(long, normalize=normalize)).select(
        *PAIR, F.col("lag").alias("strongest_lag"), F.col("correlation").alias("lag_correlation"),
        F.col("r_squared").alias("lag_r_squared"))
    return measures(long, normalize).join(best, PAIR, "left")
