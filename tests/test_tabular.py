"""Text, evaluation, hashtags, sinks, ranking, statistics and increments."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegraph import schemas
from tidegraph.functions import lexicon, scalars, skew
from tidegraph.functions.significance import _tail, correlation_p
from tidegraph.functions.taxonomy import CATEGORIES
from tidegraph.operators import distributions, evaluation, hashtags, scoring, series
from tidegraph.sources import readers, writers
from tidegraph.streaming import incremental

AT = dt.datetime(2021, 3, 1)


def tweets(spark, *texts, start=0):
    rows = [(str(i), "u", AT + dt.timedelta(hours=i), t) for i, t in enumerate(texts, start)]
    return spark.createDataFrame(rows, schemas.TWEETS)


def test_blank_texts_are_dropped(spark):
    df = tweets(spark, "gut", "", "  ", "\t\n", "  ", None, "x")
    assert [r.text for r in df.where(scalars.not_blank(F.col("text"))).orderBy("tweet_id").collect()] == ["gut", "x"]


def test_plugin_equals_expressions(spark):
    texts = ["Gut, GUT und schlecht", "Du Idiot! idiotisch", "nichts", "best (stupid) worthless_1", "Schön, aber dumm."]
    df = tweets(spark, *texts)
    plugged = scoring.score_by_models(df, lambda: lexicon.lexicon_sentiment, lambda: lexicon.lexicon_toxicity, batch=2)
    key = lambda d: sorted(tuple(r) for r in d.collect())
    assert key(plugged) == key(scoring.score_by_lexicon(df))
    assert plugged.columns == schemas.SCORED_TWEETS.names


def test_plugin_takes_times_beyond_pandas(spark):
    """a post of the year 2500, or without a time, is scored as any other; nanoseconds end in 2262."""
    df = tweets(spark, "gut", "Du Idiot!", "x").withColumn("recorded_at", F.expr(
        "CASE tweet_id WHEN '0' THEN timestamp'2500-01-01 05:00:00' WHEN '1' THEN timestamp'0900-01-01 00:00:00' END"))
    plugged = scoring.score_by_models(df, lambda: lexicon.lexicon_sentiment, lambda: lexicon.lexicon_toxicity)
    key = lambda d: sorted(tuple(r) for r in d.withColumn("recorded_at", F.col("recorded_at").cast("string")).collect())
    assert key(plugged) == key(scoring.score_by_lexicon(df))
    assert key(plugged)[0][2].startswith("2500-01-01 05")


def test_increment_is_idempotent(spark, tmp_path):
    target = str(tmp_path / "scored")
    assert incremental.score_increment(tweets(spark, "a", "b", "c", " "), target, limit=2) == 2
    assert incremental.score_increment(tweets(spark, "a", "b", "c", " "), target) == 1
    assert incremental.score_increment(tweets(spark, "a", "b", "c", " "), target) == 0
    assert sorted(r.tweet_id for r in incremental.stored_scores(spark, target).collect()) == ["0", "1", "2"]



def test_increment_finds_ids_stored_with_another_time(spark, tmp_path):
    target = str(tmp_path / "scored")
    assert incremental.score_increment(tweets(spark, "a", "b", "c"), target) == 3
    again = tweets(spark, "a", "b").withColumn("recorded_at", F.col("recorded_at") + F.expr("interval 9 days"))
    assert incremental.score_increment(again, target) == 0
    assert incremental.score_increment(again.withColumn("recorded_at", F.lit(None).cast("timestamp")), target) == 0
    assert incremental.score_increment(again.unionByName(tweets(spark, "d", start=7)), target) == 1


def test_times_of_a_run(monkeypatch):
    """Batches of 2 and 3 seconds, 1 second before the first and 4 between them; a failed batch counts as waiting."""
    clock = iter([0.0, 1.0, 3.0, 4.0, 7.0, 10.0])
    monkeypatch.setattr(incremental.time, "perf_counter", lambda: next(clock))
    times = incremental.RunTimes()
    assert times.batch(lambda: 10) == 10
    with pytest.raises(ZeroDivisionError):
        times.batch(lambda: 1 // 0)
    times.batch(lambda: 30)
    assert times.summary() == {"total_processed": 40, "batches": 2, "mean_batch_rows": 20.0, "mean_batch_seconds": 5.0,
                               "mean_inference_seconds": 2.5, "mean_queue_seconds": 2.5, "per_second": 4.0}
    monkeypatch.undo()
    assert set(incremental.RunTimes().summary().values()) == {0}


def test_stream_repeated_files_add_nothing(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    tweets(spark, "a", "b").write.parquet(source)
    incremental.score_stream(spark, source, target, state, 1).awaitTermination()
    tweets(spark, "a", "b", "c").write.mode("append").parquet(source)
    incremental.score_stream(spark, source, target, state, 1).awaitTermination()
    assert sorted(r.tweet_id for r in incremental.stored_scores(spark, target).collect()) == ["0", "1", "2"]


def test_evaluation(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("x", "a")], "t string, p string")
    assert [tuple(r) for r in evaluation.confusion(df, "t", "p", ("a", "b", "c")).collect()] == [("a", 1, 1, 0), ("b", 0, 1, 0), ("c", 0, 0, 0)]
    assert evaluation.accuracy(df, "t", "p").first()["accuracy"] == 0.5
    scores = {r.label: (r.precision, r.recall, r.f1_score) for r in evaluation.precision_recall(df, "t", "p", ("a", "b", "c")).collect()}
    assert scores == {"a": (1.0, 0.5, 0.6667), "b": (0.5, 1.0, 0.6667), "c": (0.0, 0.0, 0.0)}


def test_classifier_retries_and_falls_back(spark):
    def make():
        calls = {}

        def ask(tag):
            calls[tag] = calls.get(tag, 0) + 1
            if tag == "never" or (tag == "later" and calls[tag] < 3):
                raise RuntimeError("busy")
            return ('{"categories": ["Weather"], "confidence": 0.5}' if tag != "broken" else "{oops"), 3, 1
        return ask

    tags = spark.createDataFrame([("later",), ("never",), ("broken",), ("ok",), ("ok",)], "hashtag string").coalesce(1)
    got = {r.hashtag: (list(r.categories), r.confidence) for r in hashtags.classify(tags, make, first_wait=0).collect()}
    assert got == {"later": (["Weather"], 0.5), "never": (["Other"], 0.0), "broken": (["Other"], 0.0), "ok": (["Weather"], 0.5)}
    assert hashtags.attach(tags, hashtags.classify(tags, make, first_wait=0)).count() == 5
    assert len(CATEGORIES) == len(set(CATEGORIES)) == 59


def test_sinks(spark, tmp_path):
    schema, path = schemas.EDGES, str(tmp_path / "edges")
    rows = [("g", dt.date(2021, m, 1), "a", "b", m, 0.5, 0.5) for m in (1, 2)]
    writers.replace_table(spark.createDataFrame(rows, schema), path, schema)
    writers.refresh_months(spark.createDataFrame([("g", dt.date(2021, 2, 1), "x", "y", 9, 0.0, 0.0)], schema), path, schema)
    writers.append_table(spark.createDataFrame([("g", dt.date(2021, 3, 1), "x", "y", 3, 0.0, 0.0)], schema), path, schema)
    assert sorted(r.weight for r in readers.read_edges(spark, path).collect()) == [1, 3, 9]
    assert [r.weight for r in readers.read_edges(spark, path, dt.date(2021, 2, 1)).collect()] == [9]
    plan = readers.read_edges(spark, path, dt.date(2021, 2, 1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month_start" in plan
    with pytest.raises(ValueError):
        writers.conform(spark.range(1), schema)


def test_large_groups_rank_as_small_ones(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("k"), (F.col("id") * 7 % 101).alias("v"), "id")
    order = [F.desc("v"), F.col("id")]
    small, large = (skew.ranked(df, ["k"], order, group_rows=n).orderBy("id").collect() for n in (1000, 10))
    assert [r.position for r in small] == [r.position for r in large]
    for q in (0.5, 0.9, 0.0, 1.0):
        want = {r.k: r.p for r in df.groupBy("k").agg(F.percentile("v", F.lit(q)).alias("p")).collect()}
        got = {r.k: r.p for r in skew.exact_quantile(df, ["k"], "v", q, "p", group_rows=10).collect()}
        assert got == pytest.approx(want)


def test_hot_join_equals_join(spark):
    many = spark.range(300).select(F.when(F.col("id") < 200, 0).otherwise(F.col("id") % 7).alias("k"), "id")
    one = spark.range(6).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left", "left_semi"):
        want = sorted(map(tuple, many.join(one, "k", how).select("k", "id").collect()))
        assert sorted(map(tuple, skew.hot_join(many, one, ["k"], how, slot_rows=20).select("k", "id").collect())) == want


def test_histogram_edges(spark):
    df = spark.createDataFrame([("g", dt.date(2021, 1, 1), v) for v in (1, 1, 2, 10, 100)], "graph_id string, month_start date, v long")
    linear = distributions.histogram(df, "v", "h", 4).orderBy("bin").collect()
    assert [r["count"] for r in linear] == [4, 0, 0, 1] and linear[0].low == 1 and linear[-1].high == 100
    log = distributions.histogram(df, "v", "h", 3, log=True).orderBy("bin").collect()
    assert [r["count"] for r in log] == [3, 2] and log[0].high == pytest.approx(10)
    flat = distributions.histogram(df.where("v = 10"), "v", "h", 4).orderBy("bin").collect()
    assert [r["count"] for r in flat] == [0, 0, 1, 0] and flat[0].low == 9.5


def test_p_values(spark):
    assert _tail(0.3, 1, 0.5) == pytest.approx(1 - 0.7 ** 0.5)
    df = spark.createDataFrame([(0.5, 4), (-0.5, 4), (0.3, 2), (1.0, 9)], "r double, n long")
    got = [r.p for r in df.select(correlation_p("r", "n").alias("p")).collect()]
    assert got[:2] == [pytest.approx(0.5)] * 2 and got[2] is None and got[3] == 0.0  # n = 4: r is uniform


def test_p_values_as_continued_fraction(spark):
    cases = [(r, n) for r in (0.0, 1e-4, 0.05, -0.2, 0.31, 0.32, -0.6, 0.95, 0.999999, -1.0) for n in (3, 4, 5, 6, 7, 12, 61, 240)]
    odd = [(None, 9), (0.5, None), (float("nan"), 9), (0.5, 1), (1.0000000000000002, 8)]
    df = spark.createDataFrame([(*c, i) for i, c in enumerate(cases + odd)], "r double, n long, i int")
    got = [r.p for r in df.withColumn("p", correlation_p("r", "n")).orderBy("i").collect()]
    for (r, n), p in zip(cases, got):
        assert p == pytest.approx(_tail(1 - r * r, (n - 2) / 2, 0.5), rel=1e-9, abs=0 if r * r >= 0.1 else 1e-13), (r, n)
    assert got[len(cases):] == [None, None, None, None, 0.0]


def test_series_pairs_and_lags(spark):
    months = [dt.date(2021, m, 1) for m in range(1, 9)]
    x = [1.0, 2.0, 2.0, 5.0, 4.0, 8.0, 7.0, 9.0]
    lead = [3.0, *x[:-1]]  # runs one month behind x
    table = spark.createDataFrame([("g", d, a, b, 1.0) for d, a, b in zip(months, x, lead)], "graph_id string, month_start date, x double, lead double, flat double")
    long = series.long_form(table, ["x", "lead", "flat"])
    pair = {(r.metric1, r.metric2): r for r in series.measures(long).collect()}
    assert pair["x", "lead"].slope == pytest.approx(pair["x", "lead"].pearson_r)
    assert pair["x", "lead"].intercept == pytest.approx(0, abs=1e-12)
    assert pair["x", "flat"].pearson_r is None
    lags = {(r.metric1, r.metric2, r.lag): r.correlation for r in series.lagged(long).collect()}
    assert lags["lead", "x", 1] == pytest.approx(1.0)
    best = {(r.metric1, r.metric2): r.lag for r in series.strongest_lag(series.lagged(long)).collect()}
    assert best["lead", "x"] == 1


def test_sums_do_not_depend_on_the_order_of_rows(spark):
    from tidegraph.operators import local
    arcs = spark.range(4000).select(
        F.lit("g").alias("graph_id"), F.to_date(F.lit("2021-01-01")).alias("month_start"), (F.col("id") % 7).cast("string").alias("source"),
        (F.col("id") % 11).cast("string").alias("target"), F.lit(3).cast("long").alias("weight"), ((F.col("id") * 7919) % 1000003 / 1000000).alias("sum_toxicity"))
    seen = set()
    for parts in (1, 4, 200):
        dealt = arcs.repartition(parts, F.rand(parts))
        flow = sorted(map(tuple, local.node_flow(dealt).select("node_id", "toxicity_sent", "toxicity_received_avg").collect()))
        seen.add((repr(flow), repr(local.network_toxicity(dealt).collect())))
    assert len(seen) == 1


def test_keyword_expression_replies_like_the_classifier(spark):
    tags = ["Klimaschutz", "bundestag2021", "xyz", "", "corona_impfung", "EUROPA", None, "xyz"]
    df = spark.createDataFrame([(t, 1) for t in tags], "hashtag string, politician_users long")
    rows = lambda d: sorted(tuple(r[c] for c in ("hashtag", "categories", "confidence", "prompt_tokens", "completion_tokens")) for r in d.collect())
    assert rows(hashtags.classify(df)) == rows(hashtags.classify(df, lambda: hashtags.keyword_reply, tasks=3))


def test_with_small_beyond_its_bound(spark, monkeypatch):
    monkeypatch.setattr(skew, "FEW_ROWS", 1)
    many = spark.createDataFrame([(k % 3, k) for k in range(30)], "k long, v long")
    few = spark.createDataFrame([(0, "a"), (1, "b")], "k long, name string")
    got = skew.with_small(many, few, ["k"], "left")
    assert {(r.k, r.v, r.name) for r in got.collect()} == {(k % 3, k, {0: "a", 1: "b"}.get(k % 3)) for k in range(30)}
