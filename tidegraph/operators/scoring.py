"""Sentiment and toxicity of posts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import lexicon
from ..functions.scalars import class_probability, not_blank
from ..schemas import SCORED_TWEETS

Scorer = Callable[[list[str]], list[tuple[str, float]]]
"""Texts to (label, score) pairs, one per text."""


def _result(df: DataFrame, sentiment: Column, toxicity: Column) -> DataFrame:
    return df.select("tweet_id", "user_id", "recorded_at", "text", sentiment.alias("s"), toxicity.alias("t")).select(
        "tweet_id", "user_id", "recorded_at", "text", F.col("s.label").alias("sentiment"),
        *[class_probability(name, F.col("s.label"), F.col("s.score")).alias(f"{name}_probability")
          for name in lexicon.SENTIMENT_LABELS],
        F.col("t.label").alias("toxicity_label"), F.col("t.score").alias("toxicity_score"))


def score_by_lexicon(tweets: DataFrame) -> DataFrame:
    """Score every post with text by the built-in word lists, inside the JVM."""
    return _result(tweets.where(not_blank(F.col("text"))), lexicon.sentiment(F.col("text")), lexicon.toxicity(F.col("text")))


def score_by_models(tweets: DataFrame, sentiment: Callable[[], Scorer], toxicity: Callable[[], Scorer],
                    batch: int = 128) -> DataFrame:
    """Score every post with two plug-in models.

    Each argument makes a scorer; it is called once per task, so that a model is loaded
    where it runs and kept for all of the task's batches.
    """
    fields = SCORED_TWEETS.fields[:4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feel, harm = sentiment(), toxicity()
        for rows in batches:
            for start in range(0, rows.num_rows, batch):
                part = rows.slice(start, batch)
                texts = part.column("text").to_pylist()
                s, t = feel(texts), harm(texts)
                # The other columns stay as they came: times need not fit a pandas timestamp.
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *[pa.array(c, kind) for found in (s, t) for c, kind in (
                        ([x[0] for x in found], pa.string()), ([float(x[1]) for x in found], pa.float64()))]],
                    names=schema.names)

    schema = T.StructType([*fields, *T.StructType.fromDDL("s_label string, s_score double, t_label string, t_score double")])
    posts = tweets.where(not_blank(F.col("text"))).select(*[F.col(f.name).cast(f.dataType) for f in fields])
    scored = posts.mapInArrow(run, schema)
    return _result(scored, F.struct(F.col("s_label").alias("label"), F.col("s_score").alias("score")),
                   F.struct(F.col("t_label").alias("label"), F.col("t_score").alias("score")))


def weekly_toxicity(scored: DataFrame) -> DataFrame:
    """Posts and mean toxicity per week starting on Monday, newest first."""
    return (scored.groupBy(F.date_trunc("week", "recorded_at").alias("week_start"))
            .agg(F.count("tweet_id").alias("total_tweets"), F.avg("toxicity_score").alias("avg_toxicity_score"))
            .orderBy(F.desc("week_start")))


def newest(tweets: DataFrame, n: int) -> DataFrame:
    return tweets.orderBy(F.desc("recorded_at"), "tweet_id").limit(n)


def page(tweets: DataFrame, size: int, after: tuple | None = None, skip: int = 0) -> DataFrame:
    """One page, oldest first. ``after`` is the (recorded_at, tweet_id) last seen: unlike ``skip`` it costs no re-sort of what went before."""
    if after is not None:
        at, last = F.lit(after[0]), F.lit(after[1])
        tweets = tweets.where((F.col("recorded_at") > at) | ((F.col("recorded_at") == at) & (F.col("tweet_id") > last)))
    rows = tweets.orderBy("recorded_at", "tweet_id")
    return (rows.offset(skip) if skip else rows).limit(size)


def unscored(tweets: DataFrame, scored: DataFrame) -> DataFrame:
    """Posts with text that are not in the result table; a null id there hides nothing."""
    return tweets.where(not_blank(F.col("text"))).join(scored.select("tweet_id"), "tweet_id", "left_anti")
