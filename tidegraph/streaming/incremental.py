"""Scoring in increments: one batch pass, or a stream of arriving files."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from .. import schemas
from ..functions.scalars import not_blank
from ..operators.scoring import newest, score_by_lexicon, unscored
from ..sources.writers import conform

Score = Callable[[DataFrame], DataFrame]


def stored_scores(spark: SparkSession, path: str) -> DataFrame:
    """The result table, empty if it does not exist yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schemas.SCORED_TWEETS)
    return spark.read.schema(schemas.SCORED_TWEETS).parquet(path)


def score_increment(tweets: DataFrame, target: str, limit: int | None = None, score: Score = score_by_lexicon) -> int:
    """Score what is not in the target yet, the newest first if limited, and append it.

    What is present in the target counts as done, so a run can be stopped and repeated. Of the target the time span of
    ``tweets`` is looked at first; ids not found there may be stored with another time and are looked up in the rest by id.
    Returns the number of rows written.
    """
    at = F.col("recorded_at")
    first, last = tweets.agg(F.min(at), F.max(at)).first()
    done = stored_scores(tweets.sparkSession, target)
    within = at.isNull() if first is None else at.isNull() | at.between(F.lit(first), F.lit(last))
    todo = unscored(tweets, done.where(within))
    todo = unscored(todo, done.where(~within).join(todo.select("tweet_id").distinct(), "tweet_id", "left_semi"))
    if limit:
        todo = newest(todo, limit)
    return _append(score(todo.dropDuplicates(["tweet_id"])), target)


def _append(scored: DataFrame, target: str) -> int:
    seen = Observation()
    conform(scored, schemas.SCORED_TWEETS).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(target)
    return seen.get.get("rows") or 0


@dataclass
class RunTimes:
    """What the batches of a run add up to; running sums, so its size does not grow with the run.

    A batch's inference is the job that reads, scores and appends its rows; its queue time is what passes between the
    start of the run or the end of the batch before and that job. The clock starts when the object is made.
    """

    batches: int = 0
    rows: int = 0
    inference: float = 0.0
    queue: float = 0.0

    def __post_init__(self) -> None:
        self._since = time.perf_counter()

    def batch(self, work: Callable[[], int]) -> int:
        """Run one batch, which returns its number of rows. A batch that fails is not counted; its time is the next one's queue time."""
        start = time.perf_counter()
        rows = work()
        end = time.perf_counter()
        self.batches, self.rows = self.batches + 1, self.rows + rows
        self.inference, self.queue, self._since = self.inference + end - start, self.queue + start - self._since, end
        return rows

    def summary(self) -> dict[str, float]:
        """Totals, means per batch, and rows per second; 0 for a run without batches."""
        n, whole = max(self.batches, 1), self.inference + self.queue
        return {"total_processed": self.rows, "batches": self.batches, "mean_batch_rows": self.rows / n,
                "mean_batch_seconds": whole / n, "mean_inference_seconds": self.inference / n, "mean_queue_seconds": self.queue / n,
                "per_second": self.rows / whole if whole else 0.0}


def score_stream(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 8,
                 score: Score = score_by_lexicon, times: RunTimes | None = None) -> StreamingQuery:
    """Score posts as files arrive. A batch that is run again finds its rows done and adds none.

    ``times`` adds up how long the batches take.
    """
    times = times or RunTimes()
    arriving = (spark.readStream.schema(schemas.TWEETS).option("maxFilesPerTrigger", files_per_batch).parquet(source)
                .where(not_blank(F.col("text"))))

    def write(batch: DataFrame, _: int) -> None:
        times.batch(lambda: score_increment(batch, target, score=score))

    return (arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def weekly_stream(scored: DataFrame, late: str = "7 days") -> DataFrame:
    """Streaming form of the weekly toxicity; the offset moves seven-day windows to Mondays."""
    return (scored.withWatermark("recorded_at", late).groupBy(F.window("recorded_at", "7 days", "7 days", "4 days"))
            .agg(F.count("tweet_id").alias("total_tweets"), F.avg("toxicity_score").alias("avg_toxicity_score"))
            .select(F.col("window.start").alias("week_start"), "total_tweets", "avg_toxicity_score"))


def run_statistics(scored: DataFrame, write: Callable[[DataFrame], None]) -> dict[str, float]:
    """Write the scored posts and return how many there were, with the seconds and rows per second it took."""
    seen, start = Observation(), time.perf_counter()
    write(scored.observe(seen, F.count(F.lit(1)).alias("rows")))
    seconds, rows = time.perf_counter() - start, seen.get.get("rows") or 0
    return {"total_processed": rows, "seconds": seconds, "per_second": rows / seconds}
