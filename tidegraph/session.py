"""Session settings, the shared scratch folder, and cutting of lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def get_session(app: str = "tidegraph", master: str | None = None, shuffle_partitions: int | None = None,
                driver_memory: str | None = None, shared_folder: str | None = None) -> SparkSession:
    """A session; ``shared_folder`` becomes spark.checkpoint.dir, where all intermediate tables go."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if shared_folder:
        builder = builder.config("spark.checkpoint.dir", shared_folder)
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a cluster a
    folder of one machine would be lost with that machine, so its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="tidegraph-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name of this application under the shared root."""
    return f"{shared_root(spark)}/tidegraph/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once as a table in the shared folder and continue from there.

    This cuts the lineage: a lost executor costs a re-read, not a re-run. The size of the
    written table is known, so Spark picks join sides by it, and loops start each round from a short plan.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_flagged(df: DataFrame, flag: str, label: str = "round") -> tuple[DataFrame, bool]:
    """``settle`` one round of a loop, and tell whether any row has ``flag`` set; the count rides on the write."""
    seen = Observation()
    out = settle(df.observe(seen, F.count_if(F.coalesce(flag, F.lit(False))).alias("rows")), label)
    return out, (seen.get.get("rows") or 0) > 0


def settle_counted(df: DataFrame, label: str = "round", **counted: Column) -> tuple[DataFrame, dict[str, int]]:
    """``settle``, and in how many rows each condition of ``counted`` holds; the counts ride on the write."""
    seen = Observation()
    out = settle(df.observe(seen, *[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in counted.items()]), label)
    return out, {name: seen.get.get(name) or 0 for name in counted}


def clear_scratch(spark: SparkSession) -> None:
    """Delete every table that ``settle`` wrote; call it when all results are stored."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/tidegraph/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
