"""Line deduplication by the number of distinct sites a line is found on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.skew import with_small
from ..session import settle

MIN_SITES = 10
"""Distinct sites from which on a line is boilerplate."""
MIN_WORDS = 3
"""Shorter lines say too little to be judged and are never boilerplate."""
SKETCH_BITS = 12
KEY = ["line_hash", "line_check"]


def lines_of(docs: DataFrame, id_col: str, site: str, text: str, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per line that is judged: its place and two 64-bit hashes of the trimmed line."""
    line = F.trim("line")
    each = docs.select(F.col(id_col).alias("id"), F.col(site).alias("site"), F.xxhash64(text).alias("body"),
                       F.posexplode(F.split(text, "\n")).alias("at", "line")).where(line != "")
    if min_words > 1:
        each = each.where(F.size(F.split(line, r"[ \t]+", min_words)) >= min_words)
    return each.select("id", "body", "site", "at", F.xxhash64(line).alias("line_hash"), F.xxhash64(F.lit("line"), line).alias("line_check"))


def spread(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes of the lines found on at least ``min_sites`` distinct sites, with ``sites`` where counted exactly.

    HyperLogLog sketches of the sites merge by aggregation, so a line that holds a third of all rows is summed up
    before it is shuffled. Estimates under half the threshold or over twice it decide (many times the sketch's error);
    for lines between them the distinct sites are counted.
    """
    sketch = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_BITS)))
    guessed = settle(lines.groupBy(*KEY).agg(sketch.alias("guess")).where(F.col("guess") >= min_sites / 2), "spread")
    near = guessed.where(F.col("guess") <= 2 * min_sites).select(*KEY)
    exact = (lines.where(F.col("site").isNotNull()).select(*KEY, "site").distinct().join(near, KEY, "left_semi")
             .groupBy(*KEY).agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites))
    sure = guessed.where(F.col("guess") > 2 * min_sites).select(*KEY, F.lit(None).cast("long").alias("sites"))
    return exact.unionByName(sure)


def marked(docs: DataFrame, id_col: str = "doc_id", site: str = "source", text: str = "text", min_sites: int = MIN_SITES,
           min_words: int = MIN_WORDS, keep_first: bool = True) -> DataFrame:
    """``docs`` in a struct ``row`` with ``removed``, the sorted numbers (from 0) of the lines to take out.

    A line goes when it is found on at least ``min_sites`` sites; with ``keep_first`` its occurrence of least id and
    place stays, so that no content is lost. Lines are compared without spaces around them; blank lines and lines of
    fewer than ``min_words`` words stay. Null texts have no lines, a null site is no site, identical rows are treated
    alike, an empty table gives an empty one.
    """
    lines = lines_of(docs, id_col, site, text, min_words)
    common = settle(spread(lines, min_sites).select(*KEY), "boilerplate")
    found = with_small(lines.drop("site"), common, KEY, rows=common.count())
    if keep_first:
        found = settle(found, "found")
        # Null ids come before all others.
        place = F.struct(F.col("id").isNotNull(), "id", "body", "at")
        first = found.groupBy(*KEY).agg(F.min(place).alias("first"))
        found = with_small(found, first, KEY, rows=common.count()).where(place != F.col("first"))
    removed = found.groupBy("id", "body").agg(F.array_sort(F.collect_set("at")).alias("removed"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_id"), F.xxhash64(text).alias("_body"))
    same = rows["_id"].eqNullSafe(removed["id"]) & (rows["_body"] == removed["body"])
    return rows.join(removed, same, "left").select("row", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def kept_text(text: str, removed: str = "removed"):
    """The text without its removed lines."""
    lines = F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains(removed, i))
    return F.when(F.size(removed) == 0, F.col(text)).otherwise(F.array_join(lines, "\n"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", site: str = "source", text: str = "text", chars: str | None = "n_chars",
                 **options) -> DataFrame:
    """The columns of ``docs`` with the lines taken out of ``text`` and ``chars`` counted anew; documents left without
    anything but blanks by it are dropped."""
    df = marked(docs, id_col, site, text, **options).withColumn("text", kept_text(f"row.{text}"))
    new = {text: F.col("text"), chars: F.length("text").cast("long")}
    return (df.where((F.size("removed") == 0) | (F.trim(F.translate("text", "\n\t\r", "   ")) != ""))
            .select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns]))
