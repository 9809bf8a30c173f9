"""SpotSigs document fingerprints in DataFrame functions only.

A signature is a common word (the anchor) with the ``CHAIN`` next content words behind it, hashed to 64 bits; the
fingerprint of a text is the set of its signatures.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import width

# Common words of English, German, French and Spanish.
COMMON_WORDS = (
    "a about after all also an and are as at be been but by can could did do for from had has have he her his how i if in into is it its "
    "more no not of on one or other our out said she so some than that the their them there these they this to up was we were what when "
    "which who will with would you your "
    "aber als am auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im ist mit nach nicht "
    "noch nur oder sein sich sie sind und uns unter vom von vor war wenn wie wir wird zu zum zur über "
    "au aux avec ce ces cette comme dans de du elle en est et il ils je la le les leur lui mais ne nous ont ou par pas plus pour qu que qui "
    "sa se ses son sont sur un une vous été "
    "al con como cuando el ella ellos entre era esta este fue ha hay la las lo los más muy no nos para pero por sin sobre su sus también "
    "te tiene todo una uno y ya"
).split()
CHAIN = 3
STAND_IN = 8
"""One content word in so many (by hash) is an anchor too, for texts that have few common words."""
SPLIT = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPLIT), lambda w: w != "")


def with_signatures(df: DataFrame, text: str, out: str, chain: int = CHAIN) -> DataFrame:
    """Add ``out``, the distinct signatures of ``text`` as an array of longs.

    A text without a whole chain has one signature: its word sequence, or the text itself where it has no word. Null and
    empty texts have none. Cost is linear in the words: the content words in front of an anchor are its place less the
    number of anchors before it, so chains are looked up and not searched for.
    """
    common = sorted(set(COMMON_WORDS))
    df = df.withColumn("_words", words(F.coalesce(text, F.lit(""))))
    df = df.withColumn("_content", F.filter("_words", lambda w: ~w.isin(common))).withColumn(
        "_anchors", F.filter(F.transform("_words", lambda w, i: F.when(w.isin(common), i)), lambda i: i.isNotNull()))
    n = F.size("_content")
    content = lambda k: F.get(F.col("_content"), k)
    spots = F.transform("_anchors", lambda p, j: F.when(
        p - j + chain <= n, F.xxhash64(F.get(F.col("_words"), p), *[content(p - j + k) for k in range(chain)])))
    more = F.transform("_content", lambda w, q: F.when(
        (q + chain < n) & (F.pmod(F.xxhash64(w), F.lit(STAND_IN)) == 0), F.xxhash64(w, *[content(q + 1 + k) for k in range(chain)])))
    df = df.withColumn("_spots", F.array_distinct(F.array_compact(F.concat(spots, more))))
    alone = F.when(F.size("_words") > 0, F.xxhash64("_words")).otherwise(F.xxhash64(text))
    return df.withColumn(out, F.when(F.size("_spots") > 0, F.col("_spots")).when(F.coalesce(F.length(text), F.lit(0)) > 0, F.array(alone))
                         .otherwise(F.array().cast("array<bigint>"))).drop("_words", "_content", "_anchors", "_spots")


def likeness(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets, pruned: 0 where their lengths alone rule ``threshold`` out. Two empty sets are alike."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return (F.when(large == 0, F.lit(1.0)).when(small < threshold * large, F.lit(0.0))
            .otherwise(both / (F.size(a) + F.size(b) - both)))


def digest(signatures: Column) -> Column:
    """128 bits of the set, equal for equal sets, as hexadecimal digits."""
    ordered = F.sort_array(signatures)
    return F.lower(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in (F.xxhash64(ordered), F.xxhash64(F.lit("spots"), ordered))]))


def length_partition(signatures: Column, threshold: float) -> Column:
    """Sets whose lengths allow ``threshold`` are in the same or in neighbouring partitions."""
    return F.floor(F.log(F.greatest(F.size(signatures), F.lit(1))) / math.log(1 / threshold)).cast("int")


def similar_pairs(prints: DataFrame, id_col: str = "doc_id", signatures: str = "signatures", threshold: float = 0.8) -> DataFrame:
    """Pairs ``a`` < ``b`` of class representatives with ``likeness`` of at least ``threshold``.

    Documents of one signature set are a class, represented by the least id, so copies are never paired. Within a
    partition by set length, sets meet under the rare signatures (fewest documents first) of which two sets that
    are alike enough share at least one; candidates are compared once.
    """
    classes = prints.where(F.size(signatures) > 0).groupBy(F.sort_array(signatures).alias("s")).agg(F.min(id_col).alias("id"))
    counts = classes.select(F.explode("s").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    ranked = (classes.select("id", F.size("s").alias("size"), F.explode("s").alias("x")).join(counts, "x")
              .withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy("n", "x")))
              .where((F.col("n") > 1) & (F.col("at") <= F.col("size") - F.ceil(F.col("size") * threshold) + 1)))
    part = F.floor(F.log("size") / math.log(1 / threshold)).cast("int")
    entries = ranked.select("id", "size", "x", "at", part.alias("part"))
    left = entries.select("x", F.explode(F.array("part", F.col("part") + 1)).alias("part"), F.struct("id", "size", "at").alias("l"))
    right = entries.select("x", "part", F.struct("id", "size", "at").alias("r"))
    shared = 1 + F.least(F.col("l.size") - F.col("l.at"), F.col("r.size") - F.col("r.at"))
    enough = F.ceil(threshold / (1 + threshold) * (F.col("l.size") + F.col("r.size")) - 1e-9)
    met = (left.join(right, ["x", "part"]).where((F.col("l.size") <= F.col("r.size")) & (F.col("l.id") != F.col("r.id")) & (shared >= enough))
           .select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct())
    sets = classes.select(F.col("id"), F.col("s"))
    both = met.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return both.select("a", "b", likeness(F.col("sa"), F.col("sb"), threshold).alias("likeness")).where(F.col("likeness") >= threshold)


def with_next(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Add ``next``, a struct of ``columns`` of the document that follows in ascending order of the id (after the last: the first).

    Ids are cut at quantiles into parts of similar size; a window finds the next inside a part, and the first documents
    of the parts (one row each) fill the gap at its end. No window holds the whole table.
    """
    parts = 4 * width(docs.sparkSession)
    cuts = sorted({int(x) for x in docs.approxQuantile(id_col, [k / parts for k in range(1, parts)], 0.2 / parts) or []})
    part = F.when(F.col(id_col).isNull(), 0).otherwise(
        F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in cuts]), lambda x: x <= F.col(id_col)))) if cuts else F.lit(0)
    order = [F.col(id_col).asc_nulls_first(), *[F.col(c) for c in columns]]
    value = F.struct(*columns)
    rows = docs.withColumn("_part", part).repartition(width(docs.sparkSession), "_part")
    inside = rows.withColumn("_next", F.lead(value).over(Window.partitionBy("_part").orderBy(*order)))
    key = F.struct(F.col(id_col).isNotNull(), id_col, *columns)
    firsts = docs.withColumn("_part", part).groupBy("_part").agg(F.min_by(value, key).alias("_first"))
    ring = Window.orderBy("_part")  # one row per part
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("_part", F.coalesce(F.lead("_first").over(ring), F.first("_first").over(whole)).alias("_first"))
    return inside.join(after, "_part", "left").withColumn("next", F.coalesce("_next", "_first")).drop("_part", "_next", "_first")


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document, and how alike they are.

    The edited text has the last quarter of the code points (rounded down) replaced by as many first ones of the next
    document. Null texts are empty; equal ids follow each other by text; a single document is its own next.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    base = with_next(base, "doc_id", ["text"]).select("doc_id", "text", F.col("next.text").alias("next_text"))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    base = base.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter)))
    for column, out in (("text", "signatures"), ("edited", "edited_signatures"), ("next_text", "next_signatures")):
        base = with_signatures(base, column, out)
    return base
