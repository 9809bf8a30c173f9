"""Chat formatting with a grammar whose parser gives back exactly what was rendered.

A turn is ``### role:``, a line feed, the text, and ``</turn>`` on a line of its own. The parser ends a turn at any
``</turn>`` and begins one at the last ``### `` before it. A turn whose plain rendering it would not read back is escaped,
which the header tells by a backslash before the colon: ``### role\\:``. In escaped turns a backslash is ``\\s``,
``</turn>`` is ``\\e``, ``### `` is ``\\h`` and a colon of the role is ``\\c``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

END = "\n</turn>\n"
STOP = "</turn>"
START = "### "
PIECE = rf"(?s)^.*{START}(.*?)(\\)?:\n(.*)\n$"


def escape(x: Column) -> Column:
    for plain, code in (("\\", "\\s"), (STOP, "\\e"), (START, "\\h")):
        x = F.replace(x, F.lit(plain), F.lit(code))
    return x


def unescape(x: Column) -> Column:
    for code, plain in (("\\e", STOP), ("\\h", START), ("\\c", ":"), ("\\s", "\\")):
        x = F.replace(x, F.lit(code), F.lit(plain))
    return x


def header(role: Column, escaped: Column) -> Column:
    return F.concat(F.lit(START), F.when(escaped, F.concat(F.replace(escape(role), F.lit(":"), F.lit("\\c")), F.lit("\\"))).otherwise(role),
                    F.lit(":\n"))


def render(role: Column, text: Column, escaped: Column) -> Column:
    return F.concat(header(role, escaped), F.when(escaped, escape(text)).otherwise(text), F.lit(END))


def parse(formatted: Column) -> Column:
    """Turns of a formatted conversation: array of role, text and whether the turn was escaped."""
    def turn(piece: Column) -> Column:
        part = lambda k: F.regexp_extract(piece, PIECE, k)
        escaped = part(2) != ""
        plain = lambda k: F.when(escaped, unescape(part(k))).otherwise(part(k))
        return F.struct(plain(1).alias("role"), plain(3).alias("text"), escaped.alias("escaped"))

    pieces = F.split(formatted, STOP, -1)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def conflicts(role: Column, text: Column) -> Column:
    """Whether the plain rendering of one turn is read back as anything but that turn."""
    read = parse(render(role, text, F.lit(False)))
    one = F.element_at(read, 1)
    return ~F.coalesce((F.size(read) == 1) & (one["role"] == role) & (one["text"] == text) & ~one["escaped"], F.lit(False))


def formatted(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
              trained: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv``, ``formatted``, ``mask`` and ``identical``.

    ``mask`` has start (from 1), length (code points) and escaping of every text of the ``trained`` role, in order;
    ``identical`` tells that the parser gave back every turn of the source. Null roles and texts are empty, a null
    conversation id is a conversation, turns are ordered by number (null first), then role and text; an empty table
    gives no rows; other columns are not used. Turns of a conversation meet in one row, since that is the output;
    offsets come from a running sum, which spills, so a very long conversation costs its length and no more.
    """
    plain = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"),
                         F.coalesce(text, F.lit("")).alias("text"))
    escaped = plain.withColumn("escaped", conflicts(F.col("role"), F.col("text")))
    made = escaped.withColumn("rendered", render(F.col("role"), F.col("text"), F.col("escaped")))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (made.withColumn("n", F.row_number().over(order)).withColumn("upto", F.sum(F.length("rendered")).over(so_far))
              .withColumn("start", F.col("upto") - F.length("rendered") + F.length(header(F.col("role"), F.col("escaped"))) + 1))
    span = F.struct("n", F.col("start"), (F.col("upto") - F.length(F.lit(END)) - F.col("start") + 1).alias("length"), "escaped")
    whole = placed.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("n", "rendered", "role", "text"))).alias("all"),
        F.sort_array(F.collect_list(F.when(F.col("role") == trained, span))).alias("mask"))
    text_ = whole.select("conv", "mask", "all", F.array_join(F.col("all.rendered"), "").alias("formatted"))
    read = text_.withColumn("read", parse(F.col("formatted")))
    same = (F.col("read.role") == F.col("all.role")) & (F.col("read.text") == F.col("all.text"))
    return read.select(F.col("conv").alias(conv), "formatted",
                       F.transform("mask", lambda m: F.struct(m["start"].alias("start"), m["length"].alias("length"), m["escaped"].alias("escaped"))).alias("mask"),
                       same.alias("identical"))


def masked_texts(formatted_: Column, mask: Column) -> Column:
    """The texts under the loss mask, unescaped, read from the formatted conversation."""
    def one(span: Column) -> Column:
        raw = F.substring(formatted_, span["start"].cast("int"), span["length"].cast("int"))
        return F.when(span["escaped"], unescape(raw)).otherwise(raw)
    return F.transform(mask, one)
