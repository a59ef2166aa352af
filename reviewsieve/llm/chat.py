"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. Every turn is rendered as it is and read back by the parser; where
the recovered turn differs from the source, its content is escaped, which makes the two identical: a control string in
a text gets a backslash after its ``<``, and one that has backslashes already gets one more. In roles ``%``, line
breaks and ``<`` are percent-encoded. The whole conversation is then parsed again from the output.

Defined cases: null roles and texts count as empty; turns are ordered by turn, role and text (null turns first), so
repeated and tied rows have one order; a null conversation id is a conversation; extra columns are ignored.
A conversation is one output row, so its turns meet in one task, no more than that.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewsieve.functions.columns import let, positions

START, END = "<|im_start|>", "<|im_end|>"
STRETCH = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|im_(start|end)\|>", r"<$1\\|im_$2|>")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|im_(start|end)\|>", r"<$1|im_$2|>")


def escape_role(role: Column) -> Column:
    for old, new in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(old), F.lit(new))
    return role


def unescape_role(role: Column) -> Column:
    for old, new in (("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(new), F.lit(old))
    return role


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """Turns of a rendered text: role and text, and both as they stand in the output."""
    pieces = F.split(formatted, r"<\|im_start\|>")
    head = lambda p: F.substring_index(p, "\n", 1)
    body = lambda p: F.substring_index(F.substr(p, F.length(head(p)) + 2), END, 1)
    return F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.struct(
        unescape_role(head(p)).alias("role"), unescape(body(p)).alias("text"),
        head(p).alias("raw_role"), body(p).alias("raw_text")))


def render(turns: DataFrame) -> DataFrame:
    """Add ``rendered`` and ``escaped`` to each turn: as it is if it parses back to itself, else with escapes."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    plain = render_turn(role, text)
    back = parse(plain)
    same = (F.size(back) == 1) & (F.get(back, F.lit(0))["role"] == role) & (F.get(back, F.lit(0))["text"] == text)
    return (turns.withColumn("_plain", plain).withColumn("escaped", ~same)
            .withColumn("rendered", F.when(F.col("escaped"), render_turn(escape_role(role), escape(text)))
                        .otherwise(F.col("_plain"))).drop("_plain"))


def running(sizes: Column) -> Column:
    """Running sums of an array<int>, in stretches of ``STRETCH``, so that no long array is copied value by value."""
    def sums(values: Column, first: Column) -> Column:
        return F.aggregate(values, F.array().cast("array<int>"), lambda acc, v: F.concat(acc, F.array(
            v + F.when(F.size(acc) > 0, F.element_at(acc, -1)).otherwise(first))))

    total = lambda values: F.aggregate(values, F.lit(0), lambda a, v: a + v)
    pieces = F.transform(positions(F.ceil(F.size(sizes) / STRETCH).cast("int")), lambda k: F.slice(sizes, k * STRETCH + 1, F.lit(STRETCH)))
    return let(pieces, lambda p: let(sums(F.transform(p, total), F.lit(0)), lambda until: F.flatten(
        F.transform(p, lambda values, k: sums(values, F.when(k == 0, 0).otherwise(F.get(until, k - 1)))))))


def format_conversations(turns: DataFrame, masked_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``formatted``, the turns parsed back from it, the loss mask (code point spans of the
    masked role's texts in ``formatted``), the number of escaped turns, and whether the round trip is identical."""
    shaped = render(turns.select("conv_id", "turn", "role", "text")).select(
        "conv_id", F.struct("turn", F.coalesce(F.col("role"), F.lit("")).alias("role"),
                            F.coalesce(F.col("text"), F.lit("")).alias("text"), "rendered", "escaped").alias("t"))
    grouped = shaped.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("source"))
    out = grouped.select("conv_id", F.array_join(F.col("source.rendered"), "").alias("formatted"), "source")
    out = out.withColumn("turns", parse(F.col("formatted")))
    pair = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    def masked(turns: Column, ends: Column) -> Column:
        """Spans of the masked role's texts, from where each turn ends in the output."""
        spans = F.zip_with(turns, ends, lambda t, end: F.when(t["role"] == masked_role, F.struct(
            (end - len(END) - 1 - F.length(t["raw_text"])).alias("start"), (end - len(END) - 1).alias("end"))))
        return F.filter(spans, lambda s: s.isNotNull())

    size = lambda t: len(START) + F.length(t["raw_role"]) + 1 + F.length(t["raw_text"]) + len(END) + 1
    mask = let(F.transform("turns", size), lambda sizes: masked(F.col("turns"), running(sizes)))
    return (out.withColumn("loss_mask", mask)
            .withColumn("escaped_turns", F.size(F.filter(F.col("source"), lambda t: t["escaped"])))
            .withColumn("round_trip", F.transform(F.col("source"), pair) == F.transform(F.col("turns"), pair))
            .drop("source"))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda s: unescape(
        F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
