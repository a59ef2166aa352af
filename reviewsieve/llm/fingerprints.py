"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is its words (lower case, ASCII punctuation and space between them) weighted by how often they occur. For
every sample and word three random numbers follow from a hash alone: r and c from Gamma(2, 1), b from [0, 1). With the
weight w, t = floor(ln w / r + b) quantises the weight, and a = c exp(r (b - t - 1)); the word with the least ln a is the
sample. Two documents pick the same (word, t) with the probability of their generalised Jaccard similarity, the sum of
the lesser weights over the sum of the greater ones. As ln a itself follows from (word, sample, t), it stands for the
pair: a sample is a minimum over doubles, so a fingerprint is one aggregation of the words, combined where they are read.

``with_next`` puts every document together with the next one in descending order of id. Ranges of ids with about as
many rows each come from approximate percentiles of all ids; the bounds are ids of the table, so the row that follows a
range is known by its id, and a copy of it closes the range. Documents are then shuffled once, by range; the
neighbours, the words and the samples are worked out within it, without a further shuffle.

Defined cases: a null text is empty; a text without words has itself as its only word, so only equal ones match (an
empty one, too); null ids come last; repeated ids follow each other by text, each row with its own result; the next
document of the last is the first, of a single one itself; an empty table gives no rows; extra columns are ignored;
very long texts are exploded by distinct word.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewsieve.functions.columns import doubles, let
from reviewsieve.functions.text import counted

SAMPLES, BLOCK = 48, 8  # samples, and how many of them an aggregation row holds
SPLIT = r"[\x00-/:-@\[-`{-\x7F]+"
RANGE_ROWS, MOST_RANGES = 64, 16_384  # the bounds of the ranges travel as one literal, 320 KB at most
NO_ID = -(1 << 63)
LN2 = math.log(2)


def weighted_words(text: Column) -> Column:
    """array<struct<item, n>>: hash and count of every distinct word; the text itself if it has no word."""
    words = F.array_remove(F.split(F.lower(text), SPLIT), "")
    return let(words, lambda w: F.when(F.size(w) > 0, counted(F.transform(w, lambda x: F.xxhash64(x)))).otherwise(
        F.array(F.struct(F.xxhash64(text, F.lit("whole text")).alias("item"), F.lit(1).alias("n")))))


def log_arrival(word: Column, log_weight: Column, sample: int) -> Column:
    """ln a of a word in one sample of a block; ``word`` is its hash there.

    -ln(u v) is Gamma(2, 1) for uniform u and v. One hash gives those of r in 21 bits each, and b in 22; another gives
    those of c in 32 bits each. They are taken in the middle of their steps, so neither is 0 or 1.
    """
    h, g = F.xxhash64(word, F.lit(2 * sample)), F.xxhash64(word, F.lit(2 * sample + 1))
    low = lambda x, bits: x.bitwiseAND(F.lit((1 << bits) - 1))
    r = F.lit(42 * LN2) - F.log((low(h, 21) + 0.5) * (F.shiftrightunsigned(h, 43) + 0.5))
    b = low(F.shiftrightunsigned(h, 21), 22) * 2.0 ** -22
    c = F.lit(64 * LN2) - F.log((low(g, 32) + 0.5) * (F.shiftrightunsigned(g, 32) + 0.5))
    return F.log(c) + r * (b - 1 - F.floor(log_weight / r + b))


def sampled(texts: DataFrame, keys: list[str], text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(keys, samples: array<double>), one row for each row of ``texts``, which ``keys`` tell apart.

    If ``texts`` is partitioned by some of the keys, nothing is shuffled.
    """
    blocks = F.array(*[F.lit(k) for k in range(-(-samples // BLOCK))])
    words = texts.select(*keys, F.explode(weighted_words(F.coalesce(text, F.lit("")))).alias("_w"))
    words = words.select(*keys, "_w.item", F.log("_w.n").alias("_weight"), F.explode(blocks).alias("_block"))
    words = words.withColumn("_word", F.xxhash64("item", "_block"))
    least = words.groupBy(*keys, "_block").agg(*[
        F.min(log_arrival(F.col("_word"), F.col("_weight"), i)).alias(f"_s{i}") for i in range(BLOCK)])
    parts = least.select(*keys, F.struct("_block", F.array(*[f"_s{i}" for i in range(BLOCK)]).alias("s")).alias("_p"))
    whole = parts.groupBy(*keys).agg(F.sort_array(F.collect_list("_p")).alias("_p"))
    return whole.select(*keys, F.slice(F.flatten("_p.s"), 1, samples).alias("samples"))


def fingerprint(samples: Column) -> Column:
    """The samples as text, eight hex digits each."""
    return F.array_join(F.transform(samples, lambda s: F.substring(F.lpad(F.lower(F.hex(F.xxhash64(s))), 16, "0"), 9, 8)), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples: an unbiased estimate of the generalised Jaccard similarity."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, e: n + e)
    return same / F.size(a)


def longs(values: list[int]) -> Column:
    """A constant array, folded to a literal by the optimizer."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def range_number(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are below the key, by bisection."""
    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        below = F.coalesce(F.get(longs(bounds), middle) < key, F.lit(False))
        open_ = s["low"] < s["high"]
        return F.struct(F.when(open_ & below, middle + 1).otherwise(s["low"]).alias("low"),
                        F.when(open_ & ~below, middle).otherwise(s["high"]).alias("high"))

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    return F.aggregate(steps, start, halve, lambda s: s["low"])


def with_next(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with ``range``, ``place`` in it, ``next_text`` and ``guard``.

    Rows are partitioned by range. A guard is the copy of the row after the range, which closes it.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(
        F.col("text").cast("string"), F.lit("")).alias("text"), key.alias("_key"))
    n = keyed.count()
    ranges = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    shares = doubles([k / ranges for k in range(1, ranges)]) if ranges > 1 else doubles([0.5])
    bounds = keyed.agg(F.percentile_approx("_key", shares, max(10_000, 4 * ranges)).alias("b")).first().b or []
    ranged = keyed.withColumn("range", range_number(F.col("_key"), sorted(set(bounds)) or [0]))
    # at most 16,385 rows: the first id of every range, and so the id that follows the range before it
    firsts = ranged.groupBy("range").agg(F.max("_key").alias("_first"))
    down = Window.orderBy(F.desc("range"))
    follows = firsts.select("range", F.coalesce(F.lead("_first").over(down), F.max("_first").over(
        Window.partitionBy(F.lit(0)))).alias("_key"))
    guards = ranged.drop("range").join(F.broadcast(follows), "_key").groupBy("range").agg(F.min("text").alias("text")).select(
        F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("long").alias("_key"), "range", F.lit(True).alias("guard"))
    rows = ranged.withColumn("guard", F.lit(False)).unionByName(guards)
    order = Window.partitionBy("range").orderBy("guard", F.desc("_key"), "text")
    return rows.select("range", "doc_id", "text", "guard", F.row_number().over(order).alias("place"),
                       F.lead("text").over(order).alias("next_text"))


def compare_with_next(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """For every row of ``docs(doc_id, text)``: doc_id, n_chars, the edited text's SHA-256, the fingerprints of the text
    and of the edited one, and the likeness of the text to the edited and to the next one.

    The edited text has its last floor(n_chars / 2) code points replaced by as many of the next text, or all of it.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = with_next(docs).withColumn("n_chars", F.length("text"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - half),
                      F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("_edited", F.when(~F.col("guard"), edited))
    variants = F.when(F.col("guard"), F.array(F.struct(F.lit(0).alias("kind"), F.col("text"), F.lit(None).cast("binary").alias("sha")))).otherwise(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("text"), F.unhex(F.sha2(F.col("_edited").cast("binary"), 256)).alias("sha")),
        F.struct(F.lit(1).alias("kind"), F.col("_edited").alias("text"), F.lit(None).cast("binary").alias("sha"))))
    keys = ["range", "place", "guard", "doc_id", "n_chars"]
    texts = rows.select(*keys, F.explode(variants).alias("v")).select(*keys, "v.kind", "v.sha", "v.text")
    found = sampled(texts, [*keys, "kind", "sha"], samples=samples)
    order = Window.partitionBy("range").orderBy("place", "kind")
    # a text is followed by its edited text, then by the next text
    found = found.select("*", F.lead("samples").over(order).alias("_e"), F.lead("samples", 2).over(order).alias("_n"))
    return found.filter("kind = 0 and not guard").select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.lower(F.hex("sha")).alias("edited_sha256"),
        fingerprint(F.col("samples")).alias("fingerprint"), fingerprint(F.col("_e")).alias("edited_fingerprint"),
        likeness(F.col("samples"), F.col("_e")).alias("near_edited"), likeness(F.col("samples"), F.col("_n")).alias("near_next"))
