"""Edges of the similarity graph from a threshold on, by a prefix-filtered join instead of all pairs.

Terms are put in one order, rare ones first. If two unit vectors have a cosine of t or more, the parts of them from
their rarest common term on have norms whose product is at least t, so that term stands in the *prefix* of both: the
terms from which on the rest of the vector still has a norm of t. Only prefixes are joined, on (product, term), so a
common term is joined for the few texts that hold little else. A text goes once to each of its prefix terms, vector and
all, and the texts of a term meet in one task, many terms at a time; candidates are never shuffled. A pair is formed at its
rarest common term alone, which makes it unique.

Texts with the same terms and counts are one class, and edges run between classes: a text copied a million times costs one row.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.columns import let, positions
from ..functions.text import counted
from ..session import materialize
from .centrality import NODE, TIE_DIGITS, digest_tokens, text_vectors

GROUP = 4_096  # texts of a block of a term
UNIT = ["product_id", "term", "low", "high"]  # what meets in one task: a term, or two blocks of a frequent one
PAIRS = 100_000  # candidates that a task looks at together
ROWS_OUT = 10_000  # edges in a batch of results
SLACK = 1e-9


def _bag() -> Column:
    """A hash of the terms of ``body`` and their counts; empty for a text without any."""
    bag = counted(digest_tokens(F.col("body")))
    return let(bag, lambda b: F.when(F.size(b) > 0, F.unhex(F.sha2(F.to_json(b), 256))).otherwise(F.lit(b"")))


def text_classes(nodes: DataFrame) -> DataFrame:
    """(product_id, review_id, sent_no, rep_review_id, rep_sent_no): every text with a term, and the smallest text of its
    product with the same terms and counts."""
    keyed = nodes.select(*NODE, _bag().alias("_bag")).filter(F.length("_bag") > 0)
    least = keyed.groupBy("product_id", "_bag").agg(F.min(F.struct(*NODE[1:])).alias("_rep"))
    return keyed.join(least, ["product_id", "_bag"]).select(
        *NODE, F.col("_rep.review_id").alias("rep_review_id"), F.col("_rep.sent_no").alias("rep_sent_no"))


def similarity_edges(nodes: DataFrame, threshold: float = 0.5, group: int = GROUP) -> DataFrame:
    """Pairs of classes of ``nodes(node, body)`` within a product whose cosine, at nine digits, is ``threshold`` or more.

    (product_id, review_id, sent_no, copies, other_review_id, other_sent_no, other_copies, sim), each pair once, the
    smaller representative first. ``copies`` is the size of a class; its members (``text_classes``) are at cosine 1 of
    each other. Texts without a term have no edge; an empty table has none. A term in the prefix of more than ``group`` texts
    is split: its texts are dealt to blocks, and every two blocks meet in a task.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and up to 1")
    vectors = text_vectors(nodes.withColumn("_bag", _bag())).filter(F.length("_bag") > 0).withColumn("id", F.struct(*NODE[1:]))
    classes = materialize(vectors.groupBy("product_id", "_bag").agg(
        F.min("id").alias("id"), F.count("*").alias("copies"), F.min_by("vector", "id").alias("vector")).drop(
            "_bag").withColumn("vector", _once(F.col("vector"))), "text-classes")
    entries = _prefixes(classes, threshold)
    common = _prefixes(classes.filter(F.exists("vector", lambda e: e["df"] > group)), threshold).filter(F.col("df") > group)
    hot = materialize(common.groupBy("product_id", "term").agg(F.count("*").alias("held")).filter(F.col("held") > group),
                      "hot-terms")  # at most one for every ``group`` entries
    blocks = F.ceil(F.coalesce("held", F.lit(1)) / group).cast("int")
    dealt = entries.join(F.broadcast(hot), ["product_id", "term"], "left").withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    sent = dealt.withColumn("met", F.explode(positions(F.col("blocks")))).select(
        "product_id", "term", F.least("block", "met").alias("low"), F.greatest("block", "met").alias("high"), "block",
        "id", "copies", "terms", "ws", "pos", "rest")
    side = [classes.schema["id"], classes.schema["copies"]]
    kind = T.StructType([classes.schema["product_id"], *side, *[T.StructField(f"o_{f.name}", f.dataType) for f in side],
                         T.StructField("sim", T.DoubleType())])
    near = sent.repartition(*UNIT).sortWithinPartitions(*UNIT).mapInArrow(_meetings(kind, threshold), kind)
    found = near.filter((F.round("sim", TIE_DIGITS) >= threshold) & (F.col("id") != F.col("o_id")))
    first = F.col("id") < F.col("o_id")
    both = found.select("product_id", "sim", *[
        F.when(first == straight, F.col(c)).otherwise(F.col(f"o_{c}")).alias(name + c)
        for name, straight in (("", True), ("o_", False)) for c in ("id", "copies")])
    return both.select(
        "product_id", "id.review_id", "id.sent_no", "copies", F.col("o_id.review_id").alias("other_review_id"),
        F.col("o_id.sent_no").alias("other_sent_no"), F.col("o_copies").alias("other_copies"), "sim")


def _once(vector: Column) -> Column:
    """A vector whose terms came from several equal rows of one key, with each term once."""
    def unit(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, e: a + e["w"] * e["w"]))
        return let(norm, lambda n: F.transform(v, lambda e: F.struct(
            e["term"].alias("term"), (e["w"] / n).alias("w"), e["df"].alias("df"))))

    return let(F.array_distinct(vector), lambda v: F.when(F.size(v) == F.size(vector), vector).otherwise(unit(v)))


def _prefixes(classes: DataFrame, threshold: float) -> DataFrame:
    """(product_id, id, copies, terms, ws, pos, term, df, rest): the prefix terms of each vector, rare ones first, with the
    norm and the weights of the vector from there on. Terms that no other text holds only count for the norm."""
    rare_first = F.sort_array(F.transform("vector", lambda e: F.struct(
        e["df"].alias("df"), e["term"].alias("term"), e["w"].alias("w"))))
    rows = classes.select("product_id", "id", "copies", rare_first.alias("v"))

    def step(acc: Column, e: Column) -> Column:
        left = acc["left"] - e["w"] * e["w"]
        return F.struct(left.alias("left"), F.concat(acc["rests"], F.array(acc["left"])).alias("rests"))

    squares = F.aggregate("v", F.lit(0.0), lambda a, e: a + e["w"] * e["w"])
    rests = let(squares, lambda whole: F.aggregate(
        "v", F.struct(whole.alias("left"), F.array().cast("array<double>").alias("rests")), step, lambda acc: acc["rests"]))
    parts = F.arrays_zip(F.col("v.term").alias("term"), F.col("v.w").alias("w"), F.col("v.df").alias("df"), rests.alias("rest"))
    rows = rows.select("product_id", "id", "copies", F.filter(parts, lambda e: e["df"] > 1).alias("v"))
    rows = rows.select("product_id", "id", "copies", F.col("v.term").alias("terms"), F.col("v.w").alias("ws"),
                       F.posexplode("v").alias("pos", "e"))
    return rows.select("product_id", "id", "copies", "terms", F.slice("ws", F.col("pos") + 1, F.size("ws")).alias("ws"), "pos",
                       "e.term", "e.df", F.sqrt(F.greatest("e.rest", F.lit(0.0))).alias("rest")).filter(
                           F.col("rest") >= threshold - SLACK)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole units from a sorted partition, many small ones together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        joint = pa.Table.from_batches([*held[-1:], batch])
        cuts = _starts(joint) - (joint.num_rows - batch.num_rows)
        cut = int(cuts[-1]) if cuts[-1] >= 0 else None  # where the last unit of this batch begins
        if cut is None or not held and not cut:
            held.append(batch)
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _starts(table: pa.Table) -> np.ndarray:
    """First rows of the units."""
    change = np.zeros(table.num_rows - 1, bool)
    for name in UNIT:
        ids = table[name].combine_chunks()
        change |= pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False).astype(bool)
    return np.concatenate([[0], np.flatnonzero(change) + 1])


def _spread(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers begin .. begin + size - 1 of each row, and the row of each."""
    row = np.repeat(np.arange(len(size)), size)
    return np.arange(len(row)) + (begin - (np.cumsum(size) - size))[row], row


class Vectors:
    """Vectors of the rows of a table as flat arrays, without the weights ahead of the row's own term, and their cosines."""

    def __init__(self, table: pa.Table):
        terms, ws = (pa.concat_arrays(table[c].chunks) for c in ("terms", "ws"))
        code = terms.flatten().dictionary_encode()
        self.term, self.codes = code.indices.to_numpy().astype(np.int64), len(code.dictionary)
        self.size, weighed = (a.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for a in (terms, ws))
        self.begin = np.cumsum(self.size) - self.size
        self.w = np.zeros(len(self.term))
        self.w[_spread(self.begin + self.size - weighed, weighed)[0]] = ws.flatten().to_numpy(zero_copy_only=False)
        key = np.repeat(np.arange(len(self.size)), self.size) * self.codes + self.term
        order = np.argsort(key)
        self.key, self.weight = key[order], self.w[order]
        if (self.key[1:] == self.key[:-1]).any():
            raise ValueError("different texts have the same product_id, review_id and sent_no")

    def cosines(self, one: np.ndarray, other: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Dot products of pairs of rows; 0 if they have a common term ahead of ``pos`` of the one."""
        at, pair = _spread(self.begin[one], self.size[one])
        wanted = other[pair] * self.codes + self.term[at]
        place = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        hit = self.key[place] == wanted
        at, pair, place = at[hit], pair[hit], place[hit]
        early = at < (self.begin[one] + pos[one])[pair]
        dot = np.bincount(pair, self.w[at] * self.weight[place], len(one))
        dot[pair[early]] = 0.0
        return dot


def _meetings(kind: T.StructType, threshold: float):
    """Function for mapInArrow: the pairs of each unit whose rarest common term is that of the unit."""
    shape = to_arrow_schema(kind)

    def run(batches):
        for table in _units(batches):
            starts = _starts(table)
            size = np.diff(np.append(starts, table.num_rows))
            if size.max() < 2:
                continue
            vectors = Vectors(table)
            pos, rest, block, low, high = (
                table[c].to_numpy() for c in ("pos", "rest", "block", "low", "high"))
            rows = np.arange(table.num_rows)
            later = np.repeat(starts + size, size) - rows - 1
            step = np.cumsum(later) // PAIRS
            for begin, end in zip(*(np.searchsorted(step, np.unique(step), side) for side in ("left", "right"))):
                other, one = _spread(rows[begin:end] + 1, later[begin:end])
                one += begin
                kept = (rest[one] * rest[other] >= threshold - SLACK) & ((low[one] == high[one]) | (block[one] != block[other]))
                one, other = one[kept], other[kept]
                sim = vectors.cosines(one, other, pos)
                near = sim >= threshold - SLACK
                one, other = pa.array(one[near]), pa.array(other[near])
                if len(one):
                    columns = [table["product_id"].take(one), *[table[c].take(k) for k in (one, other) for c in ("id", "copies")],
                               pa.array(sim[near])]
                    yield from pa.table(columns, names=shape.names).cast(shape).combine_chunks().to_batches(max_chunksize=ROWS_OUT)
    return run
