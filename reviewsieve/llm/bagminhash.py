"""Near-duplicates by BagMinHash over bags of five-word shingles.

A document is a bag (multiset) of shingles. Each shingle owns a Poisson process over time and weight: the weight axis
is cut at powers of two, every dyadic interval has a process of its own whose rate is its length, and a point counts
for a document if it lies below the shingle's weight there. A register keeps the earliest of the points dealt to it;
two documents agree in a register with the probability of their weighted Jaccard similarity. Points are drawn in
rounds, and a process ends as soon as its time passes the latest register, so most shingles draw one point.

Registers are banded; documents that share a band are candidates, and a candidate pair is a link if the multisets
overlap enough. Exact copies (equal word sequences) are one node. Classes are the connected components of the links.

To lose no link without emitting the pairs of a group: first, in a few rounds, the members of each group are compared
with the group's most central member, which joins most of a family of copies. Groups that still hold several components
are gathered by their central member, and each of their members outside the largest component is held against all
others through an inverted index of shingles, in tasks of two blocks of about 2,048 nodes at most. Only links leave these tasks.
Pairs inside a component are not looked at, since they cannot change it.

Bands and pairs carry 16-byte hashes; texts are fetched only for the nodes in candidate pairs. Intermediate
tables are written below ``spark.checkpoint.dir``.

Defined cases: texts without words (null, empty) are classes of their own; a text of one to four words is one shingle;
the class id is the smallest doc_id of the class (null if all are null); repeated rows are copies of one node; an empty
table gives no rows; result columns replace columns of that name.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewsieve.session import materialize

from .common import WORD_TABLE, chunks, schema

SHINGLE = 5
THRESHOLD = (4, 5)     # similarity of 0.8 or more, as a fraction
REGISTERS = 128
ROUNDS = 3             # of comparisons with central members
BLOCK = 2048           # nodes of one side in a task of the last comparison
ROWS = 4               # registers of a band; at similarity 0.8 a pair shares no band with probability 5e-8
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, _U)
_inverse = np.ones(1, _U)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 1 << 19)
        for name, base in (("_powers", _BASE), ("_inverse", pow(_BASE, -1, 1 << 64))):
            values = np.full(size, base, _U)
            values[0] = 1
            globals()[name] = np.cumprod(values)


def word_hashes(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of normalised texts, and the number of each word's text."""
    blob = np.frombuffer(b" ".join(blobs) + b" ", np.uint8)
    _grow(len(blob) + 1)
    inside = blob != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(blob.astype(_U) * _powers[:len(blob)])))
    hashes = _mix((sums[ends] - sums[starts]) * _inverse[starts] + (ends - starts).astype(_U))
    offsets = np.cumsum([len(b) + 1 for b in blobs])
    return hashes, np.searchsorted(offsets, starts, side="right")


def bags(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: number of the text, hash, weight; by text and hash."""
    hashes, owner = word_hashes(blobs)
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)
    last = max(0, len(hashes) - SHINGLE + 1)
    shingles = np.zeros(last, _U)
    for k in range(SHINGLE):
        shingles = shingles * _U(0xD6E8FEB86659FD93) + hashes[k:k + last]
    whole = owner[:last] == owner[SHINGLE - 1:SHINGLE - 1 + last]
    shingles, texts = _mix(shingles[whole]), owner[:last][whole]
    sizes = np.bincount(owner, minlength=len(blobs))
    first = np.concatenate(([0], np.cumsum(sizes)))
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if len(short):
        more = np.zeros(len(short), _U)
        for k in range(SHINGLE - 1):
            there = sizes[short] > k
            more[there] = more[there] * _U(0xD6E8FEB86659FD93) + hashes[first[short[there]] + k]
        shingles = np.concatenate((shingles, _mix(more ^ _U(0x5851F42D4C957F2D))))
        texts = np.concatenate((texts, short))
    order = np.lexsort((shingles, texts))
    shingles, texts = shingles[order], texts[order]
    new = np.flatnonzero(np.concatenate(([True], (shingles[1:] != shingles[:-1]) | (texts[1:] != texts[:-1]))))
    return texts[new], shingles[new], np.diff(np.concatenate((new, [len(shingles)])))


def signatures(texts: np.ndarray, shingles: np.ndarray, weights: np.ndarray, n: int,
               registers: int = REGISTERS) -> np.ndarray:
    """Earliest point of each register, as the bits of its time: n x registers."""
    times = np.full((n, registers), np.inf)
    # the dyadic intervals that reach below the weight: (0, 1], (1, 2], (2, 4], ...
    owner, process, low, length, weight = [texts], [_mix(shingles)], [np.zeros(len(texts))], [np.ones(len(texts))], [weights]
    bound = 1
    heavy = np.flatnonzero(weights > 1)
    while len(heavy):
        owner.append(texts[heavy])
        process.append(_mix(shingles[heavy] + _U(bound * 2)))
        low.append(np.full(len(heavy), float(bound)))
        length.append(np.full(len(heavy), float(bound)))
        weight.append(weights[heavy])
        bound *= 2
        heavy = heavy[weights[heavy] > bound]
    owner, process, low, length, weight = map(np.concatenate, (owner, process, low, length, weight))
    time = np.zeros(len(owner))
    count = 0
    while len(owner):
        count += 1
        draw = _mix(process + _U(count * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((draw >> _U(11)).astype(np.float64) + 1.0) * 2.0 ** -53) / length
        second = _mix(draw ^ _U(0xA0761D6478BD642F))
        place = low + (second >> _U(11)).astype(np.float64) * 2.0 ** -53 * length
        counts = place < weight
        register = (second & _U(0x7FF)).astype(np.int64) % registers
        np.minimum.at(times.reshape(-1), owner[counts] * registers + register[counts], time[counts])
        going = time < times.max(axis=1)[owner]
        if not going.all():
            owner, process, low, length, weight, time = (
                x[going] for x in (owner, process, low, length, weight, time))
    return times.view(np.uint64)


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    out = np.zeros((signature.shape[0], signature.shape[1] // rows), _U)
    for k in range(rows):
        out = _mix(out * _U(0xD6E8FEB86659FD93) + signature[:, k::rows][:, :out.shape[1]])
    return _mix(out + np.arange(out.shape[1], dtype=_U)).view(np.int64)


def normalised(text: str) -> bytes:
    return b" ".join(text.encode().translate(WORD_TABLE).split())


def _node(blob: bytes) -> bytes | None:
    return hashlib.md5(blob).digest() if blob else None


@F.pandas_udf(schema(node=T.BinaryType(), size=T.LongType(), bands=T.ArrayType(T.LongType())))
def _sign(texts: pd.Series) -> pd.DataFrame:
    nodes, sizes, keys = [], [], []
    for part in chunks(texts):
        blobs = [normalised(t) for t in part]
        owner, shingles, weights = bags(blobs)
        found = bands(signatures(owner, shingles, weights, len(blobs)))
        sizes += np.bincount(owner, weights, minlength=len(blobs)).astype(int).tolist()
        nodes += [_node(b) for b in blobs]
        keys += [k if b else None for k, b in zip(found, blobs)]
    return pd.DataFrame({"node": pd.Series(nodes, dtype=object), "size": pd.Series(sizes, dtype="int64"),
                         "bands": pd.Series(keys, dtype=object)})


@F.pandas_udf(T.BinaryType())
def node_of(texts: pd.Series) -> pd.Series:
    """Identity of a text's word sequence; null for texts without words."""
    return pd.Series([_node(normalised(t)) if t else None for t in texts], dtype=object)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """Sizes of the intersection and the union of two bags."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    return shared, int(a[1].sum() + b[1].sum()) - shared


def _pairs_of_bags(left: pd.Series, right: pd.Series):
    """The bags of both texts of each row; a text that stands in many rows is shingled once per 64 rows."""
    for at in range(0, len(left), 64):
        a, b = left.iloc[at:at + 64].tolist(), right.iloc[at:at + 64].tolist()
        number = {t: k for k, t in enumerate(dict.fromkeys(a + b))}
        texts, shingles, weights = bags([normalised(t) for t in number])
        cuts = np.searchsorted(texts, np.arange(len(number) + 1))
        own = [(shingles[s:e], weights[s:e]) for s, e in zip(cuts[:-1], cuts[1:])]
        yield from ((own[number[x]], own[number[y]]) for x, y in zip(a, b))


@F.pandas_udf(schema(shared=T.LongType(), united=T.LongType()))
def _compare(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([overlap(x, y) for x, y in _pairs_of_bags(left, right)], columns=["shared", "united"])


def elements(bag: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The bag as a set: each copy of a shingle is an element of its own."""
    shingles, weights = bag
    which = np.repeat(np.arange(len(weights)), weights)
    copy = np.arange(len(which)) - np.repeat(np.cumsum(weights) - weights, weights)
    return _mix(shingles[which] + copy.astype(_U) * _U(0xE7037ED1A0B428DB))


def block_links(left: pd.DataFrame, right: pd.DataFrame, threshold: tuple[int, int]) -> pd.DataFrame:
    """Links between the rows of both sides that are in one unit and have different labels."""
    top, bottom = threshold
    out: list[tuple[bytes, bytes]] = []
    units = dict(list(right.groupby("unit")))
    for unit, asked in left.groupby("unit"):
        if unit not in units:
            continue
        others = units[unit]
        sets = [[elements(b) for b in _bags_of(side["text"])] for side in (asked, others)]
        sizes = np.array([len(e) for e in sets[1]])
        everything = np.concatenate(sets[1])
        order = np.argsort(everything, kind="stable")
        holder, everything = np.repeat(np.arange(len(sizes)), sizes)[order], everything[order]
        labels, nodes = others["label"].to_numpy(), others["node"].to_numpy()
        for node, label, own in zip(asked["node"], asked["label"], sets[0]):
            low, high = np.searchsorted(everything, own, "left"), np.searchsorted(everything, own, "right")
            n = high - low
            places = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
            shared = np.bincount(holder[places], minlength=len(sizes))
            for k in np.flatnonzero(shared * (top + bottom) >= top * (len(own) + sizes)):
                if labels[k] != label:
                    out.append((min(node, nodes[k]), max(node, nodes[k])))
    return pd.DataFrame(sorted(set(out)), columns=["a", "b"])


def _bags_of(texts: pd.Series) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for part in chunks(texts):
        owner, shingles, weights = bags([normalised(t) for t in part])
        cuts = np.searchsorted(owner, np.arange(len(part) + 1))
        out += [(shingles[s:e], weights[s:e]) for s, e in zip(cuts[:-1], cuts[1:])]
    return out


def is_link(threshold: tuple[int, int] = THRESHOLD) -> Column:
    return F.col("shared") * threshold[1] >= F.col("united") * threshold[0]


def components(links: DataFrame) -> DataFrame:
    """(node, label) of the nodes in the links (a, b); the label is the smallest node of the component.

    Each round takes the smallest label among a node and its neighbours, then the label of that label, so chains
    shorten by half. A round is one written table.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "link-ends")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")),
                         "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select(
            "node", "label", F.least("label", "near").alias("low"))
        above = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        moved = materialize(lower.join(above, F.col("low") == F.col("_n"), "left").select(
            "node", "label", F.least("low", F.coalesce("_l", "low")).alias("next")), "labels")
        if moved.filter(F.col("label") != F.col("next")).isEmpty():
            return labels
        labels = moved.select("node", F.col("next").alias("label"))


def link_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row per distinct word sequence: node, smallest id, rows with that id, rows, and the class's label."""
    signed = docs.select(F.col(id_col).alias("id"), _sign.asNondeterministic()(F.col(text_col)).alias("s"))
    rows = signed.filter("s.node is not null").groupBy(F.col("s.node").alias("node"), "id").agg(
        F.count("*").alias("n"), F.first("s.size").alias("size"), F.first("s.bands").alias("bands"))
    nodes = materialize(rows.groupBy("node").agg(
        F.min(F.struct(F.col("id").isNull(), "id", "n")).alias("k"), F.sum("n").alias("n"), F.first("size").alias("size"),
        F.first("bands").alias("bands")).select(
        "node", F.col("k.id").alias("id"), F.col("k.n").alias("copies"), "n", "size", "bands"), "nodes")
    keyed = nodes.select("node", "size", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key")
    members = materialize(keyed.join(shared, "key"), "members")

    candidates = members.select("node").distinct()
    texts = docs.select(F.col(text_col).alias("text"), node_of.asNondeterministic()(F.col(text_col)).alias("node"))
    texts = materialize(texts.join(candidates, "node").groupBy("node").agg(F.first("text").alias("text")),
                        "candidate-texts")

    def with_texts(pairs: DataFrame) -> DataFrame:
        return (pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b"))

    labels, tested = None, None

    def mixed_members() -> DataFrame:
        """Members of the groups that hold several components, with their label and the group's largest one."""
        placed = members.withColumn("label", F.col("node")) if labels is None else (
            members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
        shares = placed.groupBy("key", "label").agg(F.count("*").alias("m"))
        largest = shares.groupBy("key").agg(
            F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("m"), F.count("*").alias("labels"))
        return placed.join(largest.filter("labels > 1").select("key", "m", F.col("top.label").alias("largest")), "key")

    def central(pool: DataFrame) -> DataFrame:
        """The member of each group that is in the largest groups altogether: the closest to what they share."""
        known = pool.groupBy("node").agg(F.sum("m").alias("standing"), F.first("label").alias("label"))
        return pool.select("key", "node").join(known, "node").groupBy("key").agg(
            F.max(F.struct("standing", "node", "label")).alias("lead"))

    def merge(links: DataFrame) -> DataFrame:
        if labels is not None:
            links = links.union(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
        return components(links)

    for number in range(ROUNDS):
        open_members = materialize(mixed_members(), "open-members")
        leads = central(open_members if not number else open_members.filter("label != largest"))
        pairs = open_members.join(leads, "key").filter("label != lead.label").select(
            F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        compared = materialize(with_texts(pairs).withColumn(
            "c", _compare.asNondeterministic()("text_a", "text_b")).select("a", "b", "c.shared", "c.united"), "pairs")
        tested = compared.select("a", "b") if tested is None else tested.union(compared.select("a", "b"))
        links = compared.filter(is_link(threshold)).select("a", "b")
        if links.isEmpty():
            break
        labels = merge(links)

    # What may still be missing: between components that share a group.
    open_members = mixed_members()
    family = open_members.join(central(open_members).select("key", F.col("lead.node").alias("family")), "key").groupBy(
        "family", "node").agg(F.first("label").alias("label"))
    family = materialize(family, "families")
    shares = family.groupBy("family", "label").agg(F.count("*").alias("m")).groupBy("family").agg(
        F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("m"))
    asked, others = dealt_to_tasks(family.join(shares.select("family", F.col("top.label").alias("largest"), "m", (
        F.col("m") - F.col("top.m")).alias("outside")), "family"), family.count())
    columns = ["task", "unit", "node", "label", "text"]
    asked, others = (side.join(texts, "node").select(columns).toDF(*columns) for side in (asked, others))
    links = asked.groupBy("task").cogroup(others.groupBy("task")).applyInPandas(
        lambda left, right: block_links(left, right, threshold), "a binary, b binary")
    links = materialize(links, "late-links")
    if not links.isEmpty():
        labels = merge(links)
    plain = nodes.select("node", "id", "copies", "n")
    if labels is None:
        return plain.withColumn("label", F.col("node"))
    return plain.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def dealt_to_tasks(family: DataFrame, n: int, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Units (family, block of outside members, block of members) of the last comparison, and the task of each: rows of
    the members outside the largest component, and of all members, as (task, unit, node, label). Both sides are cut into
    blocks of about ``size`` by their own number. A unit of a larger family is a task of its own; families of a single
    unit share tasks, ``n`` rows in all.
    """
    cut = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / size)).cast("long")
    sized = family.withColumn("_a", cut("outside")).withColumn("_b", cut("m"))
    block = lambda c: F.pmod(F.xxhash64("node"), F.col(c))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)).alias("_other")
    small = F.pmod(F.xxhash64("family"), F.lit(max(1, n // 256)))

    def side(rows: DataFrame, own: str, other: str) -> DataFrame:
        place = (block(own), F.col("_other")) if own == "_a" else (F.col("_other"), block(own))
        dealt = rows.select("*", each(other)).withColumn("unit", F.xxhash64("family", *place))
        return dealt.select(F.when((F.col("_a") == 1) & (F.col("_b") == 1), small).otherwise(F.col("unit")).alias("task"),
                            "unit", "node", "label")

    return side(sized.filter("label != largest"), "_a", "_b"), side(sized.filter("outside > 0"), "_b", "_a")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row per document: id, class_id (smallest id of the class), class_size (documents)."""
    classes = materialize(link_classes(docs, id_col, text_col, threshold), "classes")
    sizes = classes.groupBy("label").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_size"))
    by_node = classes.select("node", "label").join(sizes, "label").select(
        F.col("node").alias("_node"), "class_id", "class_size")
    placed = docs.select(F.col(id_col), node_of.asNondeterministic()(F.col(text_col)).alias("_text_node"))
    return placed.join(by_node, F.col("_text_node") == F.col("_node"), "left").select(
        F.col(id_col), F.when(F.col("_node").isNull(), F.col(id_col)).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One document of each class: the one with the smallest id (a null id after all). Documents without words stay."""
    classes = materialize(link_classes(docs, id_col, text_col, threshold), "classes")
    best = classes.groupBy("label").agg(F.min(F.struct(F.col("id").isNull(), "id", "node", "copies")).alias("k"))
    keep = materialize(best.select(F.col("k.node").alias("_keep_node"), F.col("k.id").alias("_keep_id"),
                                   F.col("k.copies").alias("_copies")), "keep")
    marked = docs.withColumn("_node", node_of.asNondeterministic()(F.col(text_col)))
    joined = marked.join(keep, (F.col("_node") == F.col("_keep_node")) & F.col(id_col).eqNullSafe(F.col("_keep_id")),
                         "left")
    kept = joined.filter("_node is null or _copies = 1")
    if not keep.filter("_copies > 1").isEmpty():  # rows repeated as they are: any one of them
        kept = kept.union(joined.filter("_copies > 1").dropDuplicates(["_node", id_col]))
    return kept.select(*docs.columns)
