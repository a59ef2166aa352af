"""Centrality of texts within their product: PageRank over cosine similarity, without the graph.

The similarity of two texts is the dot product of their TF-IDF vectors, so the
product of the similarity matrix with any vector q is, per text i,

    sum over terms t of  w_it * (Q_t - w_it * q_i)   with   Q_t = sum over texts k of w_kt * q_k

(the subtraction removes the text itself, i.e. the zero diagonal). Each step is
linear in the number of (text, term) entries; pairs of texts are never formed.
A text none of whose terms occurs in another text of its product has no
neighbour; its rank is spread evenly over the product.
"""
from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.storagelevel import StorageLevel

from .. import lexicons as lx
from ..functions.columns import let
from ..functions.text import counted
from ..session import discard, materialize

NODE = ["product_id", "review_id", "sent_no"]
BLOCK_TOKENS = 200_000  # tokens and texts of a block, which a task holds (some 10 MB)
WHOLE_TOKENS = 8_000_000  # up to so many a product is one block, which a task holds without writing it (some 100 bytes each)
ROWS_OUT = 10_000  # texts in a batch of results
ROOM = 20_000  # texts of small products that are ranked side by side
LOOKS = 6  # steps at most between looks whether any product still moves; a settled block stays as it is
TOGETHER = 10_000_000  # tokens and texts up to which so many steps are one job; shuffle files go at its end
PART_TOKENS = 1_000_000  # tokens and texts of the blocks that stand side by side in a task
BIN_TOKENS = 1_000_000  # tokens and texts of a product for each bin of terms
TIE_DIGITS = 9


def digest_tokens(text: Column, stopwords: Sequence[str] = tuple(lx.DIGEST_STOPWORDS)) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(lx.DIGEST_TOKEN), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(list(stopwords)))


def text_vectors(nodes: DataFrame, stopwords: Sequence[str] = tuple(lx.DIGEST_STOPWORDS)) -> DataFrame:
    """TF-IDF vectors of ``nodes(product_id, review_id, sent_no, body)`` within each product.

    Adds ``n`` (texts of the product), ``tokens`` (its tokens after stop words)
    and ``vector``: array<struct<term, w, df>>, L2-normalised.
    """
    tokenised = nodes.withColumn("_t", counted(digest_tokens(F.col("body"), stopwords))).drop("body")
    size = F.aggregate("_t", F.lit(0).cast("bigint"), lambda a, e: a + e["n"])
    sizes = tokenised.groupBy("product_id").agg(F.count("*").alias("n"), F.sum(size).alias("tokens"))
    entries = tokenised.select(*NODE, F.explode("_t").alias("e")).select(*NODE, "e.item", "e.n")
    df = entries.groupBy("product_id", "item").agg(F.count("*").alias("df"))
    # the terms of one text come together again: bounded by the text
    vectors = entries.join(df, ["product_id", "item"]).groupBy(*NODE).agg(
        F.sort_array(F.collect_list(F.struct("item", "n", "df"))).alias("_e"))
    joined = tokenised.drop("_t").join(vectors, NODE, "left").join(sizes, "product_id")

    def weigh(entries_: Column, n: Column) -> Column:
        raw = F.transform(entries_, lambda e: F.struct(
            e["item"].alias("term"),
            ((1 + F.log(e["n"])) * (F.log((1 + n) / (1 + e["df"])) + 1)).alias("w"), e["df"].alias("df")))
        return let(raw, lambda r: let(
            F.sqrt(F.aggregate(r, F.lit(0.0), lambda a, e: a + e["w"] * e["w"])),
            lambda norm: F.transform(r, lambda e: F.struct(
                e["term"].alias("term"), (e["w"] / norm).alias("w"), e["df"].alias("df")))))

    vector = F.when(F.col("_e").isNotNull(), weigh(F.col("_e"), F.col("n"))).otherwise(
        F.array().cast("array<struct<term:string,w:double,df:bigint>>"))
    return joined.withColumn("vector", vector).drop("_e")


def linked_terms(vectors: DataFrame) -> DataFrame:
    """Vectors cut to the terms that occur in another text of the product: the others link nothing."""
    shared = F.filter("vector", lambda e: e["df"] > 1)
    return vectors.withColumn("vector", F.transform(
        shared, lambda e: F.struct(e["term"].alias("term"), e["w"].alias("w"))))


def pull(nodes: DataFrame, q: str, keep: Sequence[str] = (), name: str = "pull") -> DataFrame:
    """(node, name): similarity matrix times column ``q``, from ``nodes(node, vector, q)``."""
    entries = nodes.select(*NODE, q, F.explode("vector").alias("e")).select(*NODE, q, "e.term", "e.w")
    sums = entries.groupBy("product_id", "term").agg(F.sum(F.col("w") * F.col(q)).alias("_sum"))
    return entries.join(sums, ["product_id", "term"]).groupBy(*NODE).agg(
        F.sum(F.col("w") * (F.col("_sum") - F.col("w") * F.col(q))).alias(name))


def similarity_sums(nodes: DataFrame) -> DataFrame:
    """(node, sim_sum): total similarity of every text to the others of its product; 0 without neighbours."""
    vectors = linked_terms(text_vectors(nodes)).withColumn("_one", F.lit(1.0))
    return vectors.select(*NODE).join(pull(vectors, "_one", name="sim_sum"), NODE, "left").withColumn(
        "sim_sum", F.coalesce("sim_sum", F.lit(0.0)))


# ------------------------------------------------------------------ terms of texts as flat arrays
def _counted(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Distinct terms of each text (strings of tokens): how many a text has, their numbers and counts; and the terms."""
    found = pc.split_pattern(texts.combine_chunks(), " ")
    item = found.flatten().dictionary_encode()
    term, names = item.indices.to_numpy().astype(np.int64), item.dictionary
    row = np.repeat(np.arange(len(found)), found.value_lengths().to_numpy())
    blank = pc.index(names, "").as_py()  # of texts without tokens
    key = (row * len(names) + term)[term != blank]
    key, count = np.unique(key, return_counts=True)
    row, term = np.divmod(key, max(len(names), 1))
    return np.bincount(row, minlength=len(found)), term, count, names


def _same_keys(table: pa.Table, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows, equal ones for equal keys, which stand side by side; and which rows have a key."""
    keyed = np.ones(table.num_rows, bool)
    for name in NODE[1:]:
        ids = table[name].combine_chunks()
        keyed &= ids.is_valid().to_numpy(zero_copy_only=False)
        change = change | pc.fill_null(pc.not_equal(ids[1:], ids[:-1]), True).to_numpy(zero_copy_only=False)
    return np.append(0, np.cumsum(change)), keyed


def _joint(lengths: np.ndarray, group: np.ndarray, keyed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of the vectors, (row, place in the terms): a text has the terms of all rows with its keys, none without a key."""
    begin = np.append(0, np.cumsum(lengths))
    first = np.append(0, np.flatnonzero(np.diff(group)) + 1)
    last = np.append(first[1:], len(group))
    size = np.where(keyed, (begin[last] - begin[first])[group], 0)
    at = np.repeat(begin[first][group] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return np.repeat(np.arange(len(group)), size), at


# ------------------------------------------------------------------ ranks and picks, block by block
def _pack(facts) -> bytes:
    raw = pickle.dumps(facts, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: bytes):
    return pickle.loads(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True))


def _narrow(numbers: np.ndarray) -> np.ndarray:
    return numbers.astype(np.min_scalar_type(int(numbers.max()) if len(numbers) else 0))


class Part:
    """The blocks of a task side by side: their vectors, which stay, and the numbers of a step of the walk, which go on.

    Texts and terms are numbered over all products of the part, so a step is a few sums, however many blocks there are. What
    it needs of the other parts are sums over all of them: of w q per term, the rank of texts without neighbours, and how far
    the last step moved. A part sends one message for each cell, that is a bin of terms of a product; the two other numbers
    are a bin of their own, the last. Terms stand by cells, and within them by their number in the product.
    Weights are put together from counts, ``df`` and ``norm``, which take less room.
    """

    FACTS = ("products", "n", "bins", "texts", "cells", "code", "lengths", "term", "count", "df", "norm", "sums", "squares")

    def __init__(self, facts: dict):
        self.__dict__.update(facts)
        self.m = len(self.lengths)
        self.node = np.repeat(np.arange(self.m), self.lengths)
        self.linked = self.lengths > 0
        self.product = np.repeat(np.arange(len(self.products)), self.texts)
        scale = 1 + np.log(np.arange(1, self.count.max(initial=1) + 1))
        n = np.repeat(self.n[self.cells[0]], self.cells[2])
        idf = np.log((1 + n) / (1 + self.df.astype(np.int64))) + 1
        self.w = scale[self.count - 1] * idf[self.term] / self.norm[self.node]

    @staticmethod
    def start(group: pa.Table) -> tuple[dict, pa.Array, list[tuple]]:
        """From the sorted rows of one part: what is known of it, the ids, and for each cell the names of its terms with their texts."""
        ids = group["product_id"].combine_chunks()
        change = pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False).astype(bool)
        first = np.append(0, np.flatnonzero(change) + 1)
        texts = np.diff(np.append(first, len(ids)))
        lengths, term, count, names = _counted(group["_t"])
        crc = np.array([zlib.crc32(t.encode()) for t in names.to_pylist()], np.int64)
        product = np.repeat(np.repeat(np.arange(len(first)), texts), lengths)
        if len(first) > 1:
            found, term = np.unique(product * len(names) + term, return_inverse=True)
        else:
            found = np.arange(len(names))
        of, name = np.divmod(found, max(len(names), 1))
        bins = group["bins"].to_numpy()[first]
        bin_of = crc[name] % bins[of]
        order = np.lexsort((bin_of, of))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        term = place[term]
        df = np.bincount(term, minlength=len(found))  # of this part
        cells, sizes = np.unique(of * (bins.max() + 1) + bin_of, return_counts=True)
        cells = np.stack([*np.divmod(cells, bins.max() + 1), sizes])
        names = names.take(pa.array(name[order])).to_pylist()
        keys = ids.take(pa.array(first)).to_pylist()
        sent, end = [], 0
        for p, k, size in cells.T.tolist():
            begin, end = end, end + size
            sent.append((keys[p], k, " ".join(names[begin:end]), df[begin:end].astype(np.int64).tobytes()))
        node, at = _joint(lengths, *_same_keys(group, change))
        facts = dict(products=keys, n=group["n"].to_numpy()[first], bins=bins, texts=texts, cells=cells, lengths=_narrow(
            np.bincount(node, minlength=len(ids))), term=_narrow(term[at]), count=_narrow(count[at]))
        return facts, pa.concat_arrays(group.select(NODE[1:]).to_struct_array().chunks).take(pa.array(np.arange(len(ids)))), sent

    @classmethod
    def numbered(cls, facts: dict, code: np.ndarray, df: np.ndarray) -> Part:
        """With the numbers of its terms, -1 for one that occurs in a single text and links nothing, and the texts that hold them."""
        cell = np.repeat(np.arange(facts["cells"].shape[1]), facts["cells"][2])
        whole = cls({**facts, "df": df, "norm": np.ones(len(facts["lengths"]))})
        norm = np.sqrt(np.bincount(whole.node, whole.w * whole.w, whole.m))
        order = np.lexsort((code, cell))
        order = order[code[order] >= 0]
        place = np.full(len(code), -1)
        place[order] = np.arange(len(order))
        term = place[whole.term]
        kept = term >= 0
        sizes = np.bincount(cell[order], minlength=facts["cells"].shape[1])
        cells = np.vstack([facts["cells"][:2], sizes])[:, sizes > 0]
        part = cls({**facts, **dict(
            cells=cells, code=code[order].astype(np.uint32), lengths=_narrow(np.bincount(whole.node[kept], minlength=whole.m)),
            term=_narrow(term[kept]), count=whole.count[kept], df=_narrow(df[order]), norm=norm)})
        part.squares = np.bincount(part.node, part.w * part.w, part.m)
        return part

    def facts(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in self.FACTS}

    def totals(self, inbox: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of the terms, and the two other numbers of each product; of a product that has settled nothing comes."""
        found = [inbox.get((self.products[p], k)) for p, k in self.cells[:2].T.tolist()]
        terms = np.concatenate([np.zeros(0), *(np.zeros(size) if f is None else f for f, size in zip(found, self.cells[2].tolist()))])
        other = [inbox.get((key, k)) for key, k in zip(self.products, self.bins.tolist())]
        return terms, *np.array([(0.0, 0.0) if o is None else o for o in other]).T

    def messages(self, part: np.ndarray, loose: np.ndarray, change: np.ndarray, settled: np.ndarray) -> Iterator[tuple]:
        """(product, bin, numbers of terms, values) for every cell, and for the other numbers of each product that goes on."""
        end = 0
        for p, k, size in self.cells.T.tolist():
            begin, end = end, end + size
            if not settled[p]:
                yield self.products[p], k, _narrow(np.diff(self.code[begin:end].astype(np.int64), prepend=0)).tobytes(), part[begin:end].tobytes()
        for p in np.flatnonzero(~settled).tolist():
            yield self.products[p], int(self.bins[p]), b"\0\1", np.array([loose[p], change[p]]).tobytes()

    def pull(self, totals: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Similarity matrix times q, from the totals of w q per term."""
        return np.bincount(self.node, self.w * totals[self.term], self.m) - self.squares * q

    def share(self, r: np.ndarray) -> np.ndarray:
        return np.divide(r, self.sums, out=np.zeros(self.m), where=self.linked)

    def first(self, inbox: dict) -> tuple[np.ndarray, list[tuple]]:
        """State before the first step, from the sums of all weights; the texts' sums are known from now on."""
        self.sums = self.pull(self.totals(inbox)[0], np.ones(self.m))
        moved = 1.0 / self.n[self.product]
        none = np.zeros(len(self.products), bool)
        return self.state(0, none, np.zeros(self.m), moved), self.shares(moved, np.ones(len(none)), none)

    @staticmethod
    def state(step: int, settled: np.ndarray, r: np.ndarray, moved: np.ndarray) -> np.ndarray:
        """Number of the step, which products have settled, and ranks before and after it."""
        return np.concatenate([[step], settled, r, moved])

    def step(self, state: np.ndarray, inbox: dict) -> tuple[np.ndarray, list[tuple]]:
        """One step of the walk."""
        products = len(self.products)
        step, before, (old, r) = int(state[0]), state[1:1 + products] > 0, state[1 + products:].reshape(2, -1)
        totals, loose, change = self.totals(inbox)
        done = change < lx.RANK_TOLERANCE
        settled = before | done | (step == lx.RANK_ITERATIONS)
        pulled = self.pull(totals, self.share(r))
        moved = (1 - lx.DAMPING) / self.n[self.product] + lx.DAMPING * (pulled + (loose / self.n)[self.product])
        # what settles now keeps the ranks before the last step, or those after it if the steps have run out
        stays, last = settled[self.product], (before | done)[self.product]
        r, moved = np.where(last, old, r), np.where(stays, r, moved)
        return self.state(step + 1, settled, r, moved), self.shares(moved, np.bincount(self.product, np.abs(moved - r), products), settled)

    def shares(self, moved: np.ndarray, change: np.ndarray, settled: np.ndarray) -> list[tuple]:
        part = np.bincount(self.term, self.w * self.share(moved)[self.node], len(self.code))
        loose = np.bincount(self.product, np.where(self.linked, 0.0, moved), len(self.products))
        return list(self.messages(part, loose, change, settled))

    # ------------------------------------------------------------------ picks
    def keys(self, p: int) -> tuple[np.ndarray, int]:
        """Ascending numbers of a product's terms that are the same in all parts, and where they begin."""
        mine = self.cells[0] == p
        begin, sizes = int(self.cells[2][self.cells[0] < p].sum()), self.cells[2][mine]
        return np.repeat(self.cells[1][mine], sizes) << 32 | self.code[begin:begin + sizes.sum()].astype(np.int64), begin

    def offers(self, r: np.ndarray, nearest: np.ndarray, pick: np.ndarray, highest: np.ndarray) -> Iterator[tuple[int, float, int]]:
        """For each product with a text that is not picked yet the best value of those, and the first text that has it."""
        value = np.round(lx.MMR_LAMBDA * r / highest[self.product] - (1 - lx.MMR_LAMBDA) * nearest, TIE_DIGITS)
        value = np.where(pick > 0, -np.inf, value)
        end = 0
        for p, size in enumerate(self.texts.tolist()):
            begin, end = end, end + size
            at = begin + int(np.argmax(value[begin:end]))
            if value[at] > -np.inf:
                yield p, float(value[at]), at

    def vector(self, p: int, k: int) -> tuple[list[int], list[float]]:
        keys, begin = self.keys(p)
        inside = slice(*np.searchsorted(self.node, [k, k + 1]))
        return keys[self.term[inside].astype(np.int64) - begin].tolist(), self.w[inside].tolist()

    def nearness(self, chosen: dict) -> np.ndarray:
        """Cosines of all texts with the picked one of their product, ``chosen`` by product."""
        found = np.zeros(len(self.code))
        for p, key in enumerate(self.products):
            if key in chosen:
                keys, begin = self.keys(p)
                at = np.searchsorted(keys, chosen[key]["terms"])
                for place, term, weight in zip(at.tolist(), chosen[key]["terms"], chosen[key]["weights"]):
                    if place < len(keys) and keys[place] == term:
                        found[begin + place] = weight  # a text of several rows repeats its terms
        return np.bincount(self.node, self.w * found[self.term], self.m)


def _groups(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[pa.Table]:
    """The rows of one key after another from a sorted partition, over batch borders."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in names)))
        begin = 0
        for k, key in enumerate(keys):
            if key != last:
                held += [batch.slice(begin, k - begin)] if k > begin else []
                if held:
                    yield pa.Table.from_batches(held)
                held, begin, last = [], k, key
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def _by_part(kind: T.StructType, work: Callable[[pa.RecordBatch, int], Iterator[tuple]]):
    """Function for mapInArrow: the rows that ``work`` makes of each part, some MB of them at a time."""
    shape = to_arrow_schema(kind)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows), shape)], schema=shape)

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                for row in work(batch, k):
                    rows.append(row)
                    held += sum(len(v) for v in row if isinstance(v, bytes))
                    if held > BATCH_BYTES or len(rows) >= ROWS_OUT:
                        yield batch_of(rows)
                        rows, held = [], 0
        if rows:
            yield batch_of(rows)
    return run


BATCH_BYTES = 4 << 20


def _start(kind: T.StructType):
    """Parts before their terms have numbers."""
    shape = to_arrow_schema(kind)

    def run(batches):
        for group in _groups(batches, ["part"]):
            facts, ids, sent = Part.start(group)
            names = [dict(product_id=key, bin=k, names=names, df=df) for key, k, names, df in sent]
            yield pa.RecordBatch.from_pylist([dict(part=group["part"][0].as_py(), facts=_pack(facts), ids=_pack(ids), names=names)], shape)
    return run


def _codes(kind: T.StructType):
    """Numbers of the terms of a cell, and how many texts of the product hold each, for all parts."""
    shape = to_arrow_schema(kind)

    def run(batches):
        for group in _groups(batches, ["product_id", "bin"]):
            found = pc.split_pattern(group["names"].combine_chunks(), " ")
            term = found.flatten().dictionary_encode().indices.to_numpy()
            df = np.bincount(term, np.frombuffer(b"".join(group["df"].to_pylist()), np.int64)).astype(np.int64)
            code = np.where(df > 1, np.cumsum(df > 1) - 1, -1)
            ends = np.cumsum(found.value_lengths().to_numpy())[:-1]
            both = [np.concatenate([code[at], df[at]]).tobytes() for at in np.split(term, ends)]
            yield from group.select(["product_id", "bin", "part"]).append_column("data", pa.array(both, pa.binary())).cast(
                shape).combine_chunks().to_batches()
    return run


def _totals(kind: T.StructType):
    """The sums over all parts, for the terms of each part in a cell; states pass."""
    shape = to_arrow_schema(kind)

    def run(batches):
        for group in _groups(batches, ["product_id", "bin"]):
            if group["bin"][0].as_py() < 0:
                yield from group.select(shape.names).cast(shape).combine_chunks().to_batches()
                continue
            data, code = group["data"].to_pylist(), group["code"].to_pylist()
            sizes = np.array([len(d) // 8 for d in data])
            step = np.concatenate([np.frombuffer(c, f"u{len(c) // n}") for c, n in zip(code, sizes.tolist())]).astype(np.int64)
            ends = np.cumsum(sizes)
            at = np.cumsum(step)
            at -= np.repeat(at[ends - sizes] - step[ends - sizes], sizes)
            total = np.bincount(at, np.frombuffer(b"".join(data), float))[at]
            cuts = [t.tobytes() for t in np.split(total, ends[:-1])]
            yield from group.select(["product_id", "bin", "part"]).append_column("data", pa.array(cuts, pa.binary())).cast(
                shape).combine_chunks().to_batches()
    return run


def _inbox(batch: pa.RecordBatch, k: int, kind=float) -> dict:
    """What came for a part, by cells; its state is at None."""
    return {None if e["bin"] < 0 else (e["product_id"], e["bin"]): np.frombuffer(e["data"], kind)
            for e in batch.column("inbox")[k].as_py()}


def _sent(batch: pa.RecordBatch, k: int, state: np.ndarray, settled: bool | None, messages, *more) -> Iterator[tuple]:
    """Rows of a part: its state, and its messages."""
    part = batch.column("part")[k].as_py()
    yield (None, -1 - part, part, settled, None, state.tobytes(), *more)
    for product, bin_, code, values in messages:
        yield (product, bin_, part, None, code, values, *[None for _ in more])


def _facts(batch: pa.RecordBatch, k: int, column: str = "facts"):
    return _unpack(batch.column(column)[k].as_py())


def _number(batch: pa.RecordBatch, k: int) -> Iterator[tuple]:
    """A part with numbered terms, and the sums of its weights."""
    facts, inbox = _facts(batch, k), _inbox(batch, k, np.int64)
    halves = [np.split(inbox[facts["products"][p], b], 2) for p, b in facts["cells"][:2].T.tolist()]
    code, df = (np.concatenate([np.zeros(0, np.int64), *(h[i] for h in halves)]) for i in (0, 1))
    part = Part.numbered(facts, code, df)
    one = np.ones(len(part.products))
    sums = part.messages(np.bincount(part.term, part.w, len(part.code)), 0 * one, one, one < 1)
    yield from _sent(batch, k, np.zeros(0), None, sums, _pack(part.facts()), batch.column("ids")[k].as_py())


def _first(batch: pa.RecordBatch, k: int) -> Iterator[tuple]:
    part = Part(_facts(batch, k))
    state, sent = part.first(_inbox(batch, k))
    yield from _sent(batch, k, state, False, sent, _pack(part.facts()), batch.column("ids")[k].as_py())


def _step(batch: pa.RecordBatch, k: int) -> Iterator[tuple]:
    inbox = _inbox(batch, k)
    state = inbox.pop(None)
    if not inbox:  # all have settled
        yield from _sent(batch, k, state, True, [])
        return
    state, sent = Part(_facts(batch, k)).step(state, inbox)
    yield from _sent(batch, k, state, not sent, sent)


def _row_type(product: T.StructField, *more: str) -> T.StructType:
    """States of parts (a bin below 0) and their messages to cells."""
    return T.StructType([
        product, T.StructField("bin", T.IntegerType()), T.StructField("part", T.IntegerType()),
        T.StructField("settled", T.BooleanType()), T.StructField("code", T.BinaryType()), T.StructField("data", T.BinaryType()),
        *[T.StructField(c, T.BinaryType()) for c in more]])


def _by_cells(sent: DataFrame, work, count: int) -> DataFrame:
    """(part, inbox): what the cells make of the rows sent to them, for each part, in as many partitions as the parts are kept in."""
    kind = T.StructType([sent.schema[c] for c in ("product_id", "bin", "part")] + [T.StructField("data", T.BinaryType())])
    back = sent.repartition("product_id", "bin").sortWithinPartitions("product_id", "bin", "part").mapInArrow(work(kind), kind)
    return back.repartition(count, "part").groupBy("part").agg(F.collect_list(F.struct("product_id", "bin", "data")).alias("inbox"))


def _settle(parts: DataFrame, product: T.StructField, count: int, together: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Walk of products of several blocks: a step shuffles the ranks and one number per part and term, as an array for each cell,
    never the vectors. A table is written every ``together`` steps, and the one before is deleted.

    Returns the settled states; the parts, which are kept on the executors' disks until they are unpersisted; and their table.
    """
    full, plain = _row_type(product, "facts", "ids"), _row_type(product)
    names = parts.select("part", F.explode("names").alias("e")).select("part", "e.*")
    begun = materialize(parts.select("part", "facts", "ids").join(_by_cells(names, _codes, count), "part").mapInArrow(
        _by_part(full, _number), full), "rank-numbers")
    discard(parts)
    stored = begun.filter("bin < 0").select("part", "facts", "ids")
    rows = materialize(stored.join(_by_cells(begun.filter("bin >= 0").select(*plain.names), _totals, count), "part").mapInArrow(
        _by_part(full, _first), full), "rank-start")
    discard(begun)
    fixed = rows.filter("bin < 0").select("part", "facts", "ids").repartition(count, "part").persist(StorageLevel.DISK_ONLY)
    states, written = rows.select(*plain.names), None
    while True:
        for _ in range(together):
            states = fixed.select("part", "facts").join(_by_cells(states, _totals, count).hint("shuffle_hash"), "part").mapInArrow(
                _by_part(plain, _step), plain)
        states = materialize(states, "rank-step")
        if written is not None:
            discard(written)
        written = states
        if states.filter("bin < 0 and not settled").isEmpty():
            return states, fixed, rows


def _ranked(batch: pa.RecordBatch, k: int) -> Iterator[tuple]:
    """Ranks, nearness to the picks and picks of a part, before the first pick; and the highest rank of each product."""
    part, state = Part(_facts(batch, k)), np.frombuffer(batch.column("data")[k].as_py(), float)
    r = state[1 + len(part.products):][:part.m]
    yield from _state_and_offers(batch, k, part, np.stack([r, 0 * r, 0 * r]), np.maximum.reduceat(r, np.cumsum(part.texts) - part.texts), {})


def _state_and_offers(batch: pa.RecordBatch, k: int, part: Part, state: np.ndarray, highest: np.ndarray, offers: dict) -> Iterator[tuple]:
    of = batch.column("part")[k].as_py()
    yield None, of, state.tobytes(), None, None
    for p, key in enumerate(part.products):
        yield key, of, None, float(highest[p]), offers.get(p)


def _taken(batch: pa.RecordBatch, k: int, place: int) -> tuple[Part, pa.Array, np.ndarray, np.ndarray]:
    """A part, its ids, its ranks, nearness and picks after the products' pick ``place``, and their highest ranks."""
    part, ids = Part(_facts(batch, k)), _facts(batch, k, "ids")
    state = np.frombuffer(batch.column("data")[k].as_py(), float).reshape(3, -1).copy()
    best = {e["product_id"]: e for e in batch.column("inbox")[k].as_py()}
    chosen = {key: e["offer"] for key, e in best.items() if e["offer"]}
    mine = [e["at"] for e in chosen.values() if e["of"] == batch.column("part")[k].as_py()]
    if mine:
        group, keyed = _same_keys(pa.Table.from_struct_array(ids), np.diff(part.product) > 0)
        state[2, np.isin(group, group[mine]) & keyed] = place
    if chosen:
        state[1] = np.maximum(state[1], part.nearness(chosen))
    return part, ids, state, np.array([best[key]["top"] for key in part.products])


def _offers(place: int):
    def work(batch: pa.RecordBatch, k: int) -> Iterator[tuple]:
        part, ids, state, highest = _taken(batch, k, place - 1)
        offers = {}
        for p, value, at in part.offers(*state, highest):
            terms, weights = part.vector(p, at)
            offers[p] = dict(down=-value, **ids[at].as_py(), of=batch.column("part")[k].as_py(), at=at, terms=terms, weights=weights)
        yield from _state_and_offers(batch, k, part, state, highest, offers)
    return work


def _texts(kind: T.StructType, picks: int):
    """Ids, ranks and picks of the texts of each part."""
    shape = to_arrow_schema(kind)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                part, ids, state, _ = _taken(batch, k, picks)
                keys = pa.array(part.products, shape.field("product_id").type).take(pa.array(part.product))
                columns = [keys, *ids.flatten(), pa.array(state[0]), pa.array(state[2].astype(np.int32))]
                yield from pa.table(columns, names=shape.names).cast(shape).combine_chunks().to_batches(max_chunksize=ROWS_OUT)
    return run


def _pick(states: DataFrame, fixed: DataFrame, count: int, shape: T.StructType, picks: int) -> DataFrame:
    """Picks of products of several blocks: every part offers its best text of each product, and learns which one was taken."""
    ids = [shape[c] for c in NODE[1:]]
    offer = T.StructType([T.StructField("down", T.DoubleType()), *ids, T.StructField("of", T.IntegerType()),
                          T.StructField("at", T.IntegerType()), T.StructField("terms", T.ArrayType(T.LongType())),
                          T.StructField("weights", T.ArrayType(T.DoubleType()))])
    kind = T.StructType([shape["product_id"], T.StructField("part", T.IntegerType()), T.StructField("data", T.BinaryType()),
                         T.StructField("top", T.DoubleType()), T.StructField("offer", offer)])

    def known(rows: DataFrame) -> DataFrame:
        offers = rows.filter("data is null").select("product_id", "part", "top", "offer")
        best = offers.groupBy("product_id").agg(F.max("top").alias("top"), F.min("offer").alias("offer"))
        inbox = offers.select("product_id", "part").join(best, "product_id").groupBy("part").agg(
            F.collect_list(F.struct("product_id", "top", "offer")).alias("inbox"))
        state = rows.filter("data is not null").select("part", "data").join(inbox, "part")
        return fixed.join(state.repartition(count, "part").hint("shuffle_hash"), "part")

    first = fixed.select("part", "facts").join(states.filter("bin < 0").select("part", "data").repartition(count, "part").hint("shuffle_hash"), "part")
    rows = materialize(first.mapInArrow(_by_part(kind, _ranked), kind), "picks")
    discard(states)
    for place in range(1, picks + 1):
        before, rows = rows, materialize(known(rows).mapInArrow(_by_part(kind, _offers(place)), kind), "picks")
        discard(before)
    found = materialize(known(rows).mapInArrow(_texts(shape, picks), shape), "ranks")
    discard(rows)
    return found


# ------------------------------------------------------------------ ranks and picks of many whole products at once
def _products(batches: Iterator[pa.RecordBatch], room: int) -> Iterator[pa.Table]:
    """Whole products from a sorted partition: some ``room`` texts of small ones together, a larger one alone."""
    ready: list[pa.RecordBatch] = []
    last: list[pa.RecordBatch] = []  # of the product that may go on

    def close() -> Iterator[pa.Table]:
        nonlocal last
        if sum(b.num_rows for b in last) > room:
            yield pa.Table.from_batches(last)
        else:
            ready.extend(last)
        last = []

    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("product_id")
        cuts = (np.flatnonzero(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist()
        if last and last[-1].column("product_id")[-1].as_py() != ids[0].as_py():
            cuts = [0, *cuts]
        if not cuts:
            last.append(batch)
            continue
        last += [batch.slice(0, cuts[0])] if cuts[0] else []
        yield from close()
        ready += [batch.slice(cuts[0], cuts[-1] - cuts[0])] if cuts[-1] > cuts[0] else []
        last = [batch.slice(cuts[-1])]
        if sum(b.num_rows for b in ready) >= room:
            yield pa.Table.from_batches(ready)
            ready = []
    yield from close()
    if ready:
        yield pa.Table.from_batches(ready)


class Texts:
    """The texts of some whole products, and their linked terms as flat arrays: weight ``w`` of term ``term`` in text ``node``.

    Terms and texts are numbered over all products, so a step of all walks is a few sums, however many products there are.
    """

    def __init__(self, table: pa.Table):
        ids = table["product_id"].combine_chunks()
        change = pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False).astype(bool)
        self.m = table.num_rows
        self.first = np.concatenate([[0], np.flatnonzero(change) + 1])
        self.n = np.diff(np.append(self.first, self.m))
        self.product = np.repeat(np.arange(len(self.first)), self.n)
        lengths, term, count, names = _counted(table["_t"])
        if len(self.first) > 1:
            _, term = np.unique(np.repeat(self.product, lengths) * len(names) + term, return_inverse=True)
        df = np.bincount(term)
        tokens = np.bincount(np.repeat(self.product, lengths), count, len(self.first))
        self.plain = (self.n < 2) | (tokens == 0)
        self.group, self.keyed = _same_keys(table, change)
        self.node, at = _joint(lengths, self.group, self.keyed)
        self.term = term[at]
        n = self.n[self.product[self.node]]
        w = (1 + np.log(count[at])) * (np.log((1 + n) / (1 + df[self.term])) + 1)
        norm = np.sqrt(np.bincount(self.node, w * w, self.m))
        linked = df[self.term] > 1
        self.node, self.term, self.w = self.node[linked], self.term[linked], (w / norm[self.node])[linked]
        self.terms = len(df)

    def ranks(self) -> np.ndarray:
        """The walks of all products, each until it settles; those that have settled are left out now and then."""
        out = np.ones(self.m)
        rows = np.flatnonzero(~self.plain[self.product])
        kept = ~self.plain[self.product[self.node]]
        node, term, w = self.node[kept], self.term[kept], self.w[kept]

        def numbered(rows, node):
            place = np.zeros(self.m, np.int64)
            place[rows] = np.arange(len(rows))
            products, product = np.unique(self.product[rows], return_inverse=True)
            return place[node], products, product

        at, products, product = numbered(rows, node)
        pull = lambda q: np.bincount(at, w * (np.bincount(term, w * q[at], self.terms)[term] - w * q[at]), len(rows))
        linked = np.bincount(at, minlength=len(rows)) > 0
        n = self.n[products][product]
        sums, r, moved = pull(np.ones(len(rows))), np.zeros(len(rows)), 1.0 / n
        change, step = np.ones(len(products)), 0
        while len(rows):
            done = change < lx.RANK_TOLERANCE
            if step == lx.RANK_ITERATIONS:
                r, done = np.where(done[product], r, moved), np.full(len(done), True)
            settled = done[product]
            out[rows[settled]] = r[settled]
            if done.all():
                break
            if done.any():
                stay = ~settled
                inside = stay[at]
                node, term, w, rows = node[inside], term[inside], w[inside], rows[stay]
                sums, r, moved, linked, n = sums[stay], r[stay], moved[stay], linked[stay], n[stay]
                at, products, product = numbered(rows, node)
            r = moved
            loose = np.bincount(product, np.where(linked, 0.0, r))[product]
            pulled = pull(np.divide(r, sums, out=np.zeros(len(rows)), where=linked))
            moved = (1 - lx.DAMPING) / n + lx.DAMPING * (pulled + loose / n)
            change, step = np.bincount(product, np.abs(moved - r)), step + 1
        return out

    def picks(self, r: np.ndarray, places: int) -> np.ndarray:
        """MMR order within each product, 0 for the rest."""
        pick, nearest = np.zeros(self.m, np.int32), np.zeros(self.m)
        highest = np.maximum.reduceat(r, self.first)[self.product]
        for place in range(1, places + 1):
            value = np.round(lx.MMR_LAMBDA * r / highest - (1 - lx.MMR_LAMBDA) * nearest, TIE_DIGITS)
            value[pick > 0] = -np.inf
            best = np.maximum.reduceat(value, self.first)
            best[self.plain | (self.n < place)] = np.nan  # no pick
            offered = np.flatnonzero(value == best[self.product])
            chosen = offered[np.unique(self.product[offered], return_index=True)[1]]
            taken = np.zeros(self.m, bool)
            taken[chosen] = True
            mine = taken[self.node]
            weights = np.zeros(self.terms)
            weights[self.term[mine]] = self.w[mine]
            nearest = np.maximum(nearest, np.bincount(self.node, self.w * weights[self.term], self.m))
            pick[np.isin(self.group, self.group[chosen]) & self.keyed] = place
        return pick


def _side_by_side(kind: T.StructType, picks: int):
    """Ranks and picks of whole products."""
    shape = to_arrow_schema(kind)

    def run(batches):
        for table in _products(batches, ROOM):
            texts = Texts(table)
            r = texts.ranks()
            found = table.select(NODE).append_column("centrality", pa.array(r)).append_column(
                "pick", pa.array(texts.picks(r, picks)))
            yield from found.cast(shape).combine_chunks().to_batches(max_chunksize=ROWS_OUT)
    return run


def rank_texts(nodes: DataFrame, picks: int = 0, block_tokens: int | None = None) -> DataFrame:
    """(product_id, review_id, sent_no, centrality, pick) for ``nodes(node, body)``.

    Products without a second text or without any term get centrality 1 and no
    picks; callers handle those. ``pick`` is the 1-based MMR order, 0 for the rest.
    Texts are dealt to blocks of about ``block_tokens`` tokens of one product, which
    take the same steps however many there are. By default a product of up to ``WHOLE_TOKENS``
    is ranked whole: its texts are shuffled once, and vectors and walks of many products are worked out
    side by side in one task; a larger one is dealt to blocks of ``BLOCK_TOKENS``.
    """
    found = nodes.filter("product_id is not null").select(*NODE, digest_tokens(F.col("body")).alias("_k"))
    # tokens have no spaces
    tokenised = materialize(found.select(*NODE, F.coalesce(F.array_join("_k", " "), F.lit("")).alias("_t"), F.coalesce(
        F.size("_k"), F.lit(0)).alias("_k")), "tokens")
    size = F.col("tokens") + F.col("n")  # texts without any token take room, too
    sizes = tokenised.groupBy("product_id").agg(F.count("*").alias("n"), F.sum("_k").alias("tokens")).withColumn(
        "blocks", F.ceil(size / (block_tokens or BLOCK_TOKENS)).cast("int"))
    limit = WHOLE_TOKENS if block_tokens is None else block_tokens
    large = materialize(sizes.filter((size > limit) & (F.col("blocks") > 1)), "large-products")
    texts = tokenised.drop("_k")
    some, blocks = large.agg(F.sum(size), F.sum("blocks")).first()
    rest = texts.join(large, "product_id", "left_anti").select(texts.columns) if some else texts
    shape = T.StructType([tokenised.schema[c] for c in NODE] + [
        T.StructField("centrality", T.DoubleType()), T.StructField("pick", T.IntegerType())])
    out = rest.repartition("product_id").sortWithinPartitions(*NODE).mapInArrow(_side_by_side(shape, picks), shape)
    return out.unionByName(_rank_dealt(texts.join(large, "product_id"), shape, picks, some, blocks)) if some else out


def _rank_dealt(texts: DataFrame, shape: T.StructType, picks: int, size: int, blocks: int) -> DataFrame:
    """The same by blocks, for products of any size; ``size`` and ``blocks`` are those of all of them.

    Blocks are dealt to parts of about ``PART_TOKENS`` tokens and texts, in which they stand side by side.
    """
    plain = (F.col("n") < 2) | (F.col("tokens") == 0)
    trivial = texts.filter(plain).select(*NODE, F.lit(1.0).alias("centrality"), F.lit(0).alias("pick"))
    bins = F.least(F.ceil(F.sqrt("blocks")), F.ceil((F.col("tokens") + F.col("n")) / BIN_TOKENS)).cast("int")
    cores = texts.sparkSession.sparkContext.defaultParallelism
    count = max(2 * cores, size // PART_TOKENS)
    near = F.floor(F.pmod(F.xxhash64(*NODE), "blocks") / max(1, blocks // count))  # blocks of one product share terms
    dealt = texts.filter(~plain).select(
        *NODE, "n", "_t", bins.alias("bins"), F.pmod(F.xxhash64("product_id", near), F.lit(4 * count)).cast("int").alias("part"))
    kind = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("facts", T.BinaryType()),
        T.StructField("ids", T.BinaryType()), T.StructField("names", T.ArrayType(T.StructType([
            shape["product_id"], T.StructField("bin", T.IntegerType()), T.StructField("names", T.StringType()),
            T.StructField("df", T.BinaryType())])))])
    ordered = dealt.repartition("part").sortWithinPartitions("part", *NODE)
    parts = materialize(ordered.mapInArrow(_start(kind), kind), "rank-parts")
    if parts.isEmpty():
        return trivial
    count = min(count, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    states, fixed, table = _settle(parts, shape["product_id"], count, max(1, min(LOOKS, LOOKS * TOGETHER // size)))
    try:
        return trivial.unionByName(_pick(states, fixed, count, shape, picks))
    finally:
        fixed.unpersist()
        discard(table)
