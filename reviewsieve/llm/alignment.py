"""Alignment of two tokenizers: groups of tokens that cover the same bytes, and which token pairs overlap.

The text, after one space, is encoded by a byte-level BPE vocabulary (A) and by a piece model (B). Byte offsets where
tokens of both end are cuts; they divide the tokens into groups. Any byte range of the two token sequences is a
``Fragment``: an open prefix up to its first cut, closed groups, and an open suffix after its last cut. Joining two
neighbouring fragments closes the group between them and is associative, so fragments may be joined in any tree.

* Both tokenizers end a token before a space that follows and precedes other characters, so a text is the product of the
  fragments between such spaces (units). Units recur; the fragments of a batch's distinct units are made at once in
  numpy, and the last ones are remembered by the worker.
* Texts over ``PART`` characters are cut there into parts, which are dealt over the tasks. A unit without any such space, of
  whatever length, is encoded as a whole, as its merges need it, and its tokens are then cut into byte ranges, whose
  fragments have open ends. The fragments of a text are joined by a tree of ``FAN`` children, a round for each level.
* Counts of linked id pairs are summed over the corpus. The most frequent pairs (at most ``FREQUENT``) are looked up from
  a broadcast table, the others by a join, which has no hot key left.

Defined cases: texts that are null, empty, or not spelled exactly by both tokenizers have no tokens, groups or links;
repeated rows and ids are rows of their own; special tokens in texts are plain text; an empty table gives no rows; extra
columns are ignored.
"""
from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewsieve.session import materialize

from .common import schema

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
SPACE = re.compile(r"(?<=\S) (?=\S)")
PART = 1 << 16      # characters of a part of a long text, bytes of a range of a long unit
FAN = 16            # fragments that one task joins
REMEMBERED = 100_000  # units that a worker keeps
JOINED = 1000       # units that are encoded as one text
BATCH_CHARS = 1 << 19
FREQUENT = 1 << 16  # pairs in the broadcast table


def byte_of_char() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies: printable bytes for themselves, the
    others in order from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Codecs:
    """Both tokenizers of a folder, and the bytes of their tokens."""

    def __init__(self, folder: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(f"{folder}/{BYTE_BPE}")
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECES}")
        of_char = byte_of_char()
        with open(f"{folder}/{BYTE_BPE}", encoding="utf-8") as file:
            entries = json.load(file)["model"]["vocab"]
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(of_char[c] for c in entry) if all(c in of_char for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.size_a = np.array([len(x) for x in self.bytes_a])
        self.size_b = np.array([len(x) for x in self.bytes_b])
        # how ids stand in the written groups: A followed by "," or "|", B by "," or ";"
        self.written = [f"{i}{end}" for n, ends in ((len(self.bytes_a), ",|"), (len(pieces), ",;")) for end in ends for i in range(n)]
        self.written_size = np.array([len(x) for x in self.written])

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Token ids of space + text by both; None where a tokenizer does not give back the bytes."""
        spaced = [" " + t for t in texts]
        found = zip([e.ids for e in self.a.encode_batch(spaced, add_special_tokens=False)], self.b.encode(texts, num_threads=1))
        return [(a, b) if b"".join(map(self.bytes_a.__getitem__, a)) == raw == b"".join(map(self.bytes_b.__getitem__, b)) else None
                for (a, b), raw in zip(found, (s.encode() for s in spaced))]


@functools.lru_cache(maxsize=1)
def codecs(folder: str) -> Codecs:
    return Codecs(folder)


@dataclass
class Tokens:
    """Neighbouring tokens of both tokenizers with the byte offsets where they end."""

    a: np.ndarray
    a_end: np.ndarray
    b: np.ndarray
    b_end: np.ndarray

    @classmethod
    def none(cls) -> Tokens:
        return cls(*[np.zeros(0, np.int64)] * 4)

    @classmethod
    def of(cls, a: Iterable[int], b: Iterable[int], table: Codecs, at: int = 0) -> Tokens:
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return cls(a, at + np.cumsum(table.size_a[a]), b, at + np.cumsum(table.size_b[b]))

    def between(self, low: int, high: int) -> Tokens:
        """The tokens that end after ``low`` and not after ``high``."""
        i, j = np.searchsorted(self.a_end, [low, high], "right")
        k, l = np.searchsorted(self.b_end, [low, high], "right")
        return Tokens(self.a[i:j], self.a_end[i:j], self.b[k:l], self.b_end[k:l])

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(*[np.concatenate([getattr(self, f), getattr(other, f)]) for f in ("a", "a_end", "b", "b_end")])

    @property
    def cuts(self) -> np.ndarray:
        return np.intersect1d(self.a_end, self.b_end, assume_unique=True)


@dataclass
class Groups:
    """Closed groups: how they are written, their number, and the linked pairs (a * size of B + b), one per link."""

    written: str = ""
    n: int = 0
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def __add__(self, other: Groups) -> Groups:
        return Groups(";".join(x for x in (self.written, other.written) if x), self.n + other.n,
                      np.concatenate([self.pairs, other.pairs]))


@dataclass
class Stretches:
    """Closed groups of several stretches: the written groups of each, and running numbers of groups and pairs."""

    written: list[str]
    until_group: np.ndarray
    pairs: np.ndarray
    until_pair: np.ndarray


def close_all(tokens: Tokens, table: Codecs, ends: np.ndarray) -> Stretches:
    """Groups of tokens, in stretches that reach up to the byte offsets ``ends``, all of them cuts and the last one the end."""
    n_a, n_b = len(table.bytes_a), len(table.bytes_b)
    last_a, last_b = (y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x
                      for x, y in ((tokens.a_end, tokens.b_end), (tokens.b_end, tokens.a_end)))
    group_a, group_b = (np.cumsum(last) - last for last in (last_a, last_b))
    # tokens in the order of writing: group by group, first A, then B
    codes = np.empty(len(tokens.a) + len(tokens.b), np.int64)
    codes[np.arange(len(tokens.a)) + np.searchsorted(group_b, group_a, "left")] = tokens.a + n_a * last_a
    codes[np.arange(len(tokens.b)) + np.searchsorted(group_a, group_b, "right")] = 2 * n_a + tokens.b + n_b * last_b
    text = "".join(map(table.written.__getitem__, codes.tolist()))
    # every stretch between neighbouring ends of any token is one overlap
    borders = np.union1d(tokens.a_end, tokens.b_end)
    pairs = tokens.a[np.searchsorted(tokens.a_end, borders)] * n_b + tokens.b[np.searchsorted(tokens.b_end, borders)]
    until_a, until_b, until_pair, until_group = (np.searchsorted(x, ends, "right") for x in (
        tokens.a_end, tokens.b_end, borders, tokens.a_end[last_a]))
    until_char = np.cumsum(table.written_size[codes])[until_a + until_b - 1].tolist()
    return Stretches([text[i:j - 1] for i, j in zip([0, *until_char], until_char)], until_group, pairs, until_pair)


def close(tokens: Tokens, table: Codecs) -> Groups:
    """Groups of tokens whose last ones end at a cut."""
    if not len(tokens.a):
        return Groups()
    found = close_all(tokens, table, tokens.a_end[-1:])
    return Groups(found.written[0], int(found.until_group[0]), found.pairs)


@dataclass
class Fragment:
    """A byte range: open prefix, closed groups, open suffix. Without a cut all its tokens are the prefix."""

    cut: bool
    prefix: Tokens
    closed: Groups
    suffix: Tokens

    @classmethod
    def of(cls, tokens: Tokens, table: Codecs, starts_at_cut: bool = False) -> Fragment:
        cuts = tokens.cuts
        if not len(cuts):
            return cls(True, Tokens.none(), Groups(), tokens) if starts_at_cut else cls(False, tokens, Groups(), Tokens.none())
        first = -1 if starts_at_cut else int(cuts[0])
        last, end = int(cuts[-1]), int(max(tokens.a_end[-1], tokens.b_end[-1]))
        inner = tokens.between(first, last)
        return cls(True, tokens.between(-1, first) if first >= 0 else Tokens.none(),
                   close(inner, table), tokens.between(last, end))

    def join(self, other: Fragment, table: Codecs) -> Fragment:
        """The fragment of both ranges, ``other`` right after this one."""
        if not self.cut:
            return Fragment(other.cut, self.prefix + other.prefix, other.closed, other.suffix)
        middle = self.suffix + other.prefix
        if not other.cut:
            return Fragment(True, self.prefix, self.closed, middle)
        return Fragment(True, self.prefix, self.closed + close(middle, table) + other.closed, other.suffix)


class Units:
    """The closed groups of units by number; those of a batch's new units are made together."""

    def __init__(self, table: Codecs):
        self.table = table
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.written: list[str] = []
        self.facts = np.zeros((0, 4), np.int64)  # is it spelled; groups, A tokens, B tokens
        self.pairs, self.until_pair = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def add(self, units: set[str]) -> None:
        """Make the groups of units that have no number yet; forget the others first if there are many."""
        if len(self.number) > REMEMBERED:
            self.clear()
        new = [u for u in units if u not in self.number]
        # many are encoded as one text, as no token reaches across; those that begin or end a text with white space are not
        a, b, kept = [], [], []
        edges = [u for u in new if u[0].isspace() or u[-1].isspace()]
        apart = set(edges)
        inner = [u for u in new if u not in apart] if edges else new
        for some in [*(inner[k:k + JOINED] for k in range(0, len(inner), JOINED)), *([u] for u in edges)]:
            found = self.table.encode([" ".join(some)])[0]
            if found is None:
                single = self.table.encode(some)
                some = [u for u, f in zip(some, single) if f]
                found = [sum((f[side] for f in single if f), []) for side in (0, 1)]
            a += found[0]
            b += found[1]
            kept += some
        if kept:
            tokens = Tokens.of(a, b, self.table)
            ends = np.cumsum([1 + len(u.encode()) for u in kept])
            made = close_all(tokens, self.table, ends)
            sizes = [np.diff(x, prepend=0) for x in (made.until_group, *(
                np.searchsorted(x, ends, "right") for x in (tokens.a_end, tokens.b_end)))]
            self.facts = np.concatenate([self.facts, np.stack([np.ones(len(kept), np.int64), *sizes], axis=1)])
            self.until_pair = np.concatenate([self.until_pair, self.until_pair[-1] + made.until_pair])
            self.pairs = np.concatenate([self.pairs, made.pairs])
            self.written += made.written
            self.number.update(zip(kept, range(len(self.number), len(self.number) + len(kept))))
        for u in new if len(kept) < len(new) else ():
            if u not in self.number:
                self.number[u] = len(self.number)
                self.written.append("")
                self.facts = np.concatenate([self.facts, np.zeros((1, 4), np.int64)])
                self.until_pair = np.append(self.until_pair, self.until_pair[-1])

    def products(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the product of its units: the written groups; groups, A and B tokens; and all linked pairs with
        the number of their text. Empty texts and those with a unit that is not spelled have nothing."""
        split = [SPACE.split(t) if t else [] for t in texts]
        self.add(set().union(*split))
        numbers = [list(map(self.number.__getitem__, s)) for s in split]
        written = [";".join(map(self.written.__getitem__, n)) for n in numbers]
        sizes = np.array([len(n) for n in numbers])
        flat, text = np.array([i for n in numbers for i in n], np.int64), np.repeat(np.arange(len(texts)), sizes)
        ends = np.cumsum(sizes)
        running = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.facts[flat], axis=0)])
        facts = running[ends] - running[ends - sizes]
        whole = (facts[:, 0] == sizes) & (sizes > 0)
        flat, text = (x[whole[text]] for x in (flat, text))
        n = self.until_pair[flat + 1] - self.until_pair[flat]
        where = np.repeat(self.until_pair[flat] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return ([w if ok else "" for w, ok in zip(written, whole)], np.where(whole[:, None], facts[:, 1:], 0),
                np.repeat(text, n), self.pairs[where])


PAIR = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())])
PAIR_TYPE = T.ArrayType(schema(a=T.IntegerType(), b=T.IntegerType(), n=T.IntegerType()))
ALIGNED = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                     ("groups", pa.string()), ("links", pa.list_(PAIR))])
ALIGNED_TYPE = schema(doc_id=T.LongType(), n_a=T.LongType(), n_b=T.LongType(), n_groups=T.LongType(),
                      groups=T.StringType(), links=PAIR_TYPE)


def links_of(rows: np.ndarray, pairs: np.ndarray, n_rows: int, n_b: int) -> pa.Array:
    """The distinct pairs of every row with their counts, as an Arrow list array."""
    span = np.int64(1) << 40
    keys, counts = np.unique(rows * span + pairs, return_counts=True)
    offsets = np.searchsorted(keys, np.arange(n_rows + 1) * span)
    pairs = keys % span
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(x, pa.int32()) for x in (pairs // n_b, pairs % n_b, counts)], fields=list(PAIR)))


def _batches(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Neighbouring texts of about ``BATCH_CHARS`` characters with the number of the first."""
    held, first, size = [], 0, 0
    for k, text in enumerate(texts):
        if held and size + len(text or "") > BATCH_CHARS:
            yield first, held
            held, first, size = [], k, 0
        held.append(text or "")
        size += len(text or "")
    if held:
        yield first, held


def _align_short(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = codecs(folder)
        units = Units(table)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for first, held in _batches(texts):
                written, facts, rows, pairs = units.products(held)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(first, len(held)), *[pa.array(facts[:, k]) for k in (1, 2, 0)], pa.array(written, pa.string()),
                    links_of(rows, pairs, len(held), len(table.bytes_b))], schema=ALIGNED)
    return run


# ------------------------------------------------------------------ long texts
OPEN = [("a", pa.list_(pa.int64())), ("a_end", pa.list_(pa.int64())), ("b", pa.list_(pa.int64())), ("b_end", pa.list_(pa.int64()))]
OPEN_TYPE = schema(**{name: T.ArrayType(T.LongType()) for name, _ in OPEN})
FRAGMENT = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("whole", pa.bool_()), ("n_a", pa.int64()),
    ("n_b", pa.int64()), ("cut", pa.bool_()), ("prefix", pa.struct(OPEN)), ("suffix", pa.struct(OPEN)),
    ("n_groups", pa.int64()), ("groups", pa.string()), ("links", pa.list_(PAIR))])
FRAGMENT_TYPE = schema(
    row=T.LongType(), doc_id=T.LongType(), place=T.LongType(), whole=T.BooleanType(), n_a=T.LongType(), n_b=T.LongType(),
    cut=T.BooleanType(), prefix=OPEN_TYPE, suffix=OPEN_TYPE, n_groups=T.LongType(), groups=T.StringType(), links=PAIR_TYPE)
PART_TYPE = schema(row=T.LongType(), doc_id=T.LongType(), part=T.LongType(), at=T.LongType(), text=T.StringType())
PART_SCHEMA = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int64()), ("at", pa.int64()), ("text", pa.string())])


def cut_text(text: str, size: int) -> Iterator[tuple[int, str]]:
    """(byte offset in space + text, part): parts of about ``size`` characters that end before a space between units."""
    begin, at = 0, 0
    while begin < len(text):
        space = SPACE.search(text, min(len(text), begin + size))
        end = space.start() if space else len(text)
        yield at, text[begin:end]
        at += 1 + len(text[begin:end].encode())
        begin = end + 1


def _cut_long(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(c) for c in ("row", "doc_id", "text"))):
                for part, (at, piece) in enumerate(cut_text(text.as_py(), size)):
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(
                        (row.as_py(), doc_id.as_py(), part, at, piece), PART_SCHEMA)], schema=PART_SCHEMA)
    return run


def _counted(pairs: np.ndarray, n_b: int) -> list[dict]:
    keys, counts = np.unique(pairs, return_counts=True)
    return [dict(a=int(k // n_b), b=int(k % n_b), n=int(n)) for k, n in zip(keys, counts)]


def _packed(f: Fragment, row: int, doc_id: int | None, place: int, whole: bool, n_a: int, n_b: int, links: list[dict]) -> dict:
    shown = lambda t: dict(a=t.a.tolist(), a_end=t.a_end.tolist(), b=t.b.tolist(), b_end=t.b_end.tolist())
    return dict(row=row, doc_id=doc_id, place=place, whole=whole, n_a=n_a, n_b=n_b, cut=f.cut, prefix=shown(f.prefix),
                suffix=shown(f.suffix), n_groups=f.closed.n, groups=f.closed.written, links=links)


def part_fragments(text: str, at: int, table: Codecs, size: int) -> Iterator[tuple[Fragment, int, int] | None]:
    """Fragments of a part that begins at byte ``at``, in order, with their numbers of tokens; None if it is not spelled.

    Short units join to one fragment of a range; a longer unit gives a fragment for each of its ranges.
    """
    held: list[str] = []
    for unit in [*SPACE.split(text), None]:
        if unit is None or len(unit) > size:
            if held:
                found = table.encode([" ".join(held)])[0]
                if found is None:
                    yield None
                    return
                tokens = Tokens.of(*found, table, at)
                yield Fragment.of(tokens, table, starts_at_cut=True), len(tokens.a), len(tokens.b)
                at = int(tokens.a_end[-1])
                held = []
            if unit is not None:
                found = table.encode([unit])[0]
                if found is None:
                    yield None
                    return
                tokens = Tokens.of(*found, table, at)
                for low in range(at, int(tokens.a_end[-1]), size):
                    some = tokens.between(low, low + size)
                    yield Fragment.of(some, table, starts_at_cut=low == at), len(some.a), len(some.b)
                at = int(tokens.a_end[-1])
        else:
            held.append(unit)


def _fragments(folder: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = codecs(folder)
        n_b = len(table.bytes_b)
        for batch in batches:
            for row, doc_id, part, at, text in zip(*(batch.column(c).to_pylist() for c in PART_SCHEMA.names)):
                for k, found in enumerate(part_fragments(text, at, table, size)):
                    f, a, b = found or (Fragment(False, Tokens.none(), Groups(), Tokens.none()), 0, 0)
                    packed = _packed(f, row, doc_id, (part << 32) + k, found is not None, a, b, _counted(f.closed.pairs, n_b))
                    yield pa.RecordBatch.from_pylist([packed], FRAGMENT)
    return run


def _join(folder: str):
    """Joins the fragments of one group in the order of their places."""
    def run(group: pa.Table) -> pa.Table:
        table = codecs(folder)
        n_b = len(table.bytes_b)
        rows = sorted(group.to_pylist(), key=lambda r: r["place"])
        whole = all(r["whole"] for r in rows)
        opened = lambda t: Tokens(*[np.array(t[c], np.int64) for c, _ in OPEN])
        total: Fragment | None = None
        links: dict[tuple[int, int], int] = {}
        for r in rows if whole else []:
            f = Fragment(r["cut"], opened(r["prefix"]), Groups(r["groups"], r["n_groups"]), opened(r["suffix"]))
            for p in r["links"]:
                links[p["a"], p["b"]] = links.get((p["a"], p["b"]), 0) + p["n"]
            total = f if total is None else total.join(f, table)
        if total is None:
            total = Fragment(False, Tokens.none(), Groups(), Tokens.none())
        for p in _counted(total.closed.pairs, n_b):  # of the groups that were closed here
            links[p["a"], p["b"]] = links.get((p["a"], p["b"]), 0) + p["n"]
        return pa.Table.from_pylist([_packed(
            total, rows[0]["row"], rows[0]["doc_id"], rows[0]["place"], whole, *(sum(r[c] for r in rows) for c in ("n_a", "n_b")),
            [dict(a=a, b=b, n=n) for (a, b), n in links.items()])], FRAGMENT)
    return run


def _join_neighbours(fragments: DataFrame, parent: Column, folder: str) -> DataFrame:
    """A round of the tree: fragments of a row with the same parent become one, whose place that is."""
    join = _join(folder)
    joined = fragments.withColumn("parent", parent).groupBy("row", "parent").applyInArrow(
        lambda group: join(group.drop_columns(["parent"])), FRAGMENT_TYPE)
    return materialize(joined.withColumn("place", parent), "alignment-joined")


def _align_long(docs: DataFrame, folder: str, size: int) -> DataFrame:
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = materialize(numbered.mapInArrow(_cut_long(size), PART_TYPE), "alignment-parts")
    made = materialize(parts.repartition("row", "part").mapInArrow(_fragments(folder, size), FRAGMENT_TYPE), "alignment-fragments")
    part, piece = F.shiftright("place", 32), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))
    last_part, last_piece = made.agg(F.max(part), F.max(piece)).first()
    while last_piece:  # the ranges of a part
        made = _join_neighbours(made, F.shiftleft(part, 32) + F.floor(piece / FAN), folder)
        last_piece //= FAN
    while last_part:  # the parts of a text
        made = _join_neighbours(made, F.shiftleft(F.floor(part / FAN), 32), folder)
        last_part //= FAN
    # a text is one fragment now, which starts and ends at a cut
    none = {"groups": F.lit(""), "links": F.array().cast(PAIR_TYPE)}
    return made.select("doc_id", *[F.when(F.col("whole"), F.col(c)).otherwise(none.get(c, F.lit(0))).alias(c)
                                   for c in ("n_a", "n_b", "n_groups", "groups", "links")])


def align(docs: DataFrame, folder: str = TOKENIZERS, size: int = PART) -> DataFrame:
    """For every row of ``docs(doc_id, text)``: doc_id, n_a, n_b, n_groups, ``groups`` (A ids | B ids; ...) and ``links``,
    array<struct<a, b, n>>: how often each pair of ids is linked in the text. Texts over ``size`` are cut."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    long = F.coalesce(F.length("text"), F.lit(0)) > size
    short = texts.filter(~long).mapInArrow(_align_short(folder), ALIGNED_TYPE)
    return short.unionByName(_align_long(texts.filter(long), folder, size))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, count, best): links of every id pair in the corpus, and whether no other A id is linked more with this b."""
    counts = aligned.select(F.explode("links").alias("l")).groupBy("l.a", "l.b").agg(F.sum("l.n").alias("count"))
    counts = materialize(counts, "alignment-pairs")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))  # one row per B id
    return counts.join(F.broadcast(most), "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame) -> DataFrame:
    """``aligned`` (a written table with a unique ``row``) with n_links, n_best and count_sum instead of the links."""
    counts = pair_counts(aligned)
    least = counts.orderBy(F.desc("count")).limit(FREQUENT + 1).agg(F.count("*").alias("n"), F.min("count").alias("least")).first()
    often = F.col("count") > (least.least if least.n > FREQUENT else 0)  # at most FREQUENT pairs
    links = aligned.select("row", F.explode("links").alias("l")).select("row", "l.*")
    looked_up = links.join(F.broadcast(counts.filter(often)), ["a", "b"], "left")
    sums = [F.sum("n").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
            F.sum(F.col("n") * F.col("count")).alias("count_sum")]
    frequent = looked_up.filter("count is not null").groupBy("row").agg(*sums)
    rare = looked_up.filter("count is null").select("row", "a", "b", "n").join(
        counts.filter(~often), ["a", "b"]).groupBy("row").agg(*sums)
    names = ["n_links", "n_best", "count_sum"]
    total = frequent.unionByName(rare).groupBy("row").agg(*[F.sum(c).alias(c) for c in names])
    return aligned.drop("links").join(total, "row", "left").select(
        *[c for c in aligned.columns if c not in ("row", "links")], *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names])
