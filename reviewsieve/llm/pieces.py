"""SentencePiece encoding and decoding with N-best segmentation.

The piece lattice of a text falls apart where no piece of the vocabulary reaches across, such as before a space mark
that follows other text. In each part the forward Viterbi scores are computed; they are the exact heuristic of an A*
search that runs backward from the end and so yields the best segmentations in order, going on from no place more than N
times, which bounds the work for parts of any length. The forward pass also keeps the
score of the second-best path, so a text's N best segmentations need the search only in the N-1 words where a deviation
is cheapest; all others keep their best path.

The vocabulary comes from a public model file, whose path is a parameter. The file's pieces carry ranks, not
probabilities; the lattice takes a Zipf law over the ranks (``piece_scores``). Characters without a piece, and a
literal space mark, are spelled in byte pieces, so decoding gives back every text.

Row-local; the vocabulary (32,000 pieces) is broadcast. Defined cases: null counts as empty; an empty text is the lone
space mark that starts every text; repeated rows stay, an empty table gives an empty result; a long text without spaces is
one part, for which time and memory follow its length; ties go to the segmentation with longer pieces first; result columns replace columns
of that name.
"""
from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
N_BEST = 3
CACHE = 200_000   # words in each of two generations that a worker remembers
CACHE_BESIDE = 30_000  # the same where segmentations are kept, too, and other stages have left their memory behind
LONGEST = 256     # characters of the longest word that is remembered
ROWS = 256        # rows of a result handed over at once
ROWS_N = 64       # the same, if a row holds several segmentations


def read_pieces(model_file: str = MODEL_FILE) -> list[tuple[str, float, bool]]:
    """(piece, score in the file, is it a byte) by id; control and unknown pieces are empty."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [("" if model.IsControl(i) or model.IsUnknown(i) else model.IdToPiece(i), model.GetScore(i),
             model.IsByte(i)) for i in range(model.GetPieceSize())]


def piece_scores(pieces: Sequence[tuple[str, float, bool]]) -> list[float]:
    """Log probabilities by a Zipf law over the file's order of scores; byte pieces come last of all."""
    order = sorted((i for i, (p, _, byte) in enumerate(pieces) if p and not byte), key=lambda i: -pieces[i][1])
    total = math.log(sum(1 / r for r in range(1, len(order) + 1)) or 1)
    out = [-math.log(len(pieces) + 1) - total - 2.0] * len(pieces)
    for rank, i in enumerate(order, 1):
        out[i] = -math.log(rank) - total
    return out


class Codec:
    """Encoder and decoder over a list of pieces and their scores."""

    def __init__(self, pieces: Sequence[tuple[str, float, bool]], scores: Sequence[float] | None = None, cache: int = CACHE):
        scores = list(scores or piece_scores(pieces))
        self.kind = np.dtype("<u2" if len(pieces) <= 1 << 16 else "<u4")
        bytes_of = {int(p[3:-1], 16): i for i, (p, _, byte) in enumerate(pieces) if byte}
        if len(bytes_of) < 256:
            raise ValueError("the vocabulary needs the 256 byte pieces")
        self.byte_score = scores[bytes_of[0]]
        self.packed_byte = [self.pack([bytes_of[b]]) for b in range(256)]
        # a node of the piece tree: its children, and score and id of the piece that ends there
        self.tree: dict[str, list] = {}
        for i, (p, _, byte) in enumerate(pieces):
            if p and not byte:
                node: list = [self.tree, 0.0, None]
                for char in p:
                    node = node[0].setdefault(char, [{}, 0.0, None])
                node[1:] = [scores[i], self.pack([i])]
        self.text_of = [b"" if not p else bytes([int(p[3:-1], 16)]) if byte else p.replace(MARK, " ").encode()
                        for p, _, byte in pieces]
        whole = [p for p, _, byte in pieces if p and not byte]
        # Parts end where no piece reaches across: before a space mark, around a character that no longer piece has,
        # and between a word of letters and a mark that no piece has right after a letter.
        joined = {p[k:k + 2] for p in whole for k in range(len(p) - 1)}
        alone = re.escape("".join(c for c in "\n\t" if not any(c in pair for pair in joined))) or "(?!)"
        odd = {c for pair in joined for c in pair if re.match(r"[^\W\d_]", c) and not c.isalpha()}
        letter = r"[^\W\d_" + re.escape("".join(sorted(odd))) + "]"
        closing = [c for c in ".,;:!?)\"'" if not any(pair[1] == c and pair[0].isalpha() for pair in joined)]
        ends = re.escape("".join(closing)) + MARK + ("" if alone == "(?!)" else alone)
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in whole):
            self.part = re.compile(r"[\s\S]+")  # pieces reach across space marks: the text is one part
        else:
            self.part = re.compile(f"{MARK}*{letter}+(?=[{ends}]|\\Z)|" + (
                f"{MARK}*[^{MARK}]+|{MARK}+" if alone == "(?!)" else f"[{alone}]|{MARK}*[^{MARK}{alone}]+|{MARK}+"))
        self.cache = cache
        self.known: dict[str | None, tuple[bytes, float, float]] = {}
        self.older: dict[str | None, tuple[bytes, float, float]] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "older": {}}

    def pack(self, ids) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def unpack(self, packed: bytes) -> np.ndarray:
        return np.frombuffer(packed, self.kind)

    def spelled(self, char: str) -> tuple[float, bytes]:
        """A character without a piece: score and ids of its bytes."""
        raw = char.encode()
        return self.byte_score * len(raw), b"".join([self.packed_byte[b] for b in raw])

    def viterbi(self, part: str) -> tuple[bytes, float, float]:
        """Ids and score of the best path, and what the second-best costs beyond it."""
        n, tree = len(part), self.tree
        forward, second = [0.0] + [-math.inf] * n, [-math.inf] * (n + 1)
        begin, ids = [0] * (n + 1), [b""] * (n + 1)
        for i, char in enumerate(part):
            node, base, behind, j = tree.get(char), forward[i], second[i], i
            if node is None or node[2] is None:
                score, piece = self.spelled(char)
                node = [node[0] if node else {}, score, piece]
            while node is not None:
                children, score, piece = node
                j += 1
                if piece is not None:
                    value = base + score
                    old = forward[j]
                    if value > old:
                        behind_here = behind + score
                        second[j] = old if old > behind_here else behind_here
                        forward[j], begin[j], ids[j] = value, i, piece
                    elif value > second[j]:
                        second[j] = value
                if j == n:
                    break
                node = children.get(part[j])
        path, at = [], n
        while at:
            path.append(ids[at])
            at = begin[at]
        path.reverse()
        return b"".join(path), forward[n], forward[n] - second[n]

    def n_best(self, part: str, n: int) -> list[tuple[float, bytes]]:
        """The n best paths in order: A* backward from the end, with the forward Viterbi score of a place as the exact
        heuristic of the way that is left. No place goes on more than n times, since the ways from the end come in order
        and n of them make n paths already; so time and memory follow the length. Of equal paths the one that
        ``viterbi`` takes comes first; scores that differ by rounding only count as equal."""
        size = len(part)
        ends: list[list[tuple[int, list]]] = [[] for _ in range(size + 1)]
        forward = [0.0] + [-math.inf] * size
        for i, char in enumerate(part):
            node, base, j = self.tree.get(char), forward[i], i
            if node is None or node[2] is None:
                node = [node[0] if node else {}, *self.spelled(char)]
            while node is not None:
                j += 1
                if node[2] is not None:
                    ends[j].append((i, node))
                    if base + node[1] > forward[j]:
                        forward[j] = base + node[1]
                if j == size:
                    break
                node = node[0].get(part[j])
        order = itertools.count()
        left = [n] * (size + 1)
        # an entry holds its last step and the entry before it; of equal entries the one nearest the start goes on
        agenda = [(-forward[size], size, next(order), 0.0, None)]
        found: list[tuple[float, bytes]] = []
        while agenda and len(found) < n:
            _, at, _, score, path = heapq.heappop(agenda)
            if at == 0:
                ids, score = [], 0.0
                while path is not None:  # summed in the order of ``viterbi``, so that none is above the best by rounding
                    node, path = path
                    ids.append(node[2])
                    score += node[1]
                found.append((score, b"".join(ids)))
                continue
            if left[at] == 0:
                continue
            left[at] -= 1
            for start, node in ends[at]:
                if left[start]:
                    way = score + node[1]
                    heapq.heappush(agenda, (-(way + forward[start]), start, next(order), way, (node, path)))
        best, top, _ = self.viterbi(part)
        others = sorted((f for f in found if f[1] != best), key=lambda f: -f[0])
        return [(top, best), *others][:n]

    def parts(self, text: str) -> list[str | None]:
        """Words of the marked text; None is a space mark that stood in the text itself."""
        if MARK not in text:
            return self.part.findall(MARK + text.replace(" ", MARK))
        out: list[str | None] = []
        for k, piece in enumerate((" " + text).split(MARK)):
            if k:
                out.append(None)
            out += self.part.findall(piece.replace(" ", MARK))
        return out

    def _best(self, part: str | None) -> tuple[bytes, float, float]:
        """Best path of a word that was not seen lately."""
        if (found := self.older.get(part)) is None:
            if part is None:
                score, ids = self.spelled(MARK)
                found = (ids, score, math.inf)
            else:
                found = self.viterbi(part)
        if part is not None and len(part) > LONGEST:
            return found
        if len(self.known) >= self.cache:
            self.older, self.known = self.known, {}
        self.known[part] = found
        return found

    def encode_packed(self, text: str, n: int = 1) -> list[tuple[float, bytes, list[tuple[str, bytes]]]]:
        """The n best segmentations: score, ids, and the words whose ids differ from the best one's."""
        parts = self.parts(text)
        known = self.known.get
        best = [known(p) or self._best(p) for p in parts]
        total = math.fsum([b[1] for b in best])
        ids = [b[0] for b in best]
        out = [(total, b"".join(ids), [])]
        if n == 1:
            return out
        costs = [b[2] for b in best]
        places = [k for k in heapq.nsmallest(n - 1, range(len(costs)), key=costs.__getitem__) if costs[k] < math.inf]
        choices = [self.n_best(parts[k], n) for k in places]
        # the n cheapest picks over all words come from the n cheapest over the words before the last one
        ranked: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        for c in choices:
            ranked = heapq.nsmallest(n, ((cost + (c[0][0] - c[i][0]), (*pick, i)) for cost, pick in ranked for i in range(len(c))))
        for cost, pick in ranked[1:]:
            changed = [(k, c[i][1]) for k, c, i in zip(places, choices, pick) if i]
            own = ids[:]
            for k, other in changed:
                own[k] = other
            out.append((total - cost, b"".join(own), [(parts[k], other) for k, other in changed]))
        return out

    def encode(self, text: str, n: int = 1) -> list[tuple[float, np.ndarray]]:
        """The n best segmentations as (score, ids), fewer if there are no more."""
        return [(score, self.unpack(packed)) for score, packed, _ in self.encode_packed(text, n)]

    def pieces_text(self, packed: bytes) -> bytes:
        return b"".join(map(self.text_of.__getitem__, self.unpack(packed).tolist()))

    def decode(self, ids) -> str:
        return b"".join(map(self.text_of.__getitem__, ids)).decode()[1:]

    def is_whole(self, text: str, found: list[tuple[float, bytes, list[tuple[str, bytes]]]]) -> bool:
        """Do all segmentations decode to the text? The others differ from the first in a few words only."""
        return self.pieces_text(found[0][1])[1:] == text.encode() and all(
            self.pieces_text(other) == word.replace(MARK, " ").encode() for _, _, changed in found for word, other in changed)


_codecs: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """The broadcast codec, kept by the worker so that its memory of parts outlives a task."""
    key = id(shared.value)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = shared.value
    return _codecs[key]


def in_rows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The batches in smaller ones, since the ids of many long texts are large."""
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.iloc[at:at + ROWS]


def _as_arrow(codec: Codec, rows: list) -> pa.Array:
    """Rows of packed segmentations as lists of (score, ids); no id becomes a Python object."""
    found = [f for row in rows for f in row]

    def lists(sizes: list[int], values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)

    ids = lists([len(packed) // codec.kind.itemsize for _, packed, _ in found],
                pa.array(codec.unpack(b"".join([packed for _, packed, _ in found])).astype(np.int32)))
    scores = pa.array([score for score, _, _ in found], pa.float64())
    return lists([len(row) for row in rows], pa.StructArray.from_arrays([scores, ids], ["score", "ids"]))


def encode(docs: DataFrame, text_col: str = "text", model_file: str = MODEL_FILE, n: int = N_BEST) -> DataFrame:
    """Add ``segmentations``: array of (score, ids), best first."""
    shared = docs.sparkSession.sparkContext.broadcast(Codec(read_pieces(model_file), cache=CACHE_BESIDE))

    @F.arrow_udf("array<struct<score:double,ids:array<int>>>")
    def segment(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(shared)
        for batch in batches:
            for at in range(0, len(batch), ROWS_N):
                yield _as_arrow(codec, [codec.encode_packed(t or "", n) for t in batch.slice(at, ROWS_N).to_pylist()])

    return docs.withColumn("segmentations", segment.asNondeterministic()(F.col(text_col)))


def best_ids(docs: DataFrame, text_col: str = "text", model_file: str = MODEL_FILE) -> DataFrame:
    """Add ``ids`` of the best segmentation."""
    shared = docs.sparkSession.sparkContext.broadcast(Codec(read_pieces(model_file)))

    @F.pandas_udf("array<int>")
    def segment(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(shared)
        for texts in in_rows(batches):
            yield pd.Series([codec.encode(t or "")[0][1].astype(np.int32) for t in texts], dtype=object)

    return docs.withColumn("ids", segment.asNondeterministic()(F.col(text_col)))


def decode(encoded: DataFrame, ids_col: str = "ids", model_file: str = MODEL_FILE) -> DataFrame:
    """Add ``decoded``, the text of the ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(Codec(read_pieces(model_file)))

    @F.pandas_udf("string")
    def join(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(shared)
        for ids in in_rows(batches):
            yield pd.Series([None if i is None else codec.decode(i) for i in ids], dtype=object)

    return encoded.withColumn("decoded", join(F.col(ids_col)))


def segmentation_digest(docs: DataFrame, text_col: str = "text", model_file: str = MODEL_FILE,
                        n: int = N_BEST) -> DataFrame:
    """Add ``digest``: pieces and SHA-256 (16-bit little endian ids) of the best segmentation, scores of the n best,
    SHA-256 of each of these, and whether all of them decode to the text."""
    shared = docs.sparkSession.sparkContext.broadcast(Codec(read_pieces(model_file)))

    @F.pandas_udf("n_pieces long, ids_sha256 string, scores array<double>, n_best_sha256 array<string>, "
                  "round_trip boolean")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(shared)
        for texts in batches:
            rows = []
            for text in texts:
                text = text or ""
                found = codec.encode_packed(text, n)
                hashes = [hashlib.sha256(packed).hexdigest() for _, packed, _ in found]
                rows.append((len(found[0][1]) // codec.kind.itemsize, hashes[0], [score for score, _, _ in found],
                             hashes, codec.is_whole(text, found)))
            yield pd.DataFrame(rows, columns=["n_pieces", "ids_sha256", "scores", "n_best_sha256", "round_trip"])

    return docs.withColumn("digest", digest.asNondeterministic()(F.col(text_col)))
