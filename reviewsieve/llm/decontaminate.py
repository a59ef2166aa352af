"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton of all items is built once; a document's words stream through it, which gives at each word the longest
match that ends there. A match of a whole window (``window`` item words in a row, or a shorter item whole) marks its
words as hit. Documents stay where they are: no shuffle, one broadcast per block of items of bounded size.

Defined cases: null and empty texts have no words and no hits; null or empty items have no windows; a null item id
counts as the empty string; repeated items count once per id; result columns replace columns of the same name.
"""
from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import words

WINDOW = 13            # item words in a row that count as an occurrence
MAX_COVERAGE = 0.05    # share of hit words from which a document is contaminated
BLOCK_WORDS = 50_000   # words of a block of items; bounds what is broadcast (about 20 MB), more items make more blocks

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("longest", T.IntegerType()),
    T.StructField("word_spans", T.ArrayType(SPAN)), T.StructField("spans", T.ArrayType(SPAN)),
    T.StructField("items", T.ArrayType(T.StringType()))])
_WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


class SuffixAutomaton:
    """Suffix automaton of several word sequences, with the windows marked on its states."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, seq in items for w in seq), 1)}
        self.width = len(self.vocabulary) + 1
        self.next: dict[int, int] = {}
        self.outgoing: list[list[int]] = [[]]
        self.link, self.length = [-1], [0]
        sequences = [(item, [self.vocabulary[w] for w in seq]) for item, seq in items if seq]
        for _, seq in sequences:
            last = 0
            for word in seq:
                last = self._extend(last, word)
        del self.outgoing
        self.shortest = min((min(window, len(seq)) for _, seq in sequences), default=0)
        marks: dict[int, dict[int, set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, seq in sequences:
            size, state = min(window, len(seq)), 0
            for i, word in enumerate(seq, 1):
                state = self.next[state * self.width + word]
                if i >= size:
                    holder = state
                    while self.length[self.link[holder]] >= size:
                        holder = self.link[holder]
                    marks[holder][size].add(item)
        self.marks = {s: [(n, frozenset(ids)) for n, ids in sorted(by.items())] for s, by in marks.items()}
        # nearest marked state on the way up, the state itself included
        self.marked = [0] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.marked[s] = s if s in self.marks else self.marked[self.link[s]]

    def _state(self, length: int) -> int:
        self.link.append(-1)
        self.length.append(length)
        self.outgoing.append([])
        return len(self.link) - 1

    def _put(self, state: int, word: int, to: int) -> None:
        key = state * self.width + word
        if key not in self.next:
            self.outgoing[state].append(word)
        self.next[key] = to

    def _split(self, parent: int, word: int) -> int:
        """The state reached from ``parent``; its shorter strings get a state of their own if they need one."""
        old = self.next[parent * self.width + word]
        if self.length[old] == self.length[parent] + 1:
            return old
        new = self._state(self.length[parent] + 1)
        for w in self.outgoing[old]:
            self._put(new, w, self.next[old * self.width + w])
        self.link[new], self.link[old] = self.link[old], new
        while parent != -1 and self.next.get(parent * self.width + word) == old:
            self._put(parent, word, new)
            parent = self.link[parent]
        return new

    def _extend(self, last: int, word: int) -> int:
        if last * self.width + word in self.next:
            return self._split(last, word)
        new, parent = self._state(self.length[last] + 1), last
        while parent != -1 and parent * self.width + word not in self.next:
            self._put(parent, word, new)
            parent = self.link[parent]
        self.link[new] = 0 if parent == -1 else self._split(parent, word)
        return new

    def scan(self, text_words: list[bytes]) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Longest match in words, hit ranges of word positions (end exclusive, merged), ids of the items found."""
        ids = list(map(self.vocabulary.get, text_words))
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        longest, begin, n = 0, 0, len(ids)
        while begin < n:
            # a run of item words; any other word ends every match
            try:
                end = ids.index(None, begin)
            except ValueError:
                end = n
            if end - begin >= self.shortest:
                longest = max(longest, self._run(ids, begin, end, spans, items))
            begin = end + 1
        return longest, merged(spans), items

    def _run(self, ids, begin, end, spans, items) -> int:
        step, width, link, length, marked, marks = (
            self.next.get, self.width, self.link, self.length, self.marked, self.marks)
        state = matched = longest = 0
        for i in range(begin, end):
            word = ids[i]
            to = step(state * width + word)
            while to is None:
                state = link[state]
                matched = length[state]
                to = step(state * width + word)
            state, matched = to, matched + 1
            if matched > longest:
                longest = matched
            at = marked[state]
            while at:
                for size, found in marks[at]:
                    if size <= matched:
                        spans.append((i + 1 - size, i + 1))
                        items |= found
                at = marked[link[at]]
        return longest


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def automata(items: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[SuffixAutomaton]:
    """One automaton per block of items; the driver holds one block at a time."""
    block, n = [], 0
    for row in items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col)).toLocalIterator():
        seq = words(row[1])
        if block and n + len(seq) > block_words:
            yield SuffixAutomaton(block, window)
            block, n = [], 0
        block.append((row[0], seq))
        n += len(seq)
    yield SuffixAutomaton(block, window)


def _matcher(automaton) -> Column:
    @F.pandas_udf(FOUND)
    def match(texts: pd.Series, before: pd.DataFrame) -> pd.DataFrame:
        rows = []
        earlier = zip(before["longest"], before["word_spans"], before["items"])
        for text, (longest_so_far, old_spans, old_items) in zip(texts, earlier):
            seq = words(text)
            longest, spans, items = automaton.value.scan(seq)
            if old_spans is not None and len(old_spans):
                spans = merged(spans + [(s["start"], s["end"]) for s in old_spans])
                items |= set(old_items)
            longest = max(longest, int(longest_so_far))
            places = [m.span() for m in _WORD.finditer(text)] if spans else []
            rows.append((
                len(seq), sum(e - s for s, e in spans), longest, [{"start": s, "end": e} for s, e in spans],
                [{"start": places[s][0], "end": places[e - 1][1]} for s, e in spans], sorted(items)))
        return pd.DataFrame(rows, columns=FOUND.names)

    return match


def find_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
               item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Add ``contamination``: words, hit words, longest match, hit spans (words; code points) and item ids of each row.

    Items beyond ``block_words`` words go to further automata, which extend the result of the earlier ones row by row.
    """
    spark = docs.sparkSession
    empty = F.struct(F.lit(0).alias("longest"), F.array().cast(T.ArrayType(SPAN)).alias("word_spans"),
                     F.array().cast("array<string>").alias("items"))
    out = docs.withColumn("contamination", empty)
    for automaton in automata(items, item_id, item_text, window, block_words):
        match = _matcher(spark.sparkContext.broadcast(automaton))
        out = out.withColumn("contamination", match(F.col(text_col), F.struct(
            "contamination.longest", "contamination.word_spans", "contamination.items")))
    return out


def is_contaminated(max_coverage: float = MAX_COVERAGE) -> Column:
    """Hit words reach the coverage limit. The limit is taken as a fraction of whole numbers, so there is no rounding."""
    top, bottom = Fraction(str(max_coverage)).as_integer_ratio()
    n_hit, n_words = F.col("contamination.n_hit"), F.col("contamination.n_words")
    return (n_hit > 0) & (n_hit * bottom >= n_words * top)


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the spans (sorted, apart)."""
    kept = F.concat(
        F.transform(spans, lambda s, i: F.substring(
            text, F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"]) + 1,
            s["start"] - F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"]))),
        F.array(F.substring(text, F.element_at(spans, -1)["end"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, F.array_join(kept, "")).otherwise(text)


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, max_coverage: float = MAX_COVERAGE,
                  max_words: int = 1) -> DataFrame:
    """Drop documents whose coverage reaches ``max_coverage``; from the rest cut the hit spans, or those of ``max_words``
    words or more only. All other documents keep their text as it is."""
    found = find_items(docs, items, text_col, item_id, item_text, window)
    longer = F.arrays_zip(F.col("contamination.word_spans").alias("w"), F.col("contamination.spans").alias("c"))
    cut = F.transform(F.filter(longer, lambda z: z["w"]["end"] - z["w"]["start"] >= max_words), lambda z: z["c"])
    return (found.filter(~is_contaminated(max_coverage)).withColumn("_cut", cut)
            .withColumn(text_col, without_spans(F.col(text_col), F.col("_cut"))).drop("_cut", "contamination"))
