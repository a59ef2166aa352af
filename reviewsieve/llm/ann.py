"""Approximate nearest neighbours by collision counting over single projections.

An index block holds its rows' projections on random directions as sorted arrays, one per direction. A query opens a
window around its own projection in each array; a row that lies in enough of the windows has collided often enough and
becomes a candidate. If there are too few, all windows are widened (virtual rehashing: the same arrays serve every
radius) and the counts go on. Candidates are compared exactly.

Rows and queries are dealt into blocks of bounded size; every block of queries meets every block of rows, each in a
task with two blocks in memory, and the best of all blocks are merged. Equal vectors lie in the same windows, so ties
are kept whole.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component take no part; so do rows with
a null id; rows of another length than the query are no candidates for it; a query never finds rows of its own id;
repeated rows of one id are one candidate; ties go to the smaller id; extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS = 96
THRESHOLD = 0.65       # share of the windows that a candidate lies in
CHECKED = 0.25         # share of a block's rows to collect as candidates before a query stops widening
FIRST_RADIUS = 0.7     # of unit vectors, which are up to 2 apart
WIDENING = 1.1
ROWS_PER_BLOCK = 4096
QUERIES_PER_BLOCK = 4096
SEED = 7


def usable(vector: Column) -> Column:
    """Finite, not null, not zero."""
    values = vector.cast("array<double>")
    good = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(good & F.exists(values, lambda v: v != 0), F.lit(False))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector by a power of two, its largest component near 1: cosines stay exactly as they are, and no norm
    over- or underflows."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


class Index:
    """Sorted projections of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], scaled(vectors[order])
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.directions = np.random.default_rng(SEED).standard_normal((vectors.shape[1], PROJECTIONS))
        values = (self.vectors / self.norms[:, None]) @ self.directions
        self.order = np.argsort(values, axis=0, kind="stable").astype(np.int32).T.copy()
        self.sorted = np.take_along_axis(values, self.order.T, axis=0).T.copy()

    def candidates(self, queries: np.ndarray, k: int) -> list[np.ndarray]:
        """Row numbers that collide often enough with each query."""
        n = len(self.ids)
        unit = queries / np.sqrt((queries * queries).sum(axis=1))[:, None]
        centres = unit @ self.directions
        enough, wanted = int(np.ceil(THRESHOLD * PROJECTIONS)), min(n, k + 1 + int(CHECKED * n))
        counts = [np.zeros(n, np.int64) for _ in range(len(queries))]
        found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
        middle = np.stack([np.searchsorted(self.sorted[j], centres[:, j]) for j in range(PROJECTIONS)], axis=1)
        low, high = middle, middle
        active, radius = list(range(len(queries))), FIRST_RADIUS
        while active:
            wider_low, wider_high = low.copy(), high.copy()
            for j in range(PROJECTIONS):
                wider_low[active, j] = np.searchsorted(self.sorted[j], centres[active, j] - radius, side="left")
                wider_high[active, j] = np.searchsorted(self.sorted[j], centres[active, j] + radius, side="right")
            wider_low, wider_high = np.minimum(wider_low, low), np.maximum(wider_high, high)
            going = []
            for q in active:
                new = [part for j in range(PROJECTIONS) for part in (
                    self.order[j, wider_low[q, j]:low[q, j]], self.order[j, high[q, j]:wider_high[q, j]])]
                counts[q] += np.bincount(np.concatenate(new), minlength=n)
                found[q] = np.flatnonzero(counts[q] >= enough)
                if len(found[q]) < wanted and (wider_low[q].any() or (wider_high[q] < n).any()):
                    going.append(q)
            low, high, active, radius = wider_low, wider_high, going, radius * WIDENING
        return found

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
        """(query, row, cosine) of the k best of each query in this block, computed in double precision."""
        queries = scaled(queries)
        norms = np.sqrt((queries * queries).sum(axis=1))
        for at in range(0, len(queries), 256):
            part = slice(at, at + 256)
            for query, vector, norm, rows in zip(query_ids[part], queries[part], norms[part],
                                                 self.candidates(queries[part], k)):
                rows = rows[self.ids[rows] != query]
                score = (self.vectors[rows] * vector).sum(axis=1) / (self.norms[rows] * norm)
                best = np.lexsort((self.ids[rows], -score))[:k]
                yield from ((int(query), int(self.ids[rows[b]]), float(score[b])) for b in best)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
            rows_per_block: int = ROWS_PER_BLOCK, queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows found for each query."""
    def taken(df: DataFrame) -> DataFrame:
        plain = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        plain = plain.filter(F.col("id").isNotNull() & usable(F.col("v"))).groupBy("id").agg(F.min("v").alias("v"))
        return plain.withColumn("dim", F.size("v"))

    rows, asked = taken(vectors), taken(queries)
    row_blocks = max(1, -(-rows.count() // rows_per_block))
    query_blocks = max(1, -(-asked.count() // queries_per_block))
    dealt = lambda blocks: F.pmod(F.xxhash64("id"), F.lit(blocks))
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>"))
    rows = rows.select("dim", dealt(row_blocks).alias("rb"), each(query_blocks).alias("qb"), "id", "v")
    asked = asked.select("dim", each(row_blocks).alias("rb"), dealt(query_blocks).alias("qb"), "id", "v")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, float]] = []
        if len(left) and len(right):
            index = Index(left["id"].to_numpy(), np.stack(left["v"].to_list()))
            found = list(index.search(right["id"].to_numpy(), np.stack(right["v"].to_list()), k))
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    keys = ["dim", "rb", "qb"]
    found = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(
        search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
