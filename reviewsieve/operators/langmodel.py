"""Interpolated bigram language model as count tables.

A fold is a group of reviews left out of the counts that score it. Counts are
kept per fold and the own fold is subtracted, so one pass serves all folds.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions.text import adjacent, ngrams, tokens_lower
from ..functions.columns import doubles, join_by_review, let, review_keys
from ..session import materialize
from .distribute import hash_rank

LOOKUP_BYTES = 32 << 20  # a count table up to this size goes to every executor
LOOKUP_ENTRIES = 50_000  # pairs and tokens of a model up to which they travel with the plan, as the vocabulary does


def boundary_tokens(text: Column) -> Column:
    return F.concat(F.array(F.lit(lx.SENTENCE_START)), tokens_lower(text), F.array(F.lit(lx.SENTENCE_END)))


def token_pairs(reviews: DataFrame, *keep: str) -> DataFrame:
    """(keep..., prev, cur): every pair of neighbouring tokens of every review."""
    return reviews.select(*keep, F.explode(let(boundary_tokens(F.col("text")), adjacent)).alias("p")).select(
        *keep, "p.prev", "p.cur")


def with_folds(reviews: DataFrame, k: int = lx.FOLDS, seed: int = 0, id_col: str = "review_id") -> DataFrame:
    """Add ``fold``: k pseudo-random folds whose sizes differ by at most one."""
    ranked = hash_rank(reviews, id_col, seed)
    return ranked.withColumn("fold", (F.col("hash_rank") % k).cast("int")).drop("hash_rank", "group_size")


@dataclass
class BigramModel:
    """``pairs(prev, cur, c[, c_0..])``, ``tokens(token, c[, c_0..])``; c_f = count within fold f."""

    pairs: DataFrame
    folds: int = 0

    @property
    def count_columns(self) -> list[str]:
        return ["c"] + [f"c_{f}" for f in range(self.folds)]

    @property
    def tokens(self) -> DataFrame:
        """Every token is the first of a pair, except the end mark, which only closes pairs."""
        ends = F.col("cur") == lx.SENTENCE_END
        sides = F.when(ends, F.array("prev", "cur")).otherwise(F.array("prev"))
        return self.pairs.select(F.explode(sides).alias("token"), *self.count_columns).groupBy("token").agg(
            *[F.sum(c).alias(c) for c in self.count_columns])

    @property
    def totals(self) -> DataFrame:
        """One row per left-out fold (or one with fold null): ``fold, total, v``."""
        return self.totals_of(self.tokens)

    def totals_of(self, tokens: DataFrame) -> DataFrame:
        if not self.folds:
            return tokens.agg(F.sum("c").alias("total"), (F.count("*") + 1).alias("v")).select(
                F.lit(None).cast("int").alias("fold"), "total", "v")
        rest = [F.col("c") - F.col(f"c_{f}") for f in range(self.folds)]
        sums = tokens.agg(*[F.sum(r).alias(f"t{f}") for f, r in enumerate(rest)],
                          *[(F.count_if(r > 0) + 1).alias(f"v{f}") for f, r in enumerate(rest)])
        return sums.select(F.explode(F.array(*[
            F.struct(F.lit(f).alias("fold"), F.col(f"t{f}").alias("total"), F.col(f"v{f}").alias("v"))
            for f in range(self.folds)])).alias("s")).select("s.*")

    def merge(self, other: BigramModel) -> BigramModel:
        """Model over both training sets: counts add up."""
        if self.folds != other.folds:
            raise ValueError("models with different folds cannot be merged")
        both = self.pairs.unionByName(other.pairs).groupBy("prev", "cur").agg(
            *[F.sum(c).alias(c) for c in self.count_columns])
        return BigramModel(both, self.folds)

    def without_folds(self) -> BigramModel:
        return BigramModel(self.pairs.select("prev", "cur", "c"))


def fit_bigrams(reviews: DataFrame, folds: int = 0) -> BigramModel:
    """Count pairs over ``reviews(text[, fold])``. Pass genuine reviews only to get the reference score."""
    if not folds:
        counts = token_pairs(reviews).groupBy("prev", "cur").agg(F.count("*").alias("c"))
        return BigramModel(counts)
    counts = token_pairs(reviews, "fold").groupBy("prev", "cur").agg(
        F.count("*").alias("c"), *[F.count_if(F.col("fold") == f).alias(f"c_{f}") for f in range(folds)])
    return BigramModel(counts, folds)


def _left_out(model: BigramModel, prefix: str) -> Column:
    """Count outside the fold of the row (all of it for a model without folds)."""
    whole = F.coalesce(F.col(f"{prefix}c"), F.lit(0))
    if not model.folds:
        return whole
    own = F.lit(0)
    for f in range(model.folds):
        own = F.when(F.col("fold") == f, F.coalesce(F.col(f"{prefix}c_{f}"), F.lit(0))).otherwise(own)
    return whole - own


def log_perplexity(reviews: DataFrame, model: BigramModel) -> DataFrame:
    """(product_id, review_id, log_perplexity), by the keys that ``reviews`` has. With a model that has folds, reviews need a ``fold``.

    Pairs are looked up in the pair table, which already carries the count of its
    first token, and the second token in the token table. Both are written first, so
    that their size is known before a token of ``reviews`` moves: up to ``LOOKUP_BYTES``
    they are broadcast, and only one sum per review is shuffled. Larger ones are
    shuffle joins, in which AQE splits hot keys.
    """
    return _by_joins(reviews, *_stored(model))


def with_log_perplexity(reviews: DataFrame, model: BigramModel) -> DataFrame:
    """``reviews`` plus their ``log_perplexity``; null without a text.

    The log probabilities of up to ``LOOKUP_ENTRIES`` pairs and tokens become weights of a Spark ML count vector of
    the row, so no review is shuffled. A larger model, and reviews whose keys repeat and so share one value, go by
    ``log_perplexity``, joined by review.
    """
    model, tokens = _stored(model)
    if model.pairs.count() + tokens.count() > LOOKUP_ENTRIES or _keys_repeat(reviews):
        return join_by_review(reviews, _by_joins(reviews, model, tokens))
    names, weights, unseen = _weights(model.pairs.collect(), tokens.collect(), model.folds)
    if not names:
        return reviews.withColumn("log_perplexity", F.lit(None).cast("double"))
    items = F.coalesce(ngrams(boundary_tokens(F.col("text"))), F.array().cast("array<string>"))
    counter = CountVectorizerModel.from_vocabulary(names, inputCol="_items", outputCol="_counts")
    counts = counter.transform(reviews.withColumn("_items", items))

    def total(fold: int) -> Column:
        found = let(F.unwrap_udt("_counts"), lambda v: F.aggregate(
            F.zip_with(v["indices"], v["values"], lambda i, n: n * F.element_at(doubles(weights[fold]), i + 1)),
            F.lit(0.0), lambda a, x: a + x))
        n = (F.size("_items") - 1) / 2  # so many pairs, and one token more
        return F.when(n > 0, -(found / n + unseen[fold]))

    value = total(0)
    if model.folds:
        value = F.lit(None).cast("double")
        for f in range(model.folds):
            value = F.when(F.col("fold") == f, total(f)).otherwise(value)
    return counts.withColumn("log_perplexity", value).drop("_items", "_counts")


def _keys_repeat(reviews: DataFrame) -> bool:
    """Also true, but rarely, for keys of one hash; only the hashes are shuffled."""
    keys = reviews.select(F.xxhash64(*review_keys(reviews)).alias("key")).repartition("key")
    return not keys.groupBy("key").count().filter("count > 1").isEmpty()


def _stored(model: BigramModel) -> tuple[BigramModel, DataFrame]:
    """The model with its pairs written, and its tokens."""
    model = BigramModel(materialize(model.pairs, "pairs"), model.folds)
    return model, materialize(model.tokens, "tokens")


def _weights(pairs: Sequence[Row], tokens: Sequence[Row], folds: int) -> tuple[list[str], list[list[float]], list[float]]:
    """Names of the tokens and pairs, and per left-out fold (or once) what one occurrence of each adds to the log
    probability of an unseen token: a token its own count, a pair what it adds to its second token."""
    second = [r for r in tokens if r["token"] != lx.SENTENCE_START]  # the start mark follows no token
    names = [r["token"] for r in second] + [f"{r['prev']} {r['cur']}" for r in pairs]
    weight = lx.BIGRAM_WEIGHT
    weights, unseen = [], []
    for own in [f"c_{f}" for f in range(folds)] or [None]:
        rest = lambda r: r["c"] - (r[own] if own else 0)
        counts = {r["token"]: rest(r) for r in tokens}
        size = sum(counts.values()) + sum(c > 0 for c in counts.values()) + 1
        alone = {t: (1 - weight) * (c + 1) / size for t, c in counts.items()}
        unseen.append(math.log((1 - weight) / size))
        added = [math.log(1 + weight * rest(r) / counts[r["prev"]] / alone[r["cur"]]) if counts[r["prev"]] > 0 else 0.0 for r in pairs]
        weights.append([math.log(alone[r["token"]]) - unseen[-1] for r in second] + added)
    return names, weights, unseen


def _by_joins(reviews: DataFrame, model: BigramModel, tokens: DataFrame) -> DataFrame:
    cols = model.count_columns
    first = tokens.select(F.col("token").alias("prev"), *[F.col(c).alias(f"first_{c}") for c in cols])
    pairs = model.pairs.select("prev", "cur", *[F.col(c).alias(f"pair_{c}") for c in cols])
    second = tokens.select(F.col("token").alias("cur"), *[F.col(c).alias(f"second_{c}") for c in cols])
    held = 16 + 16 * len(cols) + F.octet_length("prev") + F.octet_length("cur")  # with the counts of the first token
    if (model.pairs.agg(F.sum(held)).first()[0] or 0) <= LOOKUP_BYTES:
        pairs, second = F.broadcast(pairs.join(F.broadcast(first), "prev")), F.broadcast(second)
    else:  # sizes on disk say little about sizes in memory
        pairs, second = pairs.hint("merge").join(first.hint("merge"), "prev").hint("merge"), second.hint("merge")
    keys = review_keys(reviews)
    keep = keys + (["fold"] if model.folds else [])
    found = token_pairs(reviews, *keep).join(pairs, ["prev", "cur"], "left").join(second, "cur", "left")

    c_first, c_pair, c_second = (_left_out(model, p) for p in ("first_", "pair_", "second_"))
    p_pair = F.when(c_first > 0, c_pair / c_first).otherwise(0.0)
    sizes = model.totals_of(tokens).agg(F.map_from_entries(F.collect_list(F.struct(
        F.coalesce("fold", F.lit(-1)).alias("fold"), (F.col("total") + F.col("v")).cast("double").alias("n")))
    ).alias("m")).scalar()  # one number per fold
    size = F.element_at(sizes, F.col("fold") if model.folds else F.lit(-1))
    weight = F.lit(lx.BIGRAM_WEIGHT)
    p = weight * p_pair + (1 - weight) * (c_second + 1) / size
    return found.groupBy(*keys).agg((-F.avg(F.log(p))).alias("log_perplexity"))
