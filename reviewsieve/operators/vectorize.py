"""TF-IDF over word 1-2-grams: vocabulary from a corpus, weights inside each row."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions.columns import doubles, let
from ..functions.text import counted, ngrams, term_tokens


def terms(text: Column) -> Column:
    return ngrams(term_tokens(text))


def term_statistics(reviews: DataFrame) -> DataFrame:
    """(term, df, cf): reviews that hold a term, and its occurrences. One shuffle of combined rows."""
    return reviews.select(F.explode(counted(terms(F.col("text")))).alias("t")).groupBy(
        F.col("t.item").alias("term")).agg(F.count("*").alias("df"), F.sum("t.n").alias("cf"))


def idf(n: Column, df: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def vocabulary(reviews: DataFrame, max_features: int = lx.MAX_FEATURES, min_df: int = lx.MIN_DF,
               max_df: float = lx.MAX_DF) -> DataFrame:
    """(term, idx, df, cf, idf): the most frequent terms, numbered from 0 in alphabetic order."""
    n = reviews.agg(F.count("*").alias("n")).scalar()
    fit = term_statistics(reviews).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    kept = fit.orderBy(F.desc("cf"), "term").limit(max_features)
    numbered = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("term")) - 1  # at most max_features rows
    return kept.select("term", numbered.alias("idx"), "df", "cf", idf(n, F.col("df")).alias("idf"))


@dataclass
class Vectorizer:
    """A fitted vocabulary. Its size is bounded by ``max_features``, so it travels with the plan."""

    terms: list[str] = field(default_factory=list)
    idf: list[float] = field(default_factory=list)
    _counter: CountVectorizerModel | None = field(default=None, repr=False, compare=False)

    @classmethod
    def fit(cls, reviews: DataFrame, max_features: int = lx.MAX_FEATURES, **limits) -> Vectorizer:
        rows = vocabulary(reviews, max_features, **limits).orderBy("idx").select("term", "idf").collect()
        return cls([r["term"] for r in rows], [r["idf"] for r in rows])

    def __len__(self) -> int:
        return len(self.terms)

    def transform(self, reviews: DataFrame, name: str = "tfidf") -> DataFrame:
        """Add ``name``: struct<indices, values>, the L2-normalised weights of the known terms.

        Row-local: Spark ML counts the known terms, the weights follow in place.
        """
        if not self.terms:
            return reviews.withColumn(name, F.struct(F.array().cast("array<int>").alias("indices"),
                                                     F.array().cast("array<double>").alias("values")))
        if self._counter is None:  # handing the vocabulary to the JVM takes a while, so once per object
            self._counter = CountVectorizerModel.from_vocabulary(self.terms, inputCol="_terms", outputCol="_counts")
        counts = self._counter.transform(reviews.withColumn("_terms", terms(F.col("text"))))
        weights = doubles(self.idf)

        def build(v: Column) -> Column:
            raw = F.zip_with(v["indices"], v["values"],
                             lambda i, n: (1 + F.log(n)) * F.element_at(weights, i + 1))
            return let(raw, lambda w: let(
                F.sqrt(F.aggregate(w, F.lit(0.0), lambda a, x: a + x * x)),
                lambda norm: F.struct(v["indices"].alias("indices"),
                                      F.transform(w, lambda x: x / norm).alias("values"))))

        return counts.withColumn(name, let(F.unwrap_udt("_counts"), build)).drop("_terms", "_counts")


def long_form(vectors: DataFrame, vectorizer_terms: Sequence[str] | None = None,
              id_col: str = "review_id", name: str = "tfidf") -> DataFrame:
    """(id, idx, value) and, given the vocabulary, ``term``."""
    from ..functions.columns import strings
    out = vectors.select(id_col, F.explode(F.arrays_zip(
        F.col(f"{name}.indices").alias("idx"), F.col(f"{name}.values").alias("value"))).alias("e")).select(
        id_col, "e.idx", "e.value")
    if vectorizer_terms is None:
        return out
    return out.withColumn("term", F.element_at(strings(vectorizer_terms), F.col("idx") + 1))
