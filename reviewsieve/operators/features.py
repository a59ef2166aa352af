"""The dense feature table, and its standardisation."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions.columns import join_by_review
from ..functions.sentiment import sentiment
from ..functions.style import rating_extremity, rating_mismatch, style


def local_features(reviews: DataFrame, sentiment_col: str | None = None) -> DataFrame:
    """Add all dense features but ``log_perplexity``; no shuffle.

    ``sentiment_col`` names a column that already holds the caller's own score.
    """
    score = F.col(sentiment_col) if sentiment_col else sentiment("text")
    out = reviews.withColumn("_style", style("text")).withColumn("sentiment", score)
    for name in lx.STYLE_FEATURES:
        out = out.withColumn(name, F.col(f"_style.{name}"))
    return out.withColumn("rating_extremity", rating_extremity(F.col("rating"))).withColumn(
        "rating_mismatch", rating_mismatch(F.col("rating"), F.col("sentiment"))).drop("_style")


def dense_features(reviews: DataFrame, perplexity: DataFrame | None = None,
                   sentiment_col: str | None = None) -> DataFrame:
    """``reviews`` plus the 22 features; ``perplexity(product_id, review_id, log_perplexity)`` may come from anywhere.

    Without it ``reviews`` hold that feature, as from ``with_log_perplexity``.
    """
    local = local_features(reviews, sentiment_col)
    return local if perplexity is None else join_by_review(local, perplexity)


@dataclass
class Scaler:
    """Mean and population deviation per feature; a constant feature is only centred."""

    features: list[str]
    mean: list[float]
    scale: list[float]

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str] = tuple(lx.DENSE_FEATURES)) -> Scaler:
        row = df.agg(*[F.avg(f).alias(f"m_{f}") for f in features],
                     *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
        return cls(list(features), [row[f"m_{f}"] or 0.0 for f in features],
                   [row[f"s_{f}"] if (row[f"s_{f}"] or 0.0) > 1e-12 else 1.0 for f in features])

    def z(self, feature: str, weight: float = 1.0) -> Column:
        k = self.features.index(feature)
        return (F.col(feature) - self.mean[k]) / self.scale[k] * weight

    def transform(self, df: DataFrame, weight: float = 1.0) -> DataFrame:
        """Replace the features by their standardised values."""
        return df.withColumns({f: self.z(f, weight) for f in self.features})

    def vector(self, weight: float = 1.0) -> Column:
        return F.array(*[self.z(f, weight) for f in self.features])
