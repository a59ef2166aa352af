"""Why a review is suspected: phrases and plain-English reasons, worked out inside each row."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions.columns import doubles, strings

_KEPT = "array<struct<phrase:string,weight:double,words:array<string>>>"


def telling(term: Column) -> Column:
    """False for n-grams made of stop words only."""
    return ~F.forall(F.split(term, " "), lambda w: w.isin(lx.STOPWORDS))


def pick_phrases(candidates: Column, k: int = lx.TOP_PHRASES) -> Column:
    """Heaviest ``k`` of array<struct<phrase, weight>>, none with all words of another one kept.

    Candidates are taken by weight; a phrase whose words include, or are
    included in, those of a kept phrase is dropped. ``k`` kept phrases end it.
    """
    def overlaps(words: Column, kept: Column) -> Column:
        return F.exists(kept, lambda o: (F.size(F.array_except(words, o["words"])) == 0)
                        | (F.size(F.array_except(o["words"], words)) == 0))

    def step(kept: Column, c: Column) -> Column:
        words = F.split(c["phrase"], " ")
        entry = F.struct(c["phrase"].alias("phrase"), (-c["down"]).alias("weight"), words.alias("words"))
        return F.when((F.size(kept) >= k) | overlaps(words, kept), kept).otherwise(F.concat(kept, F.array(entry)))

    ordered = F.sort_array(F.transform(candidates, lambda c: F.struct(
        (-c["weight"]).alias("down"), c["phrase"].alias("phrase"))))
    return F.aggregate(ordered, F.array().cast(_KEPT), step, lambda kept: F.transform(
        kept, lambda o: F.struct(o["phrase"].alias("phrase"), o["weight"].alias("weight"))))


def phrases(indices: Column, contributions: Column, terms: Sequence[str], k: int = lx.TOP_PHRASES) -> Column:
    """Top phrases of a row from its term numbers and their contributions."""
    names = strings(terms)
    pushing = F.filter(F.arrays_zip(indices.alias("idx"), contributions.alias("weight")), lambda c: c["weight"] > 0)
    named = F.transform(pushing, lambda c: F.struct(
        F.element_at(names, c["idx"] + 1).alias("phrase"), c["weight"].alias("weight")))
    return pick_phrases(F.filter(named, lambda c: telling(c["phrase"])), k)


def reasons(z: Column, coefficients: Sequence[float], features: Sequence[str] = tuple(lx.DENSE_FEATURES),
            k: int = lx.TOP_REASONS) -> Column:
    """Top reasons of a row; ``z`` is the array of standardised features."""
    wording = [lx.REASONS.get(f, (f + " (high)", f + " (low)")) for f in features]
    weights, high, low = doubles(coefficients), strings([w[0] for w in wording]), strings([w[1] for w in wording])
    entries = F.transform(z, lambda v, i: F.struct(
        (-(v * weights[i])).alias("down"), i.alias("i"), F.when(v > 0, high[i]).otherwise(low[i]).alias("reason")))
    pushing = F.filter(entries, lambda e: e["down"] < 0)
    return F.transform(F.slice(F.sort_array(pushing), 1, k),
                       lambda e: F.struct(e["reason"].alias("reason"), (-e["down"]).alias("weight")))


def top_terms(coefficients: DataFrame, k: int = 25) -> DataFrame:
    """(side, rank, term, coef): the k most fake and the k most genuine terms of the model."""
    from pyspark.sql import Window
    fake = coefficients.orderBy(F.desc("coef"), F.desc("term")).limit(k).select(
        F.lit("fake").alias("side"), "term", "coef", (-F.col("coef")).alias("o"), (F.lit(1)).alias("s"))
    real = coefficients.orderBy("coef", "term").limit(k).select(
        F.lit("genuine").alias("side"), "term", "coef", F.col("coef").alias("o"), F.lit(0).alias("s"))
    fake = fake.withColumn("rank", F.row_number().over(Window.partitionBy("side").orderBy("o", F.desc("term"))))
    real = real.withColumn("rank", F.row_number().over(Window.partitionBy("side").orderBy("o", "term")))
    return fake.unionByName(real).select("side", "rank", "term", "coef")


def strongest_features(coefficients: DataFrame, k: int = 8) -> DataFrame:
    """The k dense features with the largest absolute coefficient."""
    return coefficients.orderBy(F.desc(F.abs("coef")), "feature").limit(k)
