"""Language identification as a mixture: per document, expectation-maximisation over n-gram likelihoods.

Learning counts hashed character trigrams inside words, per language, over every labelled row given. Prediction treats
a text as drawn from a mixture of the languages: EM estimates the proportions, languages are tried in the order of
their share, and one more is kept as long as the penalised likelihood improves. The predicted language is the one of
the largest share, the score is that share. The model (languages x 32,768 floats) is broadcast; nothing is shuffled
but the counts.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without labelled rows every text is
``und``; a text none of whose trigrams can be counted goes to the most frequent language; null labels teach nothing;
ties go to the language that sorts first; result columns replace columns of the same name.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks

BUCKETS = 1 << 15
STEPS = 12             # EM steps per set of languages
PENALTY = 3.0          # times log(trigrams) for each further language; half of that for independent draws, but each
#                        letter is part of three trigrams and documents are burstier than the model
SMOOTHING = 0.5
MIN_SCORE = 0.5        # share of the main language below which ``accept`` rejects a text
UNKNOWN = "und"
_SPACE = 32
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Lower-case letter for each code of the basic plane, a space for what is no letter."""
    global _letters
    if _letters is None:
        table = np.full(0x110000, _SPACE, dtype=np.uint32)
        for code in range(0x10000):
            char = chr(code)
            if char.isalpha():
                low = char.lower()
                table[code] = ord(low) if len(low) == 1 else code
        # letters of the other planes: scripts and ideographs stand in these ranges
        table[0x10000:0x1F000] = [c if chr(c).isalpha() else _SPACE for c in range(0x10000, 0x1F000)]
        table[0x20000:0x32000] = [c if chr(c).isalpha() else _SPACE for c in range(0x20000, 0x32000)]
        _letters = table
    return _letters


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of all texts one after the other, where each text's begin, and the letters of each text."""
    table = _letter_table()
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    codes = table[np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le"), dtype=np.uint32)]
    starts = np.concatenate(([0], np.cumsum(lengths)))  # of the space before each text
    letters_before = np.concatenate(([0], np.cumsum(codes != _SPACE)))
    letters = letters_before[starts[1:]] - letters_before[starts[:-1]]
    repeated = (codes == _SPACE) & np.concatenate(([False], codes[:-1] == _SPACE))
    where = np.flatnonzero(~repeated)
    codes = codes[where]
    middle = np.flatnonzero(codes[1:-1] != _SPACE) + 1
    mixed = (codes[middle - 1] * np.uint32(0x9E3779B1)) ^ (codes[middle] * np.uint32(0x85EBCA77))
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE3D) + codes[middle + 1] * np.uint32(0x27D4EB2F)
    mixed ^= mixed >> np.uint32(13)
    buckets = (mixed * np.uint32(0x165667B1)) >> np.uint32(17)
    return buckets, np.searchsorted(where[middle], starts), letters


class Model:
    """Likelihood ratios of the languages by bucket, relative to the likeliest language of the bucket."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        if self.languages:
            table = np.stack([counts[lang] for lang in self.languages], axis=1) + SMOOTHING
            self.sizes = table.sum(axis=0)
            table = table / self.sizes
            self.ratio = (table / table.max(axis=1, keepdims=True)).astype(np.float32)
            self.log_ratio = np.log(self.ratio)

    def proportions(self, buckets: np.ndarray) -> dict[str, float]:
        """Selected languages and their shares, by the penalised likelihood."""
        counts = np.bincount(buckets, minlength=BUCKETS)
        used = np.flatnonzero(counts)
        weight = counts[used].astype(np.float32)
        n = float(len(buckets))
        if not n:
            return {self.languages[int(np.argmax(self.sizes))]: 1.0}
        ratio = self.ratio[used]
        single = weight @ self.log_ratio[used]
        best = int(np.argmax(single))
        if len(self.languages) == 1:
            return {self.languages[0]: 1.0}
        full, _ = _mixture(ratio, weight, n)
        order = [best] + [k for k in np.argsort(-full, kind="stable") if k != best]
        chosen, shares, value = [best], np.ones(1), float(single[best])
        for size in range(2, len(order) + 1):
            share, likelihood = _mixture(ratio[:, order[:size]], weight, n)
            if likelihood - value <= PENALTY * np.log(n):
                break
            chosen, shares, value = order[:size], share, likelihood
        return {self.languages[k]: float(s) for k, s in zip(chosen, shares)}


def _mixture(ratio: np.ndarray, weight: np.ndarray, n: float) -> tuple[np.ndarray, float]:
    """Shares that EM finds, and their log likelihood."""
    share = np.full(ratio.shape[1], 1 / ratio.shape[1], dtype=np.float32)
    flipped = np.ascontiguousarray(ratio.T)
    for _ in range(STEPS):
        share = share * (flipped @ (weight / (ratio @ share))) / np.float32(n)
    return share / share.sum(), float(weight @ np.log(ratio @ share))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count the trigrams of every labelled text by language. The driver gets languages x buckets sums."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            at = 0
            for texts in chunks(batch["text"]):
                langs = batch["lang"].iloc[at:at + len(texts)]
                at += len(texts)
                buckets, starts, _ = trigrams(texts)
                for k, lang in enumerate(langs):
                    if lang not in sums:
                        sums[lang] = np.zeros(BUCKETS, dtype=np.int64)
                    sums[lang] += np.bincount(buckets[starts[k]:starts[k + 1]], minlength=BUCKETS)
        for lang, values in sums.items():
            used = np.flatnonzero(values)
            yield pd.DataFrame({"lang": lang, "bucket": used.astype(np.int32), "n": values[used]})
            yield pd.DataFrame({"lang": [lang], "bucket": np.array([-1], np.int32), "n": [1]})

    rows = labelled.filter(F.col(lang_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sums = (rows.mapInPandas(count, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    counts = {}
    for lang, part in sums.groupby("lang"):
        counts[lang] = np.zeros(BUCKETS)
        part = part[part["bucket"] >= 0]
        counts[lang][part["bucket"].to_numpy()] = part["n"].to_numpy()
    return Model(counts)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``lang_mix`` (share by selected language) to every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, lang_mix map<string,double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fitted = shared.value
        for series in batches:
            rows = []
            for texts in chunks(series):
                buckets, starts, letters = trigrams(texts)
                for k in range(len(texts)):
                    if not letters[k] or not fitted.languages:
                        rows.append((UNKNOWN, 0.0, {}))
                        continue
                    mix = fitted.proportions(buckets[starts[k]:starts[k + 1]])
                    lang = min(mix, key=lambda name: (-mix[name], name))
                    rows.append((lang, min(1.0, max(0.0, mix[lang])), mix))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "lang_mix"])

    predict = predict.asNondeterministic()  # evaluated once, also below a filter on its result
    return (docs.drop("lang_pred", "score", "lang_mix").withColumn("_id", predict(F.col(text_col)))
            .select("*", "_id.*").drop("_id"))


def accept(min_score: float = MIN_SCORE) -> Column:
    """Has the text a language, and does its main language make up enough of it?"""
    return (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)
