"""The 22 dense features of a review, except the language-model one, as row-local columns."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicons as lx
from .columns import by_name, count_char, count_chars, let, share
from .text import sentences, word_count, words


@by_name
def style(text: Column) -> Column:
    """struct of the 18 writing-style features, in fixed order."""
    def build(ws: Column) -> Column:
        return let(F.transform(ws, F.lower), lambda lw: let(
            let(sentences(text), lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(text))), lambda ss: let(
                F.transform(ss, word_count), lambda lens: let(
                    _mean(lens), lambda mean: _fields(text, ws, lw, ss, lens, mean)))))
    return let(words(text), build)


def _mean(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x) / F.size(numbers)


def _fields(text: Column, ws: Column, lw: Column, ss: Column, lens: Column, mean: Column) -> Column:
    n = F.size(ws)
    total = F.greatest(n, F.lit(1))
    n_sents = F.size(ss)
    zero = F.lit(0.0)
    letters = F.greatest(F.length(text) - F.length(F.regexp_replace(text, r"\p{L}+", "")), F.lit(1))
    spread = F.sqrt(_mean(F.transform(lens, lambda x: (x - mean) * (x - mean))))
    value = {
        "n_words": F.log1p(n.cast("double")),
        "n_sentences": n_sents.cast("double"),
        "avg_word_len": F.when(n > 0, F.length(F.array_join(ws, "")) / n).otherwise(zero),
        "avg_sent_len": mean,
        "sent_len_std": spread,
        "type_token_ratio": F.size(F.array_distinct(lw)) / total,
        "stopword_ratio": share(lw, lambda w: w.isin(lx.STOPWORDS), total),
        "first_person_ratio": share(lw, lambda w: w.isin(lx.FIRST_PERSON), total),
        "second_person_ratio": share(lw, lambda w: w.isin(lx.SECOND_PERSON), total),
        "superlative_ratio": share(lw, lambda w: w.isin(lx.SUPERLATIVES), total),
        "hedge_ratio": share(lw, lambda w: w.isin(lx.HEDGES), total),
        "exclamations": count_char(text, "!").cast("double"),
        "questions": count_char(text, "?").cast("double"),
        "punct_ratio": count_chars(text, lx.PUNCTUATION) / total,
        "upper_ratio": F.regexp_count(text, F.lit(r"\p{Lu}")) / letters,
        "digit_ratio": F.regexp_count(text, F.lit(r"\p{Nd}")) / F.greatest(F.length(text), F.lit(1)),
        "lowercase_sentence_starts": share(ss, lambda s: F.rlike(s, F.lit(r"^\p{Ll}")), n_sents),
        "repeated_chars": F.regexp_count(text, F.lit(r"(?d)(.)\1{2,}")).cast("double"),
    }
    return F.struct(*[value[name].alias(name) for name in lx.STYLE_FEATURES])


def known_rating(rating: Column) -> Column:
    """Rating with NaN turned into null."""
    return F.nanvl(rating.cast("double"), F.lit(None).cast("double"))


def rating_extremity(rating: Column) -> Column:
    return F.coalesce(F.abs(known_rating(rating) - 3.0) / 2.0, F.lit(0.0))


def rating_mismatch(rating: Column, sentiment: Column) -> Column:
    return F.coalesce(F.abs((known_rating(rating) - 3.0) / 2.0 - sentiment) / 2.0, F.lit(0.0))
