"""Small column helpers shared by the other function modules."""
from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_built: dict[tuple, Column] = {}
REVIEW_KEYS = ("product_id", "review_id")


def review_keys(*frames: DataFrame) -> list[str]:
    """The columns that identify a review, as far as all frames have them: ids may repeat over products."""
    return [k for k in REVIEW_KEYS if all(k in f.columns for f in frames)]


def join_by_review(reviews: DataFrame, facts: DataFrame) -> DataFrame:
    """``reviews`` with the other columns of ``facts``; a null in a key equals a null."""
    keys = review_keys(reviews, facts)
    named = facts.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in facts.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return reviews.join(named, same, "left").drop(*[f"_key_{k}" for k in keys])


def by_name(build: Callable[[Column], Column]) -> Callable[[Column | str], Column]:
    """Let ``build`` take a column name too, and keep what it built for a name.

    Large expressions take the driver a while to put together; over a plain
    column name they are the same in every query of an application.
    """
    @functools.wraps(build)
    def wrapper(column: Column | str) -> Column:
        if not isinstance(column, str):
            return build(column)
        key = (SparkContext._active_spark_context.applicationId, build.__module__, build.__qualname__, column)
        if key not in _built:
            _built[key] = build(F.col(column))
        return _built[key]
    return wrapper


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def word_map(values: dict[str, float]) -> Column:
    """A constant map, folded to a literal by the optimizer."""
    text = ",".join(f"{word}:{value!r}" for word, value in values.items())
    return F.str_to_map(F.lit(text), F.lit(","), F.lit(":")).cast("map<string,double>")


def lookup(words: Column, values: dict[str, float]) -> Column:
    """Value of a word or null. The set test keeps the many words without a value cheap."""
    return F.when(words.isin(list(values)), F.element_at(word_map(values), words))


def contains_any(lowered: Column, words: Sequence[str]) -> Column:
    """Does the lower-case text hold one of the words? Cheap test in front of a pattern."""
    needed = [w for w in dict.fromkeys(words) if not any(o != w and o in w for o in words)]
    out = F.contains(lowered, F.lit(needed[0]))
    for word in needed[1:]:
        out = out | F.contains(lowered, F.lit(word))
    return out


def doubles(values: Sequence[float]) -> Column:
    """A constant array of doubles, folded to a literal by the optimizer."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def strings(values: Sequence[str]) -> Column:
    """A constant array of strings without line breaks, folded to a literal by the optimizer."""
    return F.split(F.lit("\n".join(values)), "\n")


def count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def count_chars(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def share(items: Column, test: Callable[[Column], Column], total: Column) -> Column:
    return F.size(F.filter(items, test)) / total


def positions(count: Column) -> Column:
    """0 .. count-1 as an array, empty for 0."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
