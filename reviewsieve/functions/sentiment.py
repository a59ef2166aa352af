"""Lexicon sentiment in [-1, 1] as one column expression over a text column."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicons as lx
from .columns import by_name, contains_any, count_char, doubles, let, lookup

# One private-use character per phrase pattern marks where that pattern matched.
_FIRST_MARK = 0xE000
_MARKS = "".join(chr(_FIRST_MARK + k) for k in range(len(lx.PHRASES)))


def _head(pattern: str) -> str:
    """Plain text that every match of a phrase pattern starts with."""
    head = re.match(r"\\b([a-z0-9 ]+)", pattern)
    optional = pattern[head.end():head.end() + 1] == "?"
    return head.group(1)[:-1] if optional else head.group(1)


def mark_phrases(text: Column) -> Column:
    """Text in which every scored phrase is replaced by its mark, patterns taken in order.

    A pattern is tried only on texts that hold its head. Removing a phrase leaves
    at least three non-word characters, so it never completes another one.
    """
    def build(clean: Column) -> Column:
        def mark(lowered: Column) -> Column:
            marked = clean
            for k, (pattern, _) in enumerate(lx.PHRASES):
                marked = let(marked, lambda m: F.when(
                    F.contains(lowered, F.lit(_head(pattern))),
                    F.regexp_replace(m, "(?iU)" + pattern, _MARKS[k])).otherwise(m))
            return F.when(contains_any(lowered, [_head(p) for p, _ in lx.PHRASES]), marked).otherwise(clean)
        return let(F.lower(clean), mark)
    # marks already in the text must not count; both characters are neither space nor word
    return let(F.translate(text, _MARKS, "\x01" * len(_MARKS)), build)


def phrase_total(marked: Column) -> Column:
    marks = F.regexp_extract_all(marked, F.lit(f"[{_MARKS[0]}-{_MARKS[-1]}]"), F.lit(0))
    values = doubles([v for _, v in lx.PHRASES])
    return F.aggregate(marks, F.lit(0.0), lambda acc, m: acc + values[F.ascii(m) - _FIRST_MARK])


def unmarked(marked: Column) -> Column:
    return F.translate(marked, _MARKS, " " * len(_MARKS))


def _is_negator(token: Column) -> Column:
    return token.isin(lx.NEGATORS) | token.endswith(lx.NEGATOR_SUFFIX)


def token_contributions(tokens: Column) -> Column:
    """array<double> parallel to ``tokens``: what each adds to the raw total, null for most."""
    def build(toks: Column) -> Column:
        contrast = F.array_max(F.transform(toks, lambda t, i: F.when(t.isin(lx.CONTRAST), i)))

        def one(last: Column):
            def value(tok: Column, i: Column) -> Column:
                before = F.get(toks, i - 1)
                window = F.slice(toks, F.greatest(i - lx.NEGATION_WINDOW, F.lit(0)) + 1,
                                 F.least(i, F.lit(lx.NEGATION_WINDOW)))
                return (lookup(tok, lx.POSITIVE | lx.NEGATIVE)
                        * F.coalesce(lookup(before, lx.BOOSTERS), F.lit(1.0))
                        * F.when(F.exists(window, _is_negator), lx.NEGATION_FACTOR).otherwise(1.0)
                        * F.when(last.isNull(), 1.0).when(i > last, lx.AFTER_CONTRAST)
                        .otherwise(lx.BEFORE_CONTRAST))
            return F.transform(toks, value)
        return let(contrast, one)
    return let(tokens, build)


def _tokens(marked: Column) -> Column:
    from .text import tokens_lower
    return tokens_lower(marked)


def raw_total(marked: Column) -> Column:
    """Phrase and word values plus the exclamation bonus, before normalisation."""
    total = F.aggregate(token_contributions(_tokens(marked)), phrase_total(marked),
                        lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))
    bonus = F.least(count_char(marked, "!"), F.lit(lx.EXCLAMATION_CAP)) * lx.EXCLAMATION_WEIGHT
    return let(total, lambda t: F.when(t != 0, t + F.signum(t) * bonus).otherwise(F.lit(0.0)))


@by_name
def sentiment(text: Column) -> Column:
    """Sentiment of a text; 0 for a text without any scored word or phrase."""
    return let(mark_phrases(text), lambda m: let(
        raw_total(m), lambda t: t / F.sqrt(t * t + lx.SENTIMENT_ALPHA)))


@by_name
def token_sentiment(text: Column) -> Column:
    """array<struct<token, contribution>> of the tokens that carry a value."""
    def pairs(toks: Column) -> Column:
        zipped = F.arrays_zip(toks.alias("token"), token_contributions(toks).alias("contribution"))
        return F.filter(zipped, lambda z: z["contribution"].isNotNull())
    return let(_tokens(mark_phrases(text)), pairs)
