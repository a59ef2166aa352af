"""Text splitting as column expressions; no shuffle, no Python workers."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicons as lx
from .columns import contains_any, let, positions


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(lx.SPACES))


def _pieces(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern), strip), lambda s: s != "")


def sentences(text: Column) -> Column:
    return _pieces(text, lx.SENTENCE_BREAK)


def clauses(sentence: Column) -> Column:
    whole = F.filter(F.array(strip(sentence)), lambda s: s != "")
    return F.when(contains_any(F.lower(sentence), lx.CLAUSE_SIGNS),
                  _pieces(sentence, lx.CLAUSE_BREAK)).otherwise(whole)


def segments(clause: Column) -> Column:
    return _pieces(clause, lx.SEGMENT_BREAK)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(lx.WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(lx.WORD))


def tokens_lower(text: Column) -> Column:
    return F.transform(words(text), F.lower)


def term_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(lx.TERM_TOKEN), F.lit(0))


def adjacent(tokens: Column) -> Column:
    """array<struct<prev, cur>> of neighbouring tokens."""
    n = F.size(tokens)
    return F.arrays_zip(
        F.slice(tokens, 1, F.greatest(n - 1, F.lit(0))).alias("prev"),
        F.slice(tokens, 2, F.greatest(n - 1, F.lit(0))).alias("cur"),
    )


def ngrams(tokens: Column) -> Column:
    """All tokens followed by all pairs of neighbours joined with a space."""
    return let(tokens, lambda t: F.concat(
        t, F.transform(positions(F.size(t) - 1), lambda i: F.concat_ws(" ", t[i], t[i + 1]))))


def counted(items: Column) -> Column:
    """array<struct<item, n>>: how often each distinct item occurs, worked out inside the row."""
    def runs(s: Column) -> Column:
        size = F.size(s)
        starts = F.filter(positions(size), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda b: F.transform(b, lambda i, k: F.struct(
            s[i].alias("item"),
            (F.coalesce(F.get(b, k + 1), size) - i).alias("n"))))
    return let(F.sort_array(items), runs)


def match_spans(text: Column, pattern: Column) -> Column:
    """array<struct<start, stop, hit>> of all matches, as 0-based character offsets.

    Splitting and extracting with one pattern give the gaps and the hits in turn;
    running lengths turn them into offsets.
    """
    def build(hits: Column) -> Column:
        gaps = F.split(text, pattern, F.lit(-1))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(
            "array<struct<start:int,stop:int,hit:string>>").alias("spans"))

        def step(acc: Column, piece: Column) -> Column:
            begin = acc["at"] + F.length(piece["gap"])
            end = begin + F.length(piece["hit"])
            span = F.struct(begin.alias("start"), end.alias("stop"), piece["hit"].alias("hit"))
            return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

        pieces = F.slice(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), F.lit(1), F.size(hits))
        return F.aggregate(pieces, start, step, lambda acc: acc["spans"])

    empty = F.array().cast("array<struct<start:int,stop:int,hit:string>>")
    return let(F.regexp_extract_all(text, pattern, F.lit(0)),
               lambda hits: F.when(F.size(hits) > 0, build(hits)).otherwise(empty))


def phrase_pattern(phrase: Column) -> Column:
    """Pattern that finds the words of a phrase with anything but word characters between them."""
    return F.concat(F.lit(r"(?iU)\b\Q"),
                    F.array_join(F.split(strip(phrase), f"(?U){lx.WS}+"), r"\E\W+\Q"), F.lit(r"\E\b"))


def phrase_spans(text: Column, phrases: Column) -> Column:
    """array<struct<start, stop>>: where the phrases occur, overlapping and touching spans merged."""
    usable = F.filter(F.array_distinct(phrases), lambda p: strip(p) != "")
    spans = F.flatten(F.transform(usable, lambda p: match_spans(text, phrase_pattern(p))))
    spans = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))
    none = F.array().cast("array<struct<start:int,stop:int>>")

    def step(acc: Column, s: Column) -> Column:
        n = F.size(acc)
        last = F.get(acc, n - 1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))
        return F.when((n > 0) & (s["start"] <= last["stop"]),
                      F.concat(F.slice(acc, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(joined))
                      ).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, none, step)


def escape_html(text: Column) -> Column:
    for char, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]:
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def highlight(text: Column, phrases: Column, tag: str = "mark") -> Column:
    """Escaped text with every occurrence of the phrases inside ``<tag>``."""
    def part(begin: Column, end: Column) -> Column:
        return escape_html(F.substring(text, begin + 1, end - begin))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        return F.struct(s["stop"].alias("at"), F.concat(
            acc["out"], part(acc["at"], s["start"]), F.lit(f"<{tag}>"),
            part(s["start"], s["stop"]), F.lit(f"</{tag}>")).alias("out"))

    return F.aggregate(phrase_spans(text, phrases), start, step,
                       lambda acc: F.concat(acc["out"], part(acc["at"], F.length(text))))
