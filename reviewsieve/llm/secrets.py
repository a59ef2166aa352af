"""Secret scan: three pattern kinds, and novelty measured with a dictionary-primed zstandard compressor.

A candidate of the fourth kind is a long token of mixed characters within 40 characters of a sensitive word, before or
after it. A token ends at ``=``, so a name and its value are two; of a token that holds a sensitive word itself, what
follows or precedes the word is a candidate, too. Its marginal size is what a
compressor, primed with a dictionary of identifiers and with the code around the candidate, needs for the text with
it beyond the text without it. What repeats names, words or the surrounding text costs little; a candidate that costs
about a byte per character is random, and is reported as ``novel``. Among other random strings the compressor's literal
codes are tuned to them, and a random candidate costs no more than the entropy of its alphabet. So a candidate at that
entropy is reported too if it costs about a byte per character in fixed prose, where names and words do not.

Row-local: no shuffle, nothing broadcast but the dictionary. Defined cases: null and empty texts have no spans; offsets
count code points, end exclusive; ``spans`` replaces a column of that name.
"""
from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewsieve.functions.columns import let

KINDS = ("assign", "access", "hex", "novel")
CONTEXT = 40           # characters on either side of a candidate in which a sensitive word makes it one
SURROUNDING = 1024     # characters on either side that prime the compressor
MIN_TOKEN = 16
NOVELTY = 0.8          # marginal bytes per character from which a candidate is reported
ENTROPY = 0.9          # the same as a share of the entropy of its alphabet, for candidates that are novel in prose
HEADER = 3             # bytes by which a candidate's share of the block headers varies
PIECE = 32             # characters compressed at once in prose, since literal codes adapt to a long candidate
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
SENSITIVE = re.compile(r"password|passwd|secret|token|api.?key|credential|bearer|auth|private|signature|session",
                       re.IGNORECASE | re.ASCII)
# a run of 16 characters or more, with the padding of base64; `=` before other characters ends a name
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
JOINT = "+/_=-"        # stripped where a candidate is cut from a sensitive word
IDENTIFIERS = (
    "access account address admin algorithm alpha application argument array async attribute authorization await "
    "backend base64 boolean bucket buffer build cache callback certificate character class client cluster code "
    "column command comment commit config configuration connection constant container content context controller "
    "cookie copyright count create credential current data database debug default delete description destination "
    "development device dictionary directory document domain double download element email enabled encoding "
    "endpoint environment error event exception execute export extension factory false field file filter final "
    "float folder format function gateway generate global group handler hash header height host http https "
    "identifier image implementation import index info initialize input instance integer interface internal "
    "iterator javascript json kernel language length library license limit list local location login logger "
    "machine manager message metadata method middleware module network node null number object observer option "
    "organization output package page parameter parent parser password path pattern payload pipeline platform "
    "pointer policy port prefix private process production project property protocol provider proxy public query "
    "queue random record redirect reference region register registry release remote repository request resource "
    "response result return role root route runtime schema scope script secret security select sequence serial "
    "server service session settings signature size source stack standard state static status storage stream "
    "string struct subscription success suffix system table target task template test text thread timeout "
    "timestamp title token tracking transaction transform true type undefined unicode update upload user username "
    "value variable vector version view virtual volume warning width window worker workspace wrapper "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000 11111111 ffffffff xxxxxxxx")

PROSE = (
    "The committee met again on the second day of the month and agreed that most of the work should go on as planned. "
    "People who live near the river had asked for a new bridge, because the old one is closed whenever the water is "
    "high, and children then have to walk for an hour to reach their school. A few members thought this was too much "
    "money for a small place; others said that every village in the valley would use it. In the end they voted to ask "
    "an engineer for advice before winter. Nobody expects quick results, yet the mood was better than last year, when "
    "the meeting broke up after a quarrel about taxes, just as visitors from abroad were being shown around the hall. ")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the pattern kinds, in no order."""
    out = []
    low = text.lower()
    if any(name in low for name in NAMES):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return out


class Novelty:
    """Marginal compressed bytes of a string, given a dictionary and the text around it."""

    def __init__(self, identifiers: str = IDENTIFIERS):
        words = identifiers.split()
        prime = " ".join([*words, *(w.capitalize() for w in words), *(w.upper() for w in words)]).encode()
        self.compressor = zstandard.ZstdCompressor(level=9, write_content_size=False, dict_data=(
            zstandard.ZstdCompressionDict(prime, dict_type=zstandard.DICT_TYPE_RAWCONTENT)))
        self.prose = (PROSE + PROSE[:SURROUNDING - len(PROSE)]).encode()
        self.prose_size = len(self.compressor.compress(self.prose))

    def marginal(self, before: str, candidate: str, after: str) -> int:
        around = (before + after).encode()
        return len(self.compressor.compress(around + candidate.encode())) - len(self.compressor.compress(around))

    def strange(self, candidate: str) -> bool:
        """Is any piece of the candidate novel in prose?"""
        cuts = [*range(0, max(1, len(candidate) - MIN_TOKEN + 1), PIECE), len(candidate)]
        return any(len(self.compressor.compress(self.prose + candidate[a:b].encode())) - self.prose_size
                   >= NOVELTY * (b - a) for a, b in zip(cuts, cuts[1:]))

    def is_novel(self, before: str, candidate: str, after: str) -> bool:
        size = self.marginal(before, candidate, after)
        return size >= NOVELTY * len(candidate) or (
            size >= ENTROPY * entropy(candidate) - HEADER and self.strange(candidate))


def entropy(token: str) -> float:
    """Bytes of a random string of that length over the token's alphabet: its hexadecimal digits, or the digits and
    cases it has, and its signs."""
    plain = re.sub(r"[^A-Za-z0-9]", "", token)
    if re.fullmatch(r"[0-9a-f]*|[0-9A-F]*", plain):
        letters = 16
    else:
        letters = sum(n for n, kind in ((10, "[0-9]"), (26, "[a-z]"), (26, "[A-Z]")) if re.search(kind, plain))
    return len(token) * math.log2(letters + len(set(token) - set(plain))) / 8


def novel_spans(text: str, taken: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """Incompressible tokens in a sensitive context, apart from the spans taken. Texts without a sensitive word are
    not searched for tokens; the cost follows the tokens near such words."""
    words = [m.span() for m in SENSITIVE.finditer(text)]
    if not words:
        return []
    starts = [s for s, _ in words]
    apart: list[list[int]] = []  # the spans taken, overlapping ones as one
    for s, e, _ in sorted(taken):
        if apart and s <= apart[-1][1]:
            apart[-1][1] = max(apart[-1][1], e)
        else:
            apart.append([s, e])
    out = []
    for m in TOKEN.finditer(text):
        start, end = m.span()
        last = bisect_right(starts, end + CONTEXT) - 1
        if last < 0 or words[last][1] < start - CONTEXT:
            continue
        for s, e in candidates(text, start, end, words, starts):
            token = text[s:e]
            if e - s < MIN_TOKEN or not (re.search(r"[0-9]", token) and re.search(r"[A-Za-z]", token)):
                continue
            before = bisect_left(apart, [e]) - 1
            if before >= 0 and apart[before][1] > s:
                continue
            if novelty.is_novel(text[max(0, s - SURROUNDING):s], token, text[e:e + SURROUNDING]):
                out.append((s, e, 3))
                break
    return out


def candidates(text: str, start: int, end: int, words: list[tuple[int, int]],
               starts: list[int]) -> Iterator[tuple[int, int]]:
    """The token; if it holds sensitive words, also what follows the last and what precedes the first of them."""
    yield start, end
    first, last = bisect_left(starts, start), bisect_left(starts, end) - 1
    if first <= last:
        tail, head = text[words[last][1]:end], text[start:words[first][0]]
        yield end - len(tail.lstrip(JOINT)), end
        yield start, start + len(head.rstrip(JOINT))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``spans``: array of (kind, start, end) by start, then kind in the order of ``KINDS``."""
    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        novelty = Novelty()
        for texts in batches:
            rows = []
            for text in texts:
                if not text:
                    rows.append([])
                    continue
                spans = base_spans(text)
                spans += novel_spans(text, spans, novelty)
                rows.append([{"kind": KINDS[k], "start": s, "end": e}
                             for s, e, k in sorted(spans, key=lambda x: (x[0], x[2]))])
            yield pd.Series(rows, dtype=object)

    return docs.withColumn("spans", find.asNondeterministic()(F.col(text_col)))


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones as one, replaced by ``mark``; other texts as they are."""
    last = lambda acc: F.when(F.size(acc) > 0, F.element_at(acc, -1)["end"]).otherwise(F.lit(-1))
    piece = lambda s, e: F.array(F.struct(s.alias("start"), e.alias("end")))
    joined = F.aggregate(
        spans, F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, s: F.when(s["start"] >= last(acc), F.concat(acc, piece(s["start"], s["end"]))).otherwise(F.concat(
            F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
            piece(F.element_at(acc, -1)["start"], F.greatest(last(acc), s["end"])))))
    def parts(j: Column) -> Column:  # of the joined spans, worked out once
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(j, i - 1)["end"])
        return F.array_join(F.concat(
            F.transform(j, lambda s, i: F.substring(text, before(i) + 1, s["start"] - before(i))),
            F.array(F.substring(text, F.element_at(j, -1)["end"] + 1, F.length(text)))), mark)

    return F.when(F.size(spans) > 0, let(joined, parts)).otherwise(text)
