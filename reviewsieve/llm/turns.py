"""Repair of conversation structure: Wagner-Fischer alignment of the turns with an alternating grammar.

A sound conversation is empty or an optional system turn followed by pairs of a user and an assistant turn: its role
initials are ``(s?(ua)+)?``. The grammar has one string per length, so a conversation is aligned with the string of
every feasible length, and the cheapest alignment is its repair. Edits: Keep (0), Rerole to user or assistant (1),
Delete (2; required for blank and duplicate turns), Insert an empty user or assistant turn (5). A truncated turn that
stays costs 5 more. Among equal costs the audit (the initials of the edits in order) that is least in ASCII wins.

All strings end in the same alternation, so one table of costs, anchored at the end, serves every length. Its rows are
cut to Ukkonen's band: cells that the incumbent cost cannot reach are left out. A narrow band gives the incumbent, and
if that is beyond what the band proves, a second pass with the incumbent's band is exact. Every further row and cell is
numpy work; only each n-th row is kept, and the walk forward works out the rows between again. That walk follows all
cheapest lengths at once and drops those whose next edit is not the least.

Turns are shuffled once by conversation, sorted, and repaired as they stream by; a task holds one conversation. Work
grows with the turns times the cost of the damage.

Defined cases: null roles and texts are one space (so such a text is blank); a null id is a conversation; turns are
ordered by turn (nulls first), role and text, so ties and repeated rows have one order, and a repeated row is a
duplicate; a role without characters fits no place of the grammar; very long texts are only compared and carried;
an empty table gives no rows; extra columns are ignored.
"""
from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import schema

RETYPE, DROP, ADD, UNFINISHED = 1, 2, 5, 5  # what the edits cost, and what a truncated turn that stays adds
FAR = 1 << 40
ROLES = {"u": "user", "a": "assistant"}
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
LEGAL = {"su", "ua", "au"}
ROWS_OUT = 2000


@dataclass
class Faults:
    """What is wrong with the turns of a conversation."""

    kinds: list[str]  # "", "blank", "duplicate" or "truncated", by turn
    gaps: int
    illegal: int

    def count(self, kind: str) -> int:
        return self.kinds.count(kind)


def faults(numbers: list[int | None], roles: list[str], texts: list[str]) -> Faults:
    """First fault of every turn, missing turn numbers, and neighbours whose roles do not follow each other."""
    kinds, seen = [], set()
    for role, text in zip(roles, texts):
        bare = text.strip(SPACE)
        kinds.append("blank" if not bare else "duplicate" if (role, text) in seen
                     else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    known = {n for n in numbers if n is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    return Faults(kinds, gaps, sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:])))


class Alignment:
    """Costs of aligning turns ``i..`` with the last ``r`` places of the alternation, within a band.

    ``initials`` and ``late`` (truncated) describe the turns that may stay. Deleting a late turn is the least it can
    cost, so costs are counted beyond that: it is free to delete one, keeping one costs three. A path then leaves the
    diagonal of the sound turns only by inserts and late turns that stay (three or more each) or by deletions of sound
    turns (two each), which gives the band.
    """

    def __init__(self, initials: Sequence[str], late: Sequence[bool]):
        self.initials, self.m = initials, len(initials)
        self.drop = [0 if l else DROP for l in late]
        self.keep = [UNFINISHED - DROP if l else 0 for l in late]
        self.sound = np.concatenate([np.cumsum([not l for l in late][::-1])[::-1], [0]]).astype(int)
        self.every = int(self.m ** 0.5) + 1

    def bounds(self, i: int) -> tuple[int, int]:
        return max(0, int(self.sound[i]) - self.limit // DROP), int(self.sound[i]) + self.limit // 3

    def at(self, row: np.ndarray, i: int, r: np.ndarray) -> np.ndarray:
        """Cells of row i; beyond the band they are far."""
        k = r - self.bounds(i)[0]
        inside = (k >= 0) & (k < len(row))
        return np.where(inside, row[np.where(inside, k, 0)], FAR)

    def change(self, i: int, r: np.ndarray) -> np.ndarray:
        """Cost of letting turn i stand at the place with r places left: kept if its initial fits, else reroled."""
        fits = (r % 2 == 0) if self.initials[i] == "u" else (r % 2 == 1) if self.initials[i] == "a" else r < 0
        return self.keep[i] + np.where(fits, 0, RETYPE)

    def row(self, i: int, below: np.ndarray | None) -> np.ndarray:
        r = np.arange(self.bounds(i)[0], self.bounds(i)[1] + 1)
        if below is None:
            return ADD * r
        best = np.minimum(self.drop[i] + self.at(below, i + 1, r), self.change(i, r) + self.at(below, i + 1, r - 1))
        return np.minimum.accumulate(best - ADD * r) + ADD * r  # inserts

    def whole_pairs(self, row: np.ndarray, i: int, least: int) -> tuple[int, np.ndarray]:
        """Least cost over the even lengths of a row, and the lengths that reach it."""
        r = np.arange(self.bounds(i)[0], self.bounds(i)[1] + 1)
        r, cost = (x[(r % 2 == 0) & (r >= least)] for x in (r, row))
        return (int(cost.min()), r[cost == cost.min()]) if len(cost) else (FAR, r)

    def fill(self, limit: int) -> int:
        """Least cost within the band of ``limit``; right if it is no more than that."""
        self.limit, self.kept = limit, {}
        self.opening = [FAR] * (self.m + 1)  # cost from turn i on if a system turn is still to be kept
        row = None
        for i in range(self.m, -1, -1):
            below, row = row, self.row(i, row)
            if i % self.every == 0 or i == self.m:
                self.kept[i] = row
            if i < self.m:
                self.opening[i] = min(self.drop[i] + self.opening[i + 1], self.system(i, below)[0])
        return min(self.whole_pairs(row, 0, 0)[0], self.opening[0])

    def system(self, i: int, below: np.ndarray) -> tuple[int, np.ndarray]:
        """Cost of keeping turn i as the system turn, and the best lengths after it."""
        if self.initials[i] != "s":
            return FAR, np.arange(0)
        cost, lengths = self.whole_pairs(below, i + 1, 2)
        return self.keep[i] + cost, lengths

    def block(self, i: int) -> dict[int, np.ndarray]:
        """The rows from i to the next one that was kept."""
        last = min(self.m, (i // self.every + 1) * self.every)
        rows = {last: self.kept[last]}
        for k in range(last - 1, i - 1, -1):
            rows[k] = self.row(k, rows[k + 1])
        return rows

    def best(self) -> str:
        """Edits of the cheapest alignment with the least audit."""
        cost = self.fill(8)
        if cost > self.limit:
            cost = self.fill(cost)
        rows = self.block(0)
        found, r = self.whole_pairs(rows[0], 0, 0)
        r, opening = (r if found == cost else r[:0]), self.opening[0] == cost  # states that share the edits so far
        audit, i = [], 0
        while i < self.m or (r > 0).all():
            if i < self.m and i + 1 not in rows:
                rows = self.block(i)
            here = self.at(rows[i], i, r)
            if i < self.m:
                dropped = here == self.drop[i] + self.at(rows[i + 1], i + 1, r)
                still = opening and self.opening[i] == self.drop[i] + self.opening[i + 1]
                if dropped.any() or still:
                    r, opening, i = r[dropped], still, i + 1
                    audit.append("D")
                    continue
            added = (r > 0) & (here == ADD + self.at(rows[i], i, r - 1))
            if added.any():
                r, opening = r[added] - 1, False
                audit.append("I")
                continue
            below = self.at(rows[i + 1], i + 1, r - 1)
            stays = (r > 0) & (here == self.change(i, r) + below)
            same = stays & (self.change(i, r) == self.keep[i])
            after = self.system(i, rows[i + 1]) if opening else (FAR, r[:0])
            starts = opening and after[0] == self.opening[i]
            if same.any() or starts:
                r = np.concatenate([r[same] - 1, after[1] if starts else r[:0]])
                audit.append("K")
            else:
                r = r[stays] - 1
                audit.append("R")
            opening, i = False, i + 1
        return "".join(audit)


@functools.lru_cache(maxsize=1 << 14)
def short_audit(initials: tuple[str, ...], late: tuple[bool, ...]) -> str:
    """Short conversations are often damaged alike; their audits are remembered."""
    return Alignment(initials, late).best()


def audit_of(roles: list[str], kinds: list[str]) -> str:
    """Edits of all turns. Those that must go are deleted where they stand, as D comes before every other edit."""
    stay = [k for k, kind in enumerate(kinds) if kind in ("", "truncated")]
    initials, late = tuple(roles[k][:1] for k in stay), tuple(kinds[k] == "truncated" for k in stay)
    edits = iter(short_audit(initials, late) if len(stay) < 64 else Alignment(initials, late).best())
    out = []
    for kind in kinds:
        edit = "D" if kind in ("blank", "duplicate") else next(edits)
        while edit == "I":
            out.append(edit)
            edit = next(edits)
        out.append(edit)
    return "".join(out) + "".join(edits)


def apply(audit: str, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """The repaired turns."""
    places = len(re.sub("D", "", audit))
    turns, out = iter(zip(roles, texts)), []
    for edit in audit:
        role, text = next(turns) if edit != "I" else ("", "")
        if edit == "D":
            continue
        wanted = ROLES["u" if places % 2 == 0 else "a"]
        out.append((role if edit == "K" else wanted, text))
        places -= 1
    return out


def cost_of(audit: str, kinds: list[str]) -> int:
    turns = iter(kinds)
    prices = {"K": 0, "R": RETYPE, "D": DROP, "I": ADD}
    return sum(prices[e] + (UNFINISHED if e != "I" and next(turns) == "truncated" and e != "D" else 0) for e in audit)


RESULT = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in (
    "gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()),
    ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])
RESULT_TYPE = schema(conv_id=T.LongType(), **{c: T.LongType() for c in (
    "gaps", "blank", "duplicate", "truncated", "illegal", "cost")}, audit=T.StringType(),
    repaired=T.ArrayType(schema(role=T.StringType(), text=T.StringType())))


def _repaired(conv_id: int | None, numbers: list, roles: list[str], texts: list[str]) -> dict:
    found = faults(numbers, roles, texts)
    audit = audit_of(roles, found.kinds)
    return dict(
        conv_id=conv_id, gaps=found.gaps, illegal=found.illegal, audit=audit, cost=cost_of(audit, found.kinds),
        repaired=[dict(role=r, text=t) for r, t in apply(audit, roles, texts)],
        **{kind: found.count(kind) for kind in ("blank", "duplicate", "truncated")})


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of a sorted partition, one after another, over batch borders."""
    out, held, size = [], ([], [], []), 0
    current: tuple | None = None

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(out, RESULT)

    for batch in batches:
        ids, *columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text"))
        for conv_id, *turn in zip(ids, *columns):
            if current is not None and current[0] != conv_id:
                out.append(_repaired(current[0], *held))
                held = ([], [], [])
                if len(out) >= ROWS_OUT or size > 1 << 24:
                    yield packed()
                    out, size = [], 0
            current = (conv_id,)
            for column, value in zip(held, turn):
                column.append(value)
            size += len(turn[2])
    if current is not None:
        out.append(_repaired(current[0], *held))
    if out:
        yield packed()


def repair(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns(conv_id, turn, role, text)``: its faults (gaps, blank, duplicate, truncated,
    illegal), the cost and audit of the cheapest repair, and the repaired turns, array<struct<role, text>>."""
    space = F.lit(" ")
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_stream, RESULT_TYPE)
