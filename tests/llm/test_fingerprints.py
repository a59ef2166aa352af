"""Fingerprints against the samples worked out one by one, exact similarities, and edge rows."""
import hashlib
import math
import re
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash

from reviewsieve.llm import fingerprints as fp
from reviewsieve.llm.queries import op13_fingerprints


def bag(text):
    words = [w for w in re.split(r"[\x00-/:-@\[-`{-\x7f]+", text.lower()) if w]
    return Counter(words)


def number_hash(value, part):
    """Spark's hash of a long and an int."""
    return xxhash.xxh64_intdigest(struct.pack("<i", part), xxhash.xxh64_intdigest(struct.pack("<Q", value), 42))


def one_sample(words, k):
    """Least ln a over the words, from its definition."""
    least = math.inf
    for word, n in words.items():
        base = number_hash(xxhash.xxh64_intdigest(word.encode(), 42), k // fp.BLOCK)
        h, g = (number_hash(base, 2 * (k % fp.BLOCK) + j) for j in range(2))
        r = -math.log(((h & 0x1FFFFF) + 0.5) / 2 ** 21) - math.log(((h >> 43) + 0.5) / 2 ** 21)
        b = ((h >> 21) & 0x3FFFFF) / 2 ** 22
        c = -math.log(((g & 0xFFFFFFFF) + 0.5) / 2 ** 32) - math.log(((g >> 32) + 0.5) / 2 ** 32)
        y = math.exp(r * (math.floor(math.log(n) / r + b) - b))
        least = min(least, math.log(c / (y * math.exp(r))))
    return least


def test_samples_one_by_one(spark):
    texts = ["the cat sat on the mat, the end", "one", "Éa éa ÉB " * 40 + "once", "x " * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {r.k: r.samples for r in fp.sampled(rows, ["k"], samples=20).collect()}
    for k, text in enumerate(texts):
        assert np.allclose(got[k], [one_sample(bag(text), s) for s in range(20)], rtol=1e-9, atol=1e-9)


def jaccard(a, b):
    a, b = bag(a), bag(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_table(spark, sf):
    sf = sf.replace("0.001", "0.01")
    got = {r.doc_id: r for r in op13_fingerprints(spark, sf).collect()}
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    assert len(got) == len(docs)
    errors, first = [], {}
    for k, (doc_id, text) in enumerate(docs):
        following, half, r = docs[(k + 1) % len(docs)][1], len(text) // 2, got[doc_id]
        edited = text[:len(text) - half] + following[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        errors += [r.near_edited - jaccard(text, edited), r.near_next - jaccard(text, following)]
        assert first.setdefault(text, r.fingerprint) == r.fingerprint
        assert (r.near_next == 1) == (r.fingerprint == got[docs[(k + 1) % len(docs)][0]].fingerprint)
    assert abs(np.mean(errors)) < 0.005 and np.std(errors) < 0.06  # 48 samples: 0.07 at most


def test_edge_rows(spark):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (7, "A b"), (5, None), (4, ""), (3, "!!!"), (2, "???"), (1, "é漢🙂 x " * 30_000),
            (None, "last one"), (None, None), (-(1 << 63), "first id"), ((1 << 63) - 1, "!!!")]
    frame = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, range string, guard int")
    got = fp.compare_with_next(frame).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or ""))
    expected = Counter()
    for k, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        edited = text[:len(text) - len(text) // 2] + following[:len(text) // 2]
        expected[doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == expected
    prints = {}
    for r in got:
        prints.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) == 8 * fp.SAMPLES
    assert prints[5, 0] == prints[4, 0] == prints[None, 0] and prints[3, 3] == prints[(1 << 63) - 1, 3] != prints[2, 3]
    assert len(prints[7, 11]) == 1 and prints[7, 11] != prints[7, 3]
    assert fp.compare_with_next(frame.limit(0)).count() == 0
    alone = fp.compare_with_next(frame.filter("doc_id = 1")).collect()
    assert [r.near_next for r in alone] == [1.0]


@pytest.mark.parametrize("n", [63, 64, 128, 1000])
def test_ranges(spark, n):
    """Uneven ids over several ranges: everyone is followed by the next smaller id, the last by the first."""
    ids = sorted({int(x) for x in np.random.default_rng(n).pareto(0.3, n) * 10} | {10 ** 18 + k for k in range(n // 3)})
    frame = spark.createDataFrame([(i, f"w{i}") for i in ids], "doc_id long, text string")
    rows = fp.with_next(frame).filter("not guard").collect()
    follows = {i: ids[k - 1] for k, i in enumerate(ids)}
    assert {r.doc_id: r.next_text for r in rows} == {i: f"w{f}" for i, f in follows.items()}
