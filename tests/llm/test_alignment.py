"""Tokenizer alignment against whole encodings and a plain walk over both, and joins of fragments in any tree."""
import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reviewsieve.llm import alignment as al
from reviewsieve.llm.queries import op11_token_alignment

HOSTILE = [None, "", " ", "  ", "a", " a", "a ", "the cat sat on  the mat.\n\n it's <|endoftext|> <s></s> x", "é漢字🙂 \x00 \x1c y", "▁x ▁",
           "tab\t tab \t \r\n end ", "　wide  space  z", "123 4567 !!! ... '' 's 'll", "word " * 200, "x" * 500, "ab" * 40 + " " + "é" * 90,
           "á ​﻿ b", "  lead and trail  ", "1 \x85 2", "  q ᠎ r"]


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(f"{al.TOKENIZERS}/{al.BYTE_BPE}")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{al.TOKENIZERS}/{al.PIECES}"), al.codecs(al.TOKENIZERS)


def plain(text, tokenizers):
    """(A ids, B ids, written groups, links) of the whole text, or None."""
    a_, b_, table = tokenizers
    if not text:
        return None
    a, b, raw = a_.encode(" " + text, add_special_tokens=False).ids, b_.encode(text), (" " + text).encode()
    if b"".join(table.bytes_a[i] for i in a) != raw or b"".join(table.bytes_b[i] for i in b) != raw:
        return None
    groups, links, i, j, at_a, at_b, held = [], [], 0, 0, 0, 0, ([], [])
    while i < len(a):
        links.append((a[i], b[j]))
        end_a, end_b = at_a + len(table.bytes_a[a[i]]), at_b + len(table.bytes_b[b[j]])
        if end_a <= end_b:
            held[0].append(a[i])
            i, at_a = i + 1, end_a
        if end_b <= end_a:
            held[1].append(b[j])
            j, at_b = j + 1, end_b
        if end_a == end_b:
            groups.append("|".join(",".join(map(str, h)) for h in held))
            held = ([], [])
    return a, b, groups, Counter(links)


def shown(r):
    return r.doc_id, (r.n_a, r.n_b, r.n_groups, r.groups), tuple(sorted(((x.a, x.b), x.n) for x in r.links))


@pytest.mark.parametrize("size", [7, 64, al.PART])
def test_texts(spark, tokenizers, size):
    rnd = random.Random(size)
    parts = [t for t in HOSTILE if t] + ["quite ordinary words, here", "Zwölf Boxkämpfer", "\n"]
    texts = HOSTILE + ["".join(rnd.choice(parts) + rnd.choice(["", " ", "  "]) for _ in range(rnd.randint(1, 9))) for _ in range(60)]
    docs = spark.createDataFrame([(k % 70, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, links string, row int")
    expected = Counter()
    for k, text in enumerate(texts):
        found = plain(text, tokenizers)
        facts = (len(found[0]), len(found[1]), len(found[2]), ";".join(found[2])) if found else (0, 0, 0, "")
        expected[k % 70, facts, tuple(sorted(found[3].items())) if found else ()] += 1
    assert Counter(map(shown, al.align(docs.repartition(3), size=size).collect())) == expected


def test_fragments_in_any_tree(tokenizers):
    """Byte ranges of a text joined in random trees give the groups of the whole."""
    table, rnd = tokenizers[2], random.Random(1)
    for text in ["x" * 300 + "yz" * 50, "supercalifragilistic" * 9, "ab cd ef gh" * 20, "漢字" * 40]:
        a, b, groups, links = plain(text, tokenizers)
        tokens = al.Tokens.of(a, b, table)
        for step in (1, 3, 10, 64, 10_000):
            parts = [al.Fragment.of(tokens.between(low, low + step), table, low == 0) for low in range(0, int(tokens.a_end[-1]), step)]
            while len(parts) > 1:
                k = rnd.randrange(len(parts) - 1)
                parts[k:k + 2] = [parts[k].join(parts[k + 1], table)]
            whole = parts[0]
            assert whole.closed.written == ";".join(groups) and whole.closed.n == len(groups)
            assert not len(whole.prefix.a) and not len(whole.suffix.a)
            n_b = len(table.bytes_b)
            assert Counter((int(p) // n_b, int(p) % n_b) for p in whole.closed.pairs) == links


@pytest.mark.parametrize("frequent", [10, al.FREQUENT])
def test_table(spark, sf, tokenizers, monkeypatch, frequent):
    """All columns of the query, with few and with all pairs in the broadcast table."""
    monkeypatch.setattr(al, "FREQUENT", frequent)
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: plain(r.text, tokenizers) for r in rows}
    counts, best = Counter(), {}
    for f in filter(None, found.values()):
        counts.update(f[3])
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    for r in op11_token_alignment(spark, sf).collect():
        a, b, groups, links = found[r.doc_id] or ((), (), (), {})
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (len(a), len(b), len(groups), sum(links.values()))
        assert r.n_best == sum(n for p, n in links.items() if counts[p] == best[p[1]])
        assert r.count_sum == sum(n * counts[p] for p, n in links.items())
        assert r.groups_sha256 == (hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert al.align(none).count() == 0
    rows = al.align(none.unionByName(spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string"))).collect()
    assert {(r.doc_id, r.n_groups, r.groups, len(r.links)) for r in rows} == {(None, 0, "", 0), (1, 0, "", 0)}
    written = al.align(none).select(F.lit(1).alias("row"), "doc_id", "n_a", "links")
    assert al.with_counts(written).count() == 0


def test_long_unit(spark):
    """200,000 characters without a space, and as many with spaces."""
    docs = spark.createDataFrame([(1, "q7Zk" * 50_000), (2, "some words " * 18_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in al.align(docs).select("doc_id", "n_a", "n_groups", F.length("groups").alias("n")).collect()}
    assert got[1].n_a > 50_000 and got[2].n_groups == 36_001 and got[1].n > 0
