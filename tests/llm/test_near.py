"""Near-duplicates against brute force over all pairs."""
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewsieve.llm import bagminhash as bag
from reviewsieve.llm.common import words


def shingles(text):
    w = words(text)
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(rows):
    """Smallest id of each row's class, by comparing all pairs that share a shingle."""
    bags = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for k, b in enumerate(bags):
        for s in b:
            holders.setdefault(s, set()).add(k)
    for k, b in enumerate(bags):
        for j in set().union(*(holders[s] for s in b)) if b else ():
            if j < k:
                shared = sum((b & bags[j]).values())
                if 5 * shared >= 4 * (sum(b.values()) + sum(bags[j].values()) - shared):
                    x, y = root(k), root(j)
                    parent[max(x, y)] = min(x, y)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        smallest[root(k)] = min(smallest.get(root(k), i), i)
    return {i: smallest[root(k)] for k, (i, _) in enumerate(rows)}


def test_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.class_id for r in bag.near_duplicates(docs).collect()}
    assert got == brute_classes([(r.doc_id, r.text) for r in docs.collect()])


def test_chains_of_edits(spark):
    """Families in which most links do not touch the smallest member, and groups with several components."""
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(4):
        base = [f"w{x}" for x in rng.integers(0, 4000, 90)]
        family = [base]
        for _ in range(60):
            copy = list(family[rng.integers(0, len(family))])
            for at in rng.integers(0, len(copy), rng.integers(1, 4)):
                copy[at] = f"e{rng.integers(0, 300)}"
            if rng.random() < 0.3:
                copy = copy[:len(copy) - int(rng.integers(1, 12))]
            family.append(copy)
        rows += [" ".join(t) for t in family]
    rows = [(k, t) for k, t in enumerate(rows)]
    got = bag.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    expected = brute_classes(rows)
    assert len(set(expected.values())) > 4
    assert {r.doc_id: r.class_id for r in got.collect()} == expected


@pytest.mark.parametrize("outside", [1, 30, 300])
def test_tasks_of_the_last_comparison(spark, outside):
    """Every pair of an outside member and a member meets once; tasks are bounded, and copies follow both numbers."""
    n, size = 400, 20
    rows = [(b"f", b"%d" % k, b"o%d" % k if k < outside else b"l", b"l", n, outside) for k in range(n)]
    rows += [(b"g%d" % k, b"%d" % j, b"%d" % j, b"0", 2, 1) for k in range(40) for j in range(2)]
    rows += [(b"h", b"%d" % k, b"l", b"l", 50, 0) for k in range(50)]  # one component: nothing to compare
    family = spark.createDataFrame(rows, "family binary, node binary, label binary, largest binary, m long, outside long")
    asked, others = (d.toPandas() for d in bag.dealt_to_tasks(family, len(rows), size))
    assert len(others) <= n * -(-outside // size) + 80 and len(asked) == outside * (n // size) + 40
    large = asked[asked["unit"] == asked["task"]].merge(others, on=["task", "unit"])
    assert len(large) == len(set(zip(large["node_x"], large["node_y"]))) == outside * n
    assert others[others["unit"] == others["task"]].groupby("task").size().max() <= 2 * size + 10
    assert asked[asked["unit"] == asked["task"]].groupby("task").size().max() <= 2 * size + 10


def test_signatures_estimate_weighted_jaccard():
    a = "a b c d e f g h i j " * 3 + "k l m n o p q r s t"
    b = "a b c d e f g h i j " * 2 + "k l m n o p q r s t u v w"
    owner, sh, weight = bag.bags([bag.normalised(a), bag.normalised(b)])
    sig = bag.signatures(owner, sh, weight, 2, registers=2000)
    x, y = shingles(a), shingles(b)
    true = sum((x & y).values()) / sum((x | y).values())
    assert max(x.values()) > 1 and abs((sig[0] == sig[1]).mean() - true) < 0.05


def test_edges(spark):
    schema = "doc_id long, text string, node string, class_id int, label string"
    rows = [(1, None), (2, ""), (3, "one two"), (4, "One, two!"), (5, "one two three"), (None, "x y z q r s"),
            (7, "x y z q r s"), (7, "x y z q r s"), (8, "…"), (9, "w " * 50_000), (10, "w " * 50_000 + "end"), (11, "  ")]
    docs = spark.createDataFrame([(*r, "n", 1, "l") for r in rows], schema)
    got = sorted((r.doc_id or 0, r.class_id, r.class_size) for r in bag.near_duplicates(docs).collect())
    assert got == [(0, 7, 3), (1, 1, 1), (2, 2, 1), (3, 3, 2), (4, 3, 2), (5, 5, 1), (7, 7, 3), (7, 7, 3), (8, 8, 1),
                   (9, 9, 2), (10, 9, 2), (11, 11, 1)]
    kept = bag.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [1, 2, 3, 5, 7, 8, 9, 11]
    doubled = docs.filter("doc_id = 7")
    assert bag.deduplicate(doubled).count() == 1
    assert bag.near_duplicates(docs.limit(0)).count() == 0
    assert bag.deduplicate(docs.filter(F.lit(False))).count() == 0


@pytest.mark.parametrize("text,weight", [("a a a a a a a", 3), ("a b c d e f", 1)])
def test_weights(text, weight):
    assert bag.bags([bag.normalised(text)])[2].max() == weight
