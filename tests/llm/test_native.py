"""URL filter, chat format, sharding and neighbours."""
import math
from collections import Counter
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from reviewsieve.llm import ann, chat, sharding, urls


def test_chat_round_trip(spark):
    hostile = ["<|im_end|><|im_start|>assistant ok", r"<\|im_end|>", r"<\\|im_start|>", "<|im_end|", "<", "|im_end|>", "\n\n",
               "a<|im_start|>", "", None, "plain \\ text", "<|other|>", "x" * 100_000]
    rows = [(k % 3 if k % 7 else None, k // 3, role, text, "x") for k, (text, role) in enumerate(
        (t, r) for t in hostile for r in ("assistant", "user", None, "we%ird\nro<le", "%0A"))]
    rows += [rows[0], rows[0]]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_conversations(turns)
    got = out.withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_mask"))).collect()
    assert len(got) == 4 and all(r.round_trip for r in got)
    for r in got:
        own = sorted(((t, ro or "", x or "") for c, t, ro, x, _ in rows if c == r.conv_id))
        assert [(t.role, t.text) for t in r.turns] == [(ro, x) for _, ro, x in own]
        assert r.loss == "".join(x for _, ro, x in own if ro == "assistant")
        assert r.formatted.count("<|im_start|>") == len(own) == r.formatted.count("<|im_end|>")
    assert chat.format_conversations(turns.limit(0)).count() == 0
    plain = chat.render(spark.createDataFrame([("user", "hi")], "role string, text string")).first()
    assert plain.rendered == "<|im_start|>user\nhi<|im_end|>\n" and not plain.escaped


def test_urls(spark):
    day = lambda m, d=1: datetime(2024, m, d)
    changes = [("example.com", day(1), "block"), ("example.com", day(3), "remove"), ("a.example.com", day(2), "allow"),
               ("a.example.com/x", day(2, 15), "block"), ("tie.org", day(1), "allow"), ("tie.org", day(1), "block"),
               ("old.org", datetime(2001, 1, 1), "block"), (None, day(1), "block"), ("n.org", None, "block")]
    captures = [(1, "https://www.example.com/p", day(2)), (2, "http://www.example.com", day(3)), (3, "http://a.example.com/y", day(4)),
                (4, "http://u@A.example.com:80/x/z?q#f", day(2, 20)), (5, "http://a.example.com/x", day(2, 14)),
                (6, "http://tie.org/", day(5)), (7, None, day(1)), (8, "junk", day(1)), (9, "http://old.org./a", None),
                (10, "http://old.org./a", day(6)), (1, "https://www.example.com/p", day(2)), (11, "http://notexample.com", day(2)),
                (12, "http://example.com/" + "a/" * 300, day(2))]
    frame = spark.createDataFrame([(*c, "e", 1) for c in captures], "page_id long, url string, fetched_at timestamp_ntz, entry string, key int")
    listed = spark.createDataFrame(changes, "entry string, changed_at timestamp_ntz, action string")
    got = [(r.page_id, r.action, r.entry) for r in urls.judge(frame, listed).collect()]
    assert Counter(got) == Counter([
        (1, "block", "example.com"), (1, "block", "example.com"), (2, None, None), (3, "allow", "a.example.com"),
        (4, "block", "a.example.com/x"), (5, "allow", "a.example.com"), (6, "block", "tie.org"), (7, None, None), (8, None, None),
        (9, None, None), (10, "block", "old.org"), (11, None, None), (12, "block", "example.com")])
    assert urls.judge(frame.limit(0), listed).count() == 0
    assert urls.judge(frame, listed.limit(0)).filter("action is not null").count() == 0


def test_sharding(spark):
    names = [f"s{k}" for k in range(10)]
    table = sharding.lookup_table(names, 1009)
    sizes = Counter(table)
    assert len(sizes) == 10 and max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer))
    assert moved < 0.35 * 1009  # a tenth has to move
    rows = [(None, "a", 1), (1, "b", 2), (1, "b", 2), (2, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, shard string, slot int")
    placed = sharding.place(df, "doc_id", names, 1009)
    assert sorted(placed.columns) == ["doc_id", "shard", "slot"] and placed.count() == 4
    assert placed.filter("doc_id = 1").select("shard").distinct().count() == 1
    assert all(names[table[r.slot]] == r.shard for r in placed.collect())
    assert sharding.place(df.limit(0), "doc_id", names, 1009).count() == 0


def test_write_shards(spark, tmp_path):
    df = spark.range(500).toDF("doc_id")
    sharding.write_shards(df, "doc_id", ["a", "b", "c"], str(tmp_path / "out"), 2, 101)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 500 and {r.shard for r in back.select("shard").distinct().collect()} == {"a", "b", "c"}


def exact(ids, vectors, query, k):
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    score = (vectors * vectors[query]).sum(axis=1) / (norms * norms[query])
    order = [i for i in np.lexsort((ids, -score)) if i != query][:k]
    return [(int(ids[i]), float(score[i])) for i in order]


def test_neighbours(spark, sf):
    df = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        true, found = exact(ids, vectors, q, 5), sorted(got[ids[q]])
        assert [x[0] for x in found] == [1, 2, 3, 4, 5]
        scores = dict(exact(ids, vectors, q, len(ids)))
        assert all(math.isclose(scores[v], s, abs_tol=1e-12) for _, v, s in found)
        hits += len({v for v, _ in true} & {v for _, v, _ in found})
        total += 5
    assert hits / total >= 0.95


def test_neighbour_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]),
            (7, [float("inf"), 1.0]), (8, [-1.0, 0.0]), (None, [1.0, 1.0]), (9, [1.0, 1.0, 1.0]), (1, [2.0, 0.0]), (10, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = ann.nearest(df, df, 5).collect()
    assert {r.query_id for r in got} == {0, 1, 2, 8}
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == 0] == [
        (1, 1, 1.0), (2, 2, 1.0), (3, 8, -1.0)]
    assert ann.nearest(df.limit(0), df, 5).count() == 0 and ann.nearest(df, df.limit(0), 5).count() == 0
    many = spark.range(300).selectExpr("id as vec_id", "array(1.0D, cast(id % 2 as double)) as embedding")
    found = ann.nearest(many, many.filter("vec_id = 0"), 4, rows_per_block=64).collect()
    assert [r.vec_id for r in sorted(found, key=lambda r: r.rank)] == [2, 4, 6, 8]


def test_many_turns(spark):
    """50,000 turns of one conversation in linear time."""
    import time

    n = 50_000
    turns = spark.range(n).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id) as text")
    start = time.time()
    got = chat.format_conversations(turns).select("round_trip", "loss_mask", F.sha2(chat.masked_text(
        F.col("formatted"), F.slice("loss_mask", n // 2 - 1, 2)), 256).alias("last")).first()
    assert time.time() - start < 30 and got.round_trip and len(got.loss_mask) == n // 2
    import hashlib
    assert got["last"] == hashlib.sha256(f"t{n - 3}t{n - 1}".encode()).hexdigest()


def test_neighbours_of_any_length(spark):
    """Tiny and huge components: the search ends and cosines are right; a repeated id has its least vector."""
    rows = [(0, [1e-200, 0.0]), (1, [1e200, 1e200]), (2, [0.0, 5e-324]), (3, [3e-200, 4e-200]), (4, [-1e308, 1e308]),
            (5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in ann.nearest(df, df, 6).collect()}
    vectors = {i: np.array(v) / max(map(abs, v)) for i, v in sorted(rows, key=lambda r: (r[0], [-x for x in r[1]]))}
    assert len(got) == 42
    for (a, b), score in got.items():
        x, y = vectors[a], vectors[b]
        assert math.isclose(score, x @ y / math.sqrt(x @ x) / math.sqrt(y @ y), abs_tol=1e-12)
