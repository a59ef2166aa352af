"""Ranks of many products side by side against those by blocks."""
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from reviewsieve import session
from reviewsieve.operators import centrality

WORDS = "sound screen hinge price lid strap bass volume charger size".split()


def _nodes(spark):
    rows = []
    for p in range(40):
        for k in range(p % 9):
            words = [WORDS[(p * 7 + k * j * 3 + j) % 10] for j in range(1 + (k * p) % 6)]
            rows.append((p, k // 2, k % 2, " ".join(words)))
    rows += [(50, 1, 0, "the of"), (50, 1, 1, "is"), (51, 1, 0, "unheard zebra"), (51, 1, 1, "quartz vivid"), (52, 1, 0, ""),
             (None, 1, 0, "sound lid"), (53, None, 0, "sound lid"), (53, 2, 0, "sound lid"), (53, 3, 0, "sound price"),
             (54, 1, 0, "sound lid lid"), (54, 1, 0, "sound lid lid"), (54, 2, 0, "lid price"), (54, 2, 1, "price sound")]
    return spark.createDataFrame(rows, "product_id long, review_id long, sent_no int, body string")


@pytest.mark.parametrize("room, batch", [(20_000, 10_000), (5, 3), (1, 1)])
def test_products_side_by_side_rank_as_alone(spark, monkeypatch, room, batch):
    nodes = _nodes(spark)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    monkeypatch.setattr(centrality, "ROOM", room)
    try:
        rows = lambda df: sorted((str(r[:3]), r[4], r[3]) for r in df.collect())
        found = rows(centrality.rank_texts(nodes, 4))
        alone = rows(centrality.rank_texts(nodes, 4, block_tokens=1_000_000))
        assert [f[:2] for f in found] == [a[:2] for a in alone] and len(found) > 150
        assert [f[2] for f in found] == pytest.approx([a[2] for a in alone], abs=1e-9)
        monkeypatch.setattr(centrality, "WHOLE_TOKENS", 20)
        mixed = rows(centrality.rank_texts(nodes, 4))
        assert [m[:2] for m in mixed] == [a[:2] for a in alone]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_ranking_shuffles_texts_once(spark):
    """Terms of small products do not leave their text."""
    plan = centrality.rank_texts(_nodes(spark), 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_empty_table(spark):
    assert centrality.rank_texts(_nodes(spark).filter(F.lit(False)), 4).count() == 0


def test_many_blocks_exchange_numbers_alone(spark, monkeypatch):
    """A step of the walk writes no text ids and no terms; blocks send a row for each bin of terms, and rank as one block."""
    rows = [(1, k, 0, " ".join(WORDS[(k * j + j * j + k // 7) % 10] for j in range(1 + k % 5))) for k in range(60)] + [
        (1, 60, 0, "unheard zebra"), (1, 61, 0, "the of")]
    nodes = spark.createDataFrame(rows, "product_id long, review_id long, sent_no int, body string")
    written = []
    write = centrality.materialize
    monkeypatch.setattr(centrality, "materialize", lambda df, name, *a: written.append((name, df.columns)) or write(df, name, *a))
    key = lambda r: r["review_id"]
    dealt = sorted(centrality.rank_texts(nodes, 3, block_tokens=20).collect(), key=key)
    steps = [columns for name, columns in written if name == "rank-step"]
    assert steps and not any({"ids", "terms"} & set(columns) for columns in steps)
    alone = sorted(centrality.rank_texts(nodes, 3).collect(), key=key)
    assert [r["pick"] for r in dealt] == [r["pick"] for r in alone] and len(dealt) == 62
    assert [r["centrality"] for r in dealt] == pytest.approx([r["centrality"] for r in alone], abs=1e-12)


def test_a_walk_leaves_neither_tables_nor_shuffle_files(spark, monkeypatch, tmp_path):
    """A step writes ranks and sums, no vectors; the table before it goes, and so do the shuffle files of a job."""
    nodes = _nodes(spark).filter("product_id is null or product_id in (8, 17, 50, 53, 54)")
    rows = lambda df: sorted((str(r[:3]), r[4], r[3]) for r in df.collect())
    alone = rows(centrality.rank_texts(nodes, 3))
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {f for d in local for f in Path(d.toString()).glob("*/shuffle_*.data")}
    before = files()
    found = centrality.rank_texts(nodes, 3, block_tokens=4)
    left = [p.name for p in (tmp_path / "reviewsieve").iterdir()]
    assert not [name for name in left if name.startswith(("rank-", "picks-"))] and any(name.startswith("ranks-") for name in left)
    assert len(files() - before) < 10  # of looks at sizes and whether all have settled, which write no table
    found = rows(found)
    assert [f[:2] for f in found] == [a[:2] for a in alone] and any(f[1] for f in found)
    assert [f[2] for f in found] == pytest.approx([a[2] for a in alone], abs=1e-9)
