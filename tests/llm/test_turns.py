"""Conversation repair against a walk over the states of the grammar, and edge rows."""
import random
import re
import time

import duckdb
from pyspark.sql import functions as F

from reviewsieve.llm import turns
from reviewsieve.llm.queries import damaged


def by_states(roles, kinds):
    """(cost, audit) of the best repair: cheapest and least edits so far for every state of the grammar."""
    def insert(found):
        for _ in range(2):
            for start, end in (("", "u"), ("s", "u"), ("a", "u"), ("u", "a")):
                if start in found:
                    found[end] = min(found.get(end, (10 ** 9, "")), (found[start][0] + 5, found[start][1] + "I"))
        return found

    states = insert({"": (0, "")})
    for role, kind in zip(roles, kinds):
        new = {}
        late = 5 * (kind == "truncated")
        for state, (cost, audit) in states.items():
            steps = [(state, 2, "D")]
            if kind not in ("blank", "duplicate"):
                place = "a" if state == "u" else "u"
                steps.append((place, late, "K") if role[:1] == place else (place, late + 1, "R"))
                if state == "" and role[:1] == "s":
                    steps.append(("s", late, "K"))
            for end, more, edit in steps:
                new[end] = min(new.get(end, (10 ** 9, "")), (cost + more, audit + edit))
        states = insert(new)
    return min(states[s] for s in ("", "a") if s in states)


def test_audits_against_states():
    rnd = random.Random(3)
    for _ in range(6000):
        n = rnd.randint(0, 14)
        roles = [rnd.choice(["system", "user", "assistant", "tool", "", "umpire"]) if rnd.random() < 0.5
                 else ["user", "assistant"][k % 2] for k in range(n)]
        kinds = [rnd.choice(["", "", "", "", "truncated", "blank", "duplicate"]) for _ in range(n)]
        audit = turns.audit_of(roles, kinds)
        assert (turns.cost_of(audit, kinds), audit) == by_states(roles, kinds), (roles, kinds)
        fixed = turns.apply(audit, roles, ["t"] * n)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in fixed))


def test_many_turns():
    rnd = random.Random(5)
    roles = [("user", "assistant")[k % 2] if rnd.random() < 0.99 else "user" for k in range(50_000)]
    kinds = [rnd.choice([""] * 400 + ["truncated", "blank"]) for _ in roles]
    start = time.time()
    audit = turns.audit_of(roles, kinds)
    assert time.time() - start < 30
    assert (turns.cost_of(audit, kinds), audit) == by_states(roles, kinds)


def test_faults():
    found = turns.faults([None, 3, 3, 9, None], ["user", "user", "user", "assistant", "system"],
                         ["a.", "a.", "\t \x0b", "b", "c!\x0c "])
    assert found.kinds == ["", "duplicate", "blank", "truncated", ""] and found.gaps == 5 and found.illegal == 3
    assert turns.faults([None, None], ["user", "assistant"], ["\xa0", "x?"]).gaps == 0
    assert turns.faults([1], ["user"], ["\xa0"]).kinds == ["truncated"]  # other white space is text


def test_frames(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, None, None, None), (2, 1, "user", "Go on"), (None, 5, "user", "Why?"),
            (None, 5, "user", "Why?"), (None, 6, "assistant", "z" * 200_000 + "."), (3, 0, "", "x."), (3, 1, "assistant", "y."),
            (4, 2, "system", "Be kind."), (4, 1, "user", "a."), (4, None, "system", "b."), (4, 3, "assistant", "c.")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string")
    got = {r.conv_id: r for r in turns.repair(frame).collect()}
    assert {k: (r.audit, r.cost) for k, r in got.items()} == {
        1: ("KK", 0), 2: ("DD", 4), None: ("KDK", 2), 3: ("RK", 1), 4: ("KKDK", 2)}
    assert [(t.role, t.text) for t in got[3].repaired] == [("user", "x."), ("assistant", "y.")]
    assert (got[2].blank, got[2].truncated, got[None].duplicate, got[4].illegal, got[4].gaps) == (1, 1, 1, 2, 0)
    assert [t.role for t in got[4].repaired] == ["system", "user", "assistant"]
    assert turns.repair(frame.limit(0)).count() == 0
    inserted = spark.createDataFrame([(1, k, r, f"{k}.") for k, r in enumerate(["user"] + ["assistant", "user"] * 3 + ["assistant"])]
                                     + [(1, 99, "user", "last.")], "conv_id long, turn long, role string, text string")
    assert turns.repair(inserted).first().audit == "K" * 8 + "D"
    halves = frame.repartition(7)
    assert sorted(map(str, turns.repair(halves).collect())) == sorted(map(str, got.values()))


def test_damage(spark, sf):
    import binascii

    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    expected = []
    for r in rows:
        k = binascii.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", r.text) if k == 2 else r.text
        expected += [(r.conv_id, r.turn, "user" if k == 4 else r.role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    got = damaged(spark.read.parquet(f"{sf}/conversations.parquet")).collect()
    assert sorted(map(tuple, got)) == sorted(expected)
    spaces = damaged(spark.createDataFrame([(None, k, None, None) for k in range(40)], "conv_id long, turn long, role string, text string"))
    assert {(r.conv_id, r.role) for r in spaces.collect()} == {(None, " "), (None, "user")}


def test_sql(spark, sf):
    """A table with gaps in the ids, ties and nulls gives the same rows by SQL."""
    from reviewsieve.llm.oracles import ORACLES
    from reviewsieve.llm.queries import op12_turn_repair

    turns_ = spark.read.parquet(f"{sf}/conversations.parquet")
    odd = turns_.withColumn("conv_id", F.when(F.col("conv_id") > 2, F.col("conv_id"))).withColumn(
        "turn", F.when(F.col("turn") != 1, F.col("turn") * 2)).withColumn("role", F.when(F.col("turn") != 4, F.col("role")))
    odd = odd.withColumn("text", F.when(F.length("text") % 9 > 0, F.col("text")))
    folder = spark.conf.get("spark.checkpoint.dir", "/tmp") + "/turns-sql"
    odd.write.mode("overwrite").parquet(folder + "/conversations.parquet")
    got = op12_turn_repair(spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    rows = con.execute(ORACLES["op12_turn_repair"]).fetchall()
    names = [d[0] for d in con.description]
    assert sorted(map(str, rows)) == sorted(str(tuple(r[n] for n in names)) for r in got.collect())
