import math

import pytest
from pyspark.sql import functions as F

from reviewsieve.functions import sentiment as sent
from reviewsieve.functions import style as sty
from reviewsieve.functions import text as txt
from reviewsieve.operators import explain
from reviewsieve.operators.aspects import verdict
from reviewsieve.operators.digest import generation_bounds
from reviewsieve.sources import readers


def values(spark, items, build, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r["v"] for r in rows.select("i", build(F.col("x")).alias("v")).orderBy("i").collect()]


def test_sentiment_by_hand(spark):
    expected = {"great sound": 0.599373, "not good": -0.356959, "very good": 0.557370, "not very good": -0.444901,
                "the volume is too low": -0.381819, "great but bad": -0.510607, "great!!": 0.668361, "": 0.0,
                "Would NOT recommend": -2.8 / math.sqrt(2.8 ** 2 + 15)}
    got = values(spark, expected, sent.sentiment)
    assert got == pytest.approx(list(expected.values()), abs=1e-5)


def test_phrases_in_order_and_own_marks(spark):
    got = values(spark, ["not worth every penny", "worth every penny", "ab fell apart"],
                 lambda t: sent.phrase_total(sent.mark_phrases(t)))
    assert got == pytest.approx([-2.4, 3.0, -2.8])


def test_splitting(spark):
    assert values(spark, ["A b. C!  d\n\n e"], txt.sentences) == [["A b.", "C!", "d", "e"]]
    assert values(spark, ["great sound but the volume is too low", "fine", " ; "], txt.clauses) == [
        ["great sound", "the volume is too low"], ["fine"], []]
    assert values(spark, ["nice, ok - bad , x-y"], txt.segments) == [["nice", "ok", "bad", "x-y"]]
    assert values(spark, ["don't naïve 3.5 x2"], txt.words) == [["don't", "na", "ve", "3.5", "x", "2"]]
    assert values(spark, ["Naïve café's a_b"], txt.term_tokens) == [["naïve", "café's", "a_b"]]
    assert values(spark, ["a"], lambda t: txt.ngrams(txt.words(t))) == [["a"]]
    assert values(spark, [""], lambda t: txt.ngrams(txt.words(t))) == [[]]


def test_counted(spark):
    got = values(spark, ["b a b c b"], lambda t: txt.counted(F.split(t, " ")))
    assert [(e["item"], e["n"]) for e in got[0]] == [("a", 1), ("b", 3), ("c", 1)]


def test_highlight(spark):
    build = lambda t: txt.highlight(t, F.array(F.lit("highly recommend"), F.lit("recommend it"), F.lit(" ")))
    got = values(spark, ["I Highly, recommend it <now>", "nothing & more", ""], build)
    assert got == ["I <mark>Highly, recommend it</mark> &lt;now&gt;", "nothing &amp; more", ""]


def test_style_edges(spark):
    empty, mixed = values(spark, ["", "Sooo GOOD!! is it? yes.\nok 12"], sty.style)
    assert (empty["n_words"], empty["n_sentences"], empty["avg_word_len"]) == (0, 1, 0)
    assert mixed["repeated_chars"] == 1 and mixed["exclamations"] == 2 and mixed["n_sentences"] == 4
    assert mixed["lowercase_sentence_starts"] == pytest.approx(3 / 4)
    assert mixed["upper_ratio"] == pytest.approx(5 / 17)


def test_rating_features(spark):
    assert values(spark, [5.0, 3.0, None, float("nan")], sty.rating_extremity, "double") == [1, 0, 0, 0]
    assert values(spark, [5.0, 3.0, None], lambda r: sty.rating_mismatch(r, F.lit(-1.0)), "double") == [1, 0.5, 0]


def test_ingest_values(spark):
    assert values(spark, ["5", " 4.5 ", "4f", "NaN", "inf", "x", "", None, "1e0"], readers.to_rating) == [
        5, 4.5, None, None, None, None, None, None, 1]
    assert values(spark, [" CG ", "OR", "True", None, "1"], readers.to_label) == [1, 0, 1, 0, 1]


def test_verdicts_and_bounds(spark):
    assert values(spark, [0.5, 0.25, -0.1, -0.4, -0.41], verdict, "double") == ["Great", "Good", "OK", "Poor", "Bad"]
    assert values(spark, [100, 500], lambda n: generation_bounds(n)[0], "int") == [60, 160]
    assert values(spark, [100, 500], lambda n: generation_bounds(n)[1], "int") == [15, 75]


def test_overlap_removal(spark):
    rows = spark.range(1).select(explain.pick_phrases(F.array(*[
        F.struct(F.lit(p).alias("phrase"), F.lit(w).alias("weight"))
        for p, w in [("highly", 1.0), ("highly recommend", 2.0), ("recommend it", 0.5), ("it", 0.4)]])).alias("p"))
    assert [(e["phrase"], e["weight"]) for e in rows.first()["p"]] == [("highly recommend", 2.0), ("recommend it", 0.5)]
