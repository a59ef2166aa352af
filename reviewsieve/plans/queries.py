"""The registered queries: every operator over the given tables, whole."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions import sentiment as sent
from ..functions import style as sty
from ..functions import text as txt
from ..operators import aspects as asp
from ..operators import centrality as cen
from ..operators import digest as dig
from ..operators import edges, explain, features, langmodel, metrics, model, report, scoring, vectorize
from ..operators.rethreshold import ReportStore
from ..session import materialize
from ..sources import readers
from ..sources.views import reviews_docs, reviews_orders, reviews_turns, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DIGITS = 6


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(column: str | Column, name: str | None = None) -> Column:
    out = F.round(F.col(column) if isinstance(column, str) else column, DIGITS)
    return out.alias(name or column)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


# --------------------------------------------------------------------------- ingest
@query
def s1_reviews(spark, d):
    """Text and rating columns found by name; the input uses other names and cases."""
    raw = table(spark, d, "documents").select(
        F.col("doc_id").alias("review_id"), F.col("source").alias("product_id"), F.col("text").alias("Review_Text"),
        F.concat(1 + F.col("doc_id") % 5, F.lit(" ")).alias("STARS"))
    return readers.as_reviews(raw)


@query
def s2_labelled(spark, d):
    raw = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select(
        F.col("doc_id").alias("review_id"), F.col("source").alias("product_id"), F.col("text").alias("text_"),
        F.when(F.col("toxic") == 1, " CG ").when(F.col("toxic") == 0, "OR").alias("Label"),
        F.col("lang").alias("category"))
    return readers.as_labelled(raw)


def _raw_orders(spark, d):
    """Orders with messy rating and label wordings."""
    k = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return table(spark, d, "orders").select(
        k.alias("review_id"),
        F.when(k % 9 == 0, "4f").when(k % 9 == 1, "NaN").when(k % 9 == 2, " 5 ").when(k % 9 == 3, "five")
        .when(k % 9 == 4, "").when(k % 9 == 5, "inf").when(k % 9 == 6, F.concat(F.lit("-"), price))
        .when(k % 9 == 7, "3.5e0").otherwise(price).alias("rating"),
        F.when(k % 9 == 0, " CG ").when(k % 9 == 1, "OR").when(k % 9 == 2, "True").when(k % 9 == 3, "1")
        .when(k % 9 == 4, "Computer-Generated").when(k % 9 == 5, "0").when(k % 9 == 6, "\tai\n")
        .when(k % 9 == 7, F.col("o_orderpriority")).alias("label"))


@query
def s4_rating_cast(spark, d):
    return _raw_orders(spark, d).select("review_id", readers.to_rating(F.col("rating")).alias("rating"))


@query
def s5_label_norm(spark, d):
    return _raw_orders(spark, d).select("review_id", readers.to_label(F.col("label")).alias("label"))


@query
def s7_sample(spark, d):
    return readers.sample_rows(reviews_orders(spark, d), 1000)


@query
def s8_split(spark, d):
    """Size of both parts per label; which rows go where is pseudo-random."""
    return readers.with_split(reviews_orders(spark, d)).groupBy("label", "split").agg(F.count("*").alias("n"))


@query
def s8_split_rows(spark, d):
    return readers.with_split(reviews_orders(spark, d)).select("review_id", "label", "split")


# --------------------------------------------------------------------------- text
@query
def t1_sentences(spark, d):
    return asp.sentence_table(reviews_docs(spark, d))


@query
def t2_clauses(spark, d):
    return asp.clause_table(reviews_orders(spark, d)).drop("sentence")


@query
def t3_segments(spark, d):
    return asp.segment_table(reviews_orders(spark, d))


@query
def t4_words(spark, d):
    return reviews_docs(spark, d).select("review_id", F.posexplode(txt.words(F.col("text"))).alias("pos", "word"))


@query
def t5_tokens(spark, d):
    return reviews_orders(spark, d).select(
        "review_id", F.posexplode(txt.tokens_lower(F.col("text"))).alias("pos", "token"))


EVIDENCE = ["absolutely", "highly recommend", "recommend it", "it to everyone", "the", "would you", "better sooo"]


@query
def t6_phrase_spans(spark, d):
    """Where phrases occur, overlapping occurrences merged."""
    spans = txt.phrase_spans(F.col("text"), F.array(*map(F.lit, EVIDENCE)))
    return reviews_orders(spark, d).select("review_id", F.explode(spans).alias("s")).select("review_id", "s.*")


@query
def t6_highlight(spark, d):
    return reviews_orders(spark, d).select(
        "review_id", txt.highlight(F.col("text"), F.array(*map(F.lit, EVIDENCE))).alias("html"))


@query
def t7_term_tokens(spark, d):
    return reviews_docs(spark, d).select(
        "review_id", F.posexplode(txt.term_tokens(F.col("text"))).alias("pos", "token"))


@query
def t8_ngrams(spark, d):
    return reviews_orders(spark, d).select(
        "review_id", F.explode(txt.counted(vectorize.terms(F.col("text")))).alias("g")).select(
        "review_id", F.col("g.item").alias("term"), F.col("g.n").cast("bigint").alias("n"))


# --------------------------------------------------------------------------- sentiment
@query
def n1_phrase_score(spark, d):
    marked = sent.mark_phrases(F.col("text"))
    return reviews_orders(spark, d).select("review_id", marked.alias("m")).select(
        "review_id", r6(sent.phrase_total(F.col("m")), "phrase_total"), sent.unmarked(F.col("m")).alias("rest"))


@query
def n5_token_values(spark, d):
    """Value of every scored token after booster, negation and contrast."""
    return reviews_orders(spark, d).select(
        "review_id", F.explode(sent.token_sentiment("text")).alias("t")).select(
        "review_id", "t.token", r6("t.contribution", "value"))


@query
def n7_sentiment(spark, d):
    return reviews_orders(spark, d).select("review_id", r6(sent.sentiment("text"), "sentiment"))


@query
def n7_sentiment_docs(spark, d):
    return reviews_docs(spark, d).select("review_id", r6(sent.sentiment("text"), "sentiment"))


@query
def n_product_words(spark, d):
    """Which words drive the sentiment of each product."""
    return reviews_orders(spark, d).select(
        "product_id", F.explode(sent.token_sentiment("text")).alias("t")).groupBy(
        "product_id", "t.token").agg(F.count("*").alias("n"), F.sum("t.contribution").alias("total")).select(
        "product_id", "token", "n", r6("total"))


# --------------------------------------------------------------------------- features
def _style(reviews):
    return rounded(reviews.select("review_id", sty.style("text").alias("s")).select("review_id", "s.*"),
                   *lx.STYLE_FEATURES)


@query
def f_style(spark, d):
    return _style(reviews_orders(spark, d))


@query
def f_style_docs(spark, d):
    return _style(reviews_docs(spark, d))


@query
def f21_f22_rating(spark, d):
    score = sent.sentiment("text")
    return reviews_orders(spark, d).select("review_id", "rating", score.alias("s")).select(
        "review_id", r6(sty.rating_extremity(F.col("rating")), "rating_extremity"),
        r6(sty.rating_mismatch(F.col("rating"), F.col("s")), "rating_mismatch"))


def _dense(reviews):
    language = langmodel.fit_bigrams(reviews.filter(F.col("label") == 0))
    return features.dense_features(langmodel.with_log_perplexity(reviews, language))


@query
def f23_dense(spark, d):
    return rounded(_dense(reviews_orders(spark, d)).select("review_id", *lx.DENSE_FEATURES), *lx.DENSE_FEATURES)


@query
def f24_standardise(spark, d):
    dense = materialize(_dense(reviews_orders(spark, d)).select("review_id", *lx.DENSE_FEATURES), "features")
    return rounded(features.Scaler.fit(dense).transform(dense), *lx.DENSE_FEATURES)


# --------------------------------------------------------------------------- language model
def _genuine_docs(spark, d):
    return reviews_docs(spark, d).filter(F.col("label") == 0)


@query
def l2_unigrams(spark, d):
    return langmodel.fit_bigrams(_genuine_docs(spark, d)).tokens


@query
def l3_bigrams(spark, d):
    return langmodel.fit_bigrams(_genuine_docs(spark, d)).pairs


@query
def l4_totals(spark, d):
    return langmodel.fit_bigrams(_genuine_docs(spark, d)).totals.select("total", "v")


@query
def l4_perplexity(spark, d):
    language = langmodel.fit_bigrams(_genuine_docs(spark, d))
    return rounded(langmodel.log_perplexity(reviews_docs(spark, d), language).drop("product_id"), "log_perplexity")


def _crossfit(folded, k):
    language = langmodel.fit_bigrams(folded.filter(F.col("label") == 0), k)
    return rounded(langmodel.log_perplexity(folded, language).drop("product_id"), "log_perplexity")


@query
def l5_crossfit(spark, d):
    """Folds by id, so that they can be checked."""
    folded = reviews_orders(spark, d).withColumn("fold", (F.col("review_id") % 5).cast("int"))
    return _crossfit(folded, 5)


@query
def l5_crossfit_hashed(spark, d):
    return _crossfit(langmodel.with_folds(reviews_orders(spark, d)), lx.FOLDS)


@query
def l6_merge(spark, d):
    """Counts of two training sets added up."""
    first = langmodel.fit_bigrams(_genuine_docs(spark, d))
    return first.merge(langmodel.fit_bigrams(reviews_orders(spark, d).filter(F.col("label") == 0))).pairs


def mean_rank_model():
    """Stand-in for a caller's language model: mean code point per word, a plain function of the text."""
    return lambda texts: [sum(map(ord, t)) / max(len(t.split()), 1) for t in texts]


@query
def l7_external_perplexity(spark, d):
    return rounded(scoring.external_perplexity(reviews_turns(spark, d), mean_rank_model), "log_perplexity")


# --------------------------------------------------------------------------- vectors
@query
def v1_v4_tfidf(spark, d):
    docs = reviews_docs(spark, d)
    vectorizer = vectorize.Vectorizer.fit(docs)
    vectors = vectorizer.transform(docs)
    return rounded(vectorize.long_form(vectors, vectorizer.terms), "value").select("review_id", "term", "value")


@query
def v3_vocab(spark, d):
    return rounded(vectorize.vocabulary(reviews_docs(spark, d)), "idf").withColumn("idx", F.col("idx").cast("bigint"))


@query
def v3_vocab_limited(spark, d):
    """The most frequent 500 terms only."""
    return rounded(vectorize.vocabulary(reviews_docs(spark, d), max_features=500), "idf").withColumn(
        "idx", F.col("idx").cast("bigint"))


@query
def v6_unseen_terms(spark, d):
    """Vocabulary of labelled genuine documents applied to all reviews of the orders."""
    vectorizer = vectorize.Vectorizer.fit(_genuine_docs(spark, d))
    vectors = vectorizer.transform(reviews_orders(spark, d))
    return rounded(vectorize.long_form(vectors, vectorizer.terms), "value").select("review_id", "term", "value")


# --------------------------------------------------------------------------- model with given coefficients
def text_coefficient(term: str) -> float:
    return ((len(term) * 7 + ord(term[0]) * 3) % 13 - 6) / 4.0


def dense_coefficient(position: int) -> float:
    return (position * 5 % 7 - 3) / 4.0


INTERCEPT = -0.25


def given_model(reviews: DataFrame) -> model.TrustModel:
    """Vocabulary, scaler and language model of ``reviews``, with coefficients from a formula."""
    return _given(reviews)[0]


def _given(reviews: DataFrame) -> tuple[model.TrustModel, DataFrame]:
    """That model, and the reviews with their features, which are computed and written once."""
    language = langmodel.fit_bigrams(reviews.filter(F.col("label") == 0))
    vectorizer = vectorize.Vectorizer.fit(reviews)
    dense = materialize(features.dense_features(langmodel.with_log_perplexity(reviews, language)), "features")
    scaler = features.Scaler.fit(dense)
    return model.TrustModel(vectorizer, [text_coefficient(t) for t in vectorizer.terms], scaler,
                            [dense_coefficient(i) for i in range(len(scaler.features))], INTERCEPT, language), dense


def _scored(spark, d, **options):
    fixed, dense = _given(reviews_orders(spark, d))
    return fixed.score(dense, featured=True, **options)


def _plain(spark, d):
    return _scored(spark, d, explained=False)


@query
def c1_weights(spark, d):
    return rounded(model.class_weights(reviews_orders(spark, d)), "weight")


@query
def c3_score(spark, d):
    return rounded(_plain(spark, d).select("review_id", "sentiment", "fake_prob"), "sentiment", "fake_prob")


@query
def c4_predict(spark, d):
    return report.flag(_plain(spark, d), 0.4).select("review_id", F.col("is_fake").cast("int").alias("predicted"))


@query
def c5_fusion(spark, d):
    """Every third review has no external score."""
    outside = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("review_id"),
        F.when(F.col("o_orderkey") % 3 > 0, (F.col("o_custkey") % 100) / 100.0).alias("p_ext"))
    return rounded(_scored(spark, d, external=outside, explained=False).select("review_id", "fake_prob"), "fake_prob")


@query
def c2_fit(spark, d):
    """Model trained on the training part, all its coefficients."""
    train, _ = readers.train_test(reviews_orders(spark, d))
    return rounded(model.coefficients(model.fit(train), spark), "coef")


def exclamation_model():
    return lambda texts: [min(t.count("!"), 4) / 4.0 for t in texts]


@query
def c6_batch_score(spark, d):
    return scoring.fake_scores(reviews_orders(spark, d), exclamation_model)


@query
def c7_ablation(spark, d):
    """Accuracy, F1 and AUC on the test part: both blocks, one block, an outside score, and fused with it."""
    train, test = readers.train_test(reviews_orders(spark, d))
    outside = scoring.fake_scores(test, exclamation_model)
    return rounded(model.ablation(model.prepare(train), test, outside), "accuracy", "f1", "auc")


# --------------------------------------------------------------------------- explanation
@query
def x1_contributions(spark, d):
    """Positive contributions of terms."""
    reviews = reviews_orders(spark, d)
    fixed = given_model(reviews)
    rows = fixed.text_contributions(reviews, "c").withColumn("v", F.struct(
        F.col("c.indices").alias("indices"), F.col("c.contributions").alias("values")))
    long = vectorize.long_form(rows, fixed.vectorizer.terms, name="v").filter(F.col("value") > 0)
    return long.select("review_id", "term", r6("value", "contribution"))


def _listed(spark, d, column, name):
    return _scored(spark, d).select("review_id", F.posexplode(column).alias("i", "e")).select(
        "review_id", (F.col("i") + 1).alias("rank"), f"e.{name}", r6("e.weight", "weight"))


@query
def x2_x4_phrases(spark, d):
    return _listed(spark, d, "phrases", "phrase")


@query
def x5_reasons(spark, d):
    return _listed(spark, d, "reasons", "reason")


@query
def x6_global_ngrams(spark, d):
    fixed = given_model(reviews_orders(spark, d))
    return rounded(explain.top_terms(fixed.term_table(spark), 25), "coef")


@query
def x7_dense_weights(spark, d):
    fixed = given_model(reviews_orders(spark, d))
    return rounded(explain.strongest_features(fixed.feature_table(spark)).select("feature", "coef"), "coef")


# --------------------------------------------------------------------------- metrics
def _judged(spark, d):
    return _plain(spark, d).select("label", "fake_prob")


@query
def m1_m2_accuracy_f1(spark, d):
    return rounded(metrics.accuracy_f1(_judged(spark, d)), "accuracy", "f1")


@query
def m3_auc(spark, d):
    return rounded(metrics.auc(_judged(spark, d)), "auc")


@query
def m4_class_report(spark, d):
    return rounded(metrics.class_report(_judged(spark, d)), "precision", "recall", "f1")


@query
def m5_split_sizes(spark, d):
    return rounded(metrics.split_sizes(readers.with_split(reviews_orders(spark, d))), "fake_share")


@query
def m6_confusion(spark, d):
    return metrics.confusion(_judged(spark, d))


@query
def m7_comparison(spark, d):
    """Linear model against the sentiment alone, mapped to 0..1."""
    scored = _plain(spark, d)
    both = {"linear": scored.select("label", "fake_prob"),
            "sentiment": scored.select("label", ((F.col("sentiment") + 1) / 2).alias("fake_prob"))}
    return rounded(metrics.compare(both), "accuracy", "f1", "auc")


# --------------------------------------------------------------------------- digest
def _kept(spark, d):
    """Reviews known to be genuine."""
    return reviews_orders(spark, d).filter(F.col("label") == 0)


def _bodies(spark, d):
    return dig.candidate_sentences(_kept(spark, d)).withColumnRenamed("sentence", "body")


@query
def g1_candidates(spark, d):
    return dig.candidate_sentences(_kept(spark, d))


@query
def g2_product_tfidf(spark, d):
    return cen.text_vectors(_bodies(spark, d)).select(*cen.NODE, F.explode("vector").alias("e")).select(
        *cen.NODE, "e.term", r6("e.w", "w"))


@query
def g3_similarity(spark, d):
    """Total cosine similarity of every sentence to the others of its product."""
    return rounded(cen.similarity_sums(_bodies(spark, d)), "sim_sum")


@query
def g3_similarity_docs(spark, d):
    docs = dig.candidate_sentences(reviews_docs(spark, d)).withColumnRenamed("sentence", "body")
    return rounded(cen.similarity_sums(docs), "sim_sum")


@query
def g3_edges(spark, d):
    """Edges of the similarity graph of each source's sentences; equal sentences are one node."""
    return rounded(edges.similarity_edges(_sentences_of_docs(spark, d), 0.5), "sim")


@query
def g3_classes(spark, d):
    """The node of that graph that each sentence belongs to."""
    return edges.text_classes(_sentences_of_docs(spark, d))


def _sentences_of_docs(spark, d):
    return dig.candidate_sentences(reviews_docs(spark, d)).withColumnRenamed("sentence", "body")


@query
def g4_rank(spark, d):
    return rounded(dig.ranked_sentences(_kept(spark, d)), "centrality").drop("pick")


@query
def g4_rank_docs(spark, d):
    """Few products with many sentences."""
    return rounded(dig.ranked_sentences(reviews_docs(spark, d)), "centrality")


@query
def g5_mmr(spark, d):
    return dig.ranked_sentences(_kept(spark, d)).filter(F.col("pick") > 0).drop("centrality")


@query
def g5_mmr_docs(spark, d):
    """Picks of products whose sentences are dealt to many small blocks."""
    return dig.ranked_sentences(reviews_docs(spark, d), block_tokens=6_000).filter(F.col("pick") > 0).drop("centrality")


@query
def g7_digest(spark, d):
    """Digest of every product; products without genuine reviews included."""
    return dig.opinion_digest(_kept(spark, d), products=reviews_orders(spark, d).select("product_id").distinct())


@query
def g7_digest_turns(spark, d):
    return dig.opinion_digest(reviews_turns(spark, d))


@query
def g8_pack(spark, d):
    return dig.pack_chunks(dig.ranked_reviews(_kept(spark, d))).withColumn("n_words", F.col("n_words").cast("bigint"))


@query
def g8_pack_docs(spark, d):
    return dig.pack_chunks(dig.ranked_reviews(reviews_docs(spark, d)))


@query
def g9_bounds(spark, d):
    longest, shortest = dig.generation_bounds(F.col("n_words"))
    return reviews_docs(spark, d).select("review_id", txt.word_count(F.col("text")).alias("n_words")).select(
        "review_id", longest.alias("max_len"), shortest.alias("min_len"))


def first_words_model():
    """Stand-in for a caller's generation model: the first ``max_len`` words."""
    return lambda texts, longest, shortest: [" ".join(t.split()[:n]) for t, n in zip(texts, longest)]


@query
def g10_two_level(spark, d):
    return dig.two_level_digest(reviews_docs(spark, d), first_words_model)


# --------------------------------------------------------------------------- aspects
def _discovered(spark, d):
    return asp.discover_aspects(_kept(spark, d))


def _mentions(spark, d):
    return asp.mention_table(_kept(spark, d), discovered=_discovered(spark, d))


def _scored_mentions(spark, d):
    return asp.scored_mentions(_mentions(spark, d))


@query
def a1_aspect_terms(spark, d):
    """Which lexicon terms the sentences of all reviews hold, with plural endings."""
    rows = asp.mention_table(reviews_orders(spark, d))
    return rows.groupBy("aspect", F.lower("term").alias("term")).agg(F.count("*").alias("n"))


@query
def a2_discovery(spark, d):
    return _discovered(spark, d)


@query
def a4_a6_mentions(spark, d):
    return _mentions(spark, d).drop("sentence")


@query
def a7_span(spark, d):
    return rounded(_scored_mentions(spark, d), "score").select(
        "product_id", *asp.POSITION, "aspect", "span", "score")


def yes_no_model():
    """Stand-in for a caller's pair model: positive if the term comes early in the sentence."""
    return lambda sentences, terms: [
        {"Positive": 1.0 if s.find(t) < 10 else 0.2, "Negative": 0.1} for s, t in zip(sentences, terms)]


@query
def a8_pair_scores(spark, d):
    return rounded(scoring.pair_scores(_mentions(spark, d), yes_no_model), "score").select(
        "product_id", *asp.POSITION, "aspect", "score")


@query
def a9_votes(spark, d):
    return rounded(asp.review_votes(_scored_mentions(spark, d)), "vote")


@query
def a10_aspects(spark, d):
    return rounded(asp.analyze_aspects(_kept(spark, d), n_examples=0), "score")


@query
def a10_aspects_turns(spark, d):
    return rounded(asp.analyze_aspects(reviews_turns(spark, d), n_examples=0), "score")


@query
def a13_examples(spark, d):
    found = asp.analyze_aspects(_kept(spark, d))
    return found.select("product_id", "aspect", F.posexplode("examples").alias("i", "e")).select(
        "product_id", "aspect", (F.col("i") + 1).alias("rank"), "e.snippet", r6("e.score", "score"))


# --------------------------------------------------------------------------- report
@query
def p1_flag(spark, d):
    return report.flag(_plain(spark, d)).select("product_id", "review_id", "is_fake")


@query
def p2_genuine(spark, d):
    return report.genuine(report.flag(_plain(spark, d))).select("product_id", "review_id", "text")


@query
def p4_suspicion(spark, d):
    """Flagged reviews, most suspicious first."""
    rows = report.view(report.flag(_plain(spark, d)), "Flagged", most_suspicious_first=True)
    return rows.select("product_id", "review_id", r6("fake_prob"))


@query
def p5_reviews(spark, d):
    return report.reviews_table(report.flag(_scored(spark, d)))


@query
def p3_view(spark, d):
    """All three views of the flagged reviews."""
    flagged = materialize(report.flag(_plain(spark, d)).select("product_id", "review_id", "fake_prob", "is_fake"), "flagged")
    views = [report.view(flagged, v).select(F.lit(v).alias("shown"), "product_id", "review_id")
             for v in ("All", "Flagged", "Genuine")]
    return views[0].unionByName(views[1]).unionByName(views[2])


@query
def p5_highlighted(spark, d):
    return report.highlighted_table(report.flag(_scored(spark, d)))


@query
def p6_aspects(spark, d):
    return report.aspects_table(asp.analyze_aspects(_kept(spark, d), n_examples=0))


STATS = ["pct_fake", "raw_avg_rating", "genuine_avg_rating", "genuine_positive", "genuine_negative", "rating_shift"]


@query
def r1_r4_stats(spark, d):
    return rounded(report.product_stats(report.flag(_plain(spark, d))), *STATS)


@query
def r5_rethreshold(spark, d):
    """A first report, then one at another threshold that changes the products with a flipped review only."""
    scored = materialize(_plain(spark, d), "scored")
    store = ReportStore.build(scored)
    return _whole_report(store.report(0.7, store.report(0.5)))


@query
def r6_threshold_grid(spark, d):
    return rounded(report.threshold_grid(_plain(spark, d)), *STATS)


def _whole_report(found):
    """Statistics, digest and aspect verdicts, a row for each product."""
    verdicts = F.array_join(F.transform("aspects", lambda a: F.concat(a["aspect"], F.lit(": "), a["verdict"])), "; ")
    return rounded(found.nested(), *STATS).select(
        "product_id", "n_total", "n_fake", *STATS, "summary", "n_reviews",
        F.coalesce(verdicts, F.lit("")).alias("verdicts"))


@query
def r7_report(spark, d):
    """Statistics, digest and aspect verdicts of every product, from scoring to report."""
    fixed, dense = _given(reviews_orders(spark, d))
    return _whole_report(report.analyze(dense, fixed, featured=True))


@query
def r7_report_generated(spark, d):
    """Digests of a caller's model inside the report."""
    fixed, dense = _given(reviews_orders(spark, d))
    return report.analyze(dense, fixed, generator=first_words_model, featured=True).digest


@query
def r8_aspect_chart(spark, d):
    return report.aspect_chart(asp.analyze_aspects(_kept(spark, d), n_examples=0))
