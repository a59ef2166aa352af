"""Opinion digest: the sentences that best stand for the genuine reviews of each product."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions.text import strip, word_count
from ..session import materialize
from .aspects import sentence_table
from .centrality import NODE, TIE_DIGITS, rank_texts
from .distribute import salted_top, top_k
from .scoring import score_batches


def filled(reviews: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Reviews with stripped text, blank ones left out."""
    return reviews.select("product_id", "review_id", *extra, strip(F.col("text")).alias("text")).filter(F.col("text") != "")


def candidate_sentences(reviews: DataFrame) -> DataFrame:
    """(product_id, review_id, sent_no, sentence) of 4 to 40 words."""
    return sentence_table(filled(reviews)).filter(
        word_count(F.col("sentence")).between(lx.DIGEST_MIN_WORDS, lx.DIGEST_MAX_WORDS))


def ranked_sentences(reviews: DataFrame, picks: int = lx.DIGEST_SENTENCES, **options) -> DataFrame:
    """Candidate sentences with ``centrality`` and MMR ``pick``."""
    candidates = candidate_sentences(reviews)
    return rank_texts(candidates.withColumnRenamed("sentence", "body"), picks, **options)


def _joined(rows: DataFrame, order: list[str], text: str) -> DataFrame:
    """(product_id, summary): texts of a bounded number of rows per product, in order."""
    lists = rows.groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct(*order, text))).alias("l"))
    return lists.select("product_id", F.array_join(F.col(f"l.{text}"), " ").alias("summary"))


def opinion_digest(reviews: DataFrame, products: DataFrame | None = None, picks: int = lx.DIGEST_SENTENCES,
                   **options) -> DataFrame:
    """(product_id, summary, backend, n_reviews), one row per product.

    ``products(product_id)`` adds products without any genuine review.
    A product without candidate sentences gets the start of its joined reviews;
    one whose sentences cannot be compared gets its first sentences.
    """
    return digest_of(materialize(candidate_sentences(reviews), "candidates"), filled(reviews), products, picks, **options)


def digest_of(candidates: DataFrame, kept: DataFrame, products: DataFrame | None = None,
              picks: int = lx.DIGEST_SENTENCES, **options) -> DataFrame:
    """The digest from stored sentences and ``kept(product_id, review_id, text)``, of whose texts the start will do."""
    ranked = rank_texts(candidates.withColumnRenamed("sentence", "body"), picks, **options)
    chosen = ranked.filter(F.col("pick") > 0).select(*NODE, "pick").join(candidates, NODE)
    extract = _joined(chosen, ["pick"], "sentence")

    # both fallbacks look only at the products that need them
    unpicked = candidates.join(chosen.select("product_id").distinct(), "product_id", "left_anti")
    first = top_k(unpicked, ["product_id"], [F.col("review_id"), F.col("sent_no")], picks)
    start = _joined(first, ["rank"], "sentence")
    # a joined review has at least one character, and a space before the next, so this many reviews fill the limit
    bare = kept.join(candidates.select("product_id").distinct(), "product_id", "left_anti")
    enough = top_k(bare, ["product_id"], [F.col("review_id")], lx.DIGEST_FALLBACK_CHARS // 2 + 1)
    opening = _joined(enough.withColumn("text", F.substring("text", 1, lx.DIGEST_FALLBACK_CHARS)), ["rank"], "text")
    opening = opening.withColumn("summary", F.substring("summary", 1, lx.DIGEST_FALLBACK_CHARS))

    counts = kept.groupBy("product_id").agg(F.count("*").alias("n_reviews"))
    out = counts if products is None else products.join(counts, "product_id", "left")
    out = out.join(extract, "product_id", "left")
    for fallback, name in [(start, "_start"), (opening, "_opening")]:
        out = out.join(fallback.withColumnRenamed("summary", name), "product_id", "left")
    return out.select(
        "product_id", F.coalesce("summary", "_start", "_opening", F.lit(lx.DIGEST_EMPTY)).alias("summary"),
        F.lit("extractive").alias("backend"), F.coalesce("n_reviews", F.lit(0).cast("bigint")).alias("n_reviews"))


# ------------------------------------------------------------------ two-level digest with a caller's model
def generation_bounds(n_words: Column) -> tuple[Column, Column]:
    """(max_len, min_len) for a summary of a text of that many words."""
    longest = F.floor(F.least(F.lit(160.0), F.greatest(F.lit(40.0), n_words * 0.6))).cast("int")
    shortest = F.floor(F.least(longest - 10.0, F.greatest(F.lit(15.0), n_words * 0.15))).cast("int")
    return longest, shortest


def ranked_reviews(reviews: DataFrame, **options) -> DataFrame:
    """(product_id, review_id, n_words, centrality) of the reviews that are not blank."""
    kept = materialize(filled(reviews).withColumn("sent_no", F.lit(0)), "filled")
    ranks = rank_texts(kept.withColumnRenamed("text", "body"), **options)
    words = kept.select(*NODE, word_count(F.col("text")).alias("n_words"))
    return words.join(ranks, NODE).select("product_id", "review_id", "n_words",
                                          F.round("centrality", TIE_DIGITS).alias("centrality"))


def pack_chunks(ranked: DataFrame, chunk_words: int = lx.CHUNK_WORDS, max_chunks: int = lx.MAX_CHUNKS) -> DataFrame:
    """(product_id, review_id, chunk_no, n_words): most central reviews first, greedily into chunks.

    A review over the remaining budget is skipped and smaller ones may follow.
    Among reviews of one length the accepted ones are a prefix, and at most
    budget / length of them, so few rows per product take part in the sequential
    step however large the product is. Reviews without words cost nothing and
    are always accepted; one per gap between the others stands for them there.
    """
    budget = chunk_words * max_chunks
    key = F.struct((-F.col("centrality")).alias("down"), F.col("review_id").alias("review_id"))
    rows = ranked.select("product_id", "review_id", "n_words", "centrality", key.alias("key"))
    worded = salted_top(
        rows.filter(F.col("n_words").between(1, budget)), ["product_id", "n_words"],
        [F.desc("centrality"), F.col("review_id")], F.floor(budget / F.col("n_words")), F.col("review_id"))
    worded = worded.select("product_id", "key", "n_words")
    keys = worded.groupBy("product_id").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    silent = rows.filter(F.col("n_words") == 0).join(keys, "product_id", "left").select(
        "product_id", "key", F.coalesce(F.size(F.filter("keys", lambda k: k < F.col("key"))), F.lit(0)).alias("gap"))
    stand_ins = silent.groupBy("product_id", "gap").agg(F.min("key").alias("key"))
    events = worded.unionByName(stand_ins.select("product_id", "key", F.lit(0).alias("n_words")))
    lists = events.groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct("key", "n_words"))).alias("l"))

    id_type = ranked.schema["review_id"].dataType.simpleString()
    item = f"struct<review_id:{id_type},chunk_no:int,n_words:int>"
    begin = F.struct(F.lit(0).alias("used"), F.lit(0).alias("filled"), F.lit(0).alias("chunk"),
                     F.array().cast(f"array<{item}>").alias("items"))

    def step(s: Column, e: Column) -> Column:
        n = e["n_words"]
        opens = (s["chunk"] == 0) | (s["filled"] + n > chunk_words)
        chunk = s["chunk"] + F.when(opens, 1).otherwise(0)
        entry = F.struct(e["key"]["review_id"].alias("review_id"), chunk.alias("chunk_no"), n.alias("n_words"))
        taken = F.struct((s["used"] + n).alias("used"), F.when(opens, n).otherwise(s["filled"] + n).alias("filled"),
                         chunk.alias("chunk"), F.concat(s["items"], F.array(entry)).alias("items"))
        return F.when(s["used"] + n > budget, s).otherwise(taken)

    packed = lists.select("product_id", F.explode(F.aggregate("l", begin, step, lambda s: s["items"])).alias("i"))
    packed = packed.select("product_id", "i.review_id", "i.chunk_no", "i.n_words")
    chunk_of = packed.filter(F.col("n_words") == 0).select(
        "product_id", F.col("review_id").alias("_stand_in"), "chunk_no")
    named = stand_ins.select("product_id", "gap", F.col("key.review_id").alias("_stand_in"))
    quiet = silent.join(named, ["product_id", "gap"]).join(chunk_of, ["product_id", "_stand_in"]).select(
        "product_id", F.col("key.review_id").alias("review_id"), "chunk_no", F.lit(0).alias("n_words"))
    return packed.filter(F.col("n_words") > 0).unionByName(quiet)


def two_level_digest(reviews: DataFrame, factory: Callable[[], Callable], ranked: DataFrame | None = None,
                     **options) -> DataFrame:
    """(product_id, summary, n_chunks): summarise each chunk, then the joined summaries if there are several.

    ``factory`` builds a model (texts, max_lens, min_lens) -> summaries. Chunk
    texts hold their reviews most central first, those without words included.
    """
    ranked = materialize(ranked if ranked is not None else ranked_reviews(reviews, **options), "ranked-reviews")
    packed = pack_chunks(ranked)
    texts = packed.join(ranked.select("product_id", "review_id", "centrality"), ["product_id", "review_id"]).join(
        filled(reviews), ["product_id", "review_id"])
    # a chunk is one text for the model: bounded by its words, besides the reviews without any
    chunks = texts.groupBy("product_id", "chunk_no").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("centrality")).alias("down"), "review_id", "text"))).alias("l"),
        F.sum("n_words").alias("n_words"))
    chunks = chunks.select("product_id", "chunk_no", "n_words", F.array_join("l.text", " ").alias("text"))
    partial = _generate(chunks, factory)
    joined = partial.groupBy("product_id").agg(
        F.sort_array(F.collect_list(F.struct("chunk_no", "summary"))).alias("l"), F.count("*").alias("n_chunks"))
    joined = materialize(joined.select("product_id", "n_chunks", F.array_join("l.summary", " ").alias("text")),
                         "chunk-summaries")
    single = joined.filter(F.col("n_chunks") == 1).select("product_id", F.col("text").alias("summary"), "n_chunks")
    several = joined.filter(F.col("n_chunks") > 1).withColumn("n_words", word_count(F.col("text")))
    return single.unionByName(_generate(several, factory).select("product_id", "summary", "n_chunks"))


def generated_digest(reviews: DataFrame, factory: Callable[[], Callable], products: DataFrame | None = None,
                     **options) -> DataFrame:
    """(product_id, summary, backend, n_reviews) as of ``opinion_digest``, written by the caller's model."""
    kept = materialize(filled(reviews), "digest-reviews")
    counts = kept.groupBy("product_id").agg(F.count("*").alias("n_reviews"))
    out = counts if products is None else products.join(counts, "product_id", "left")
    written = two_level_digest(kept, factory, **options).select("product_id", "summary")
    return out.join(written, "product_id", "left").select(
        "product_id", F.coalesce("summary", F.lit(lx.DIGEST_EMPTY)).alias("summary"),
        F.lit("abstractive").alias("backend"), F.coalesce("n_reviews", F.lit(0).cast("bigint")).alias("n_reviews"))


def _generate(texts: DataFrame, factory: Callable[[], Callable]) -> DataFrame:
    longest, shortest = generation_bounds(F.col("n_words"))
    bounded = texts.withColumn("max_len", longest).withColumn("min_len", shortest)
    return score_batches(bounded, factory, ["text", "max_len", "min_len"], "summary", "string").drop("text")
