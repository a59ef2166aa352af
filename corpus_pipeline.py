"""Documents to training pieces: language, near-duplicates, benchmark passages, secrets, segmentation."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewsieve.llm import bagminhash, decontaminate, langid, pieces, secrets
from reviewsieve.session import materialize


BATCH = 1000  # rows that a Python worker holds at once; texts can be long
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers; a smaller setting of the session stays."""
    if not 0 < int(spark.conf.get(_BATCH_SETTING)) <= BATCH:
        spark.conf.set(_BATCH_SETTING, str(BATCH))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from all labelled documents; texts without a language or without a main language go."""
    small_batches(spark)
    model = langid.fit(docs)
    return langid.identify(docs, model).filter(langid.accept()).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    small_batches(spark)
    return bagminhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words in benchmark windows go; windows are cut from the others."""
    small_batches(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, items).withColumn("n_chars", F.length("text").cast("long"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    small_batches(spark)
    found = secrets.scan(docs).withColumn("text", secrets.redact(F.col("text"), F.col("spans")))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of the best segmentation, and the others of the N best with their scores."""
    small_batches(spark)
    found = pieces.encode(docs)
    best = F.col("segmentations")[0]["ids"]
    return found.select("doc_id", "lang", "source", best.alias("ids"), F.size(best).alias("n_pieces"), "segmentations")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secret_scan", secret_scan), ("segmentation", segmentation)]
ORACLE_SQL = None  # mixture inference, signatures, compression and the piece lattice are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each result is written, and the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
