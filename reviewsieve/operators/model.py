"""The linear fake-review model: fit, score, explain, save, load."""
from __future__ import annotations

import copy
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import lexicons as lx
from ..functions.columns import doubles, join_by_review, let, review_keys
from ..session import materialize
from . import explain
from .features import Scaler, dense_features, local_features
from .langmodel import BigramModel, fit_bigrams, log_perplexity, with_folds, with_log_perplexity
from .vectorize import Vectorizer


@dataclass
class TrustModel:
    """Everything fitted. All parts but the language model are bounded by the vocabulary limit."""

    vectorizer: Vectorizer
    text_coef: list[float]
    scaler: Scaler
    dense_coef: list[float]
    intercept: float
    language: BigramModel | None  # None after a fit with the caller's perplexity
    dense_weight: float = 1.0
    sentiment_col: str | None = None  # the caller's sentiment, if the fit used one

    @property
    def use_text(self) -> bool:
        return bool(self.text_coef)

    @property
    def use_dense(self) -> bool:
        return bool(self.dense_coef)

    # ------------------------------------------------------------------ scoring
    def score(self, reviews: DataFrame, external: DataFrame | None = None, perplexity: DataFrame | None = None,
              sentiment_col: str | None = None, explained: bool = True, featured: bool = False,
              top_phrases: int = lx.TOP_PHRASES, top_reasons: int = lx.TOP_REASONS) -> DataFrame:
        """``reviews(review_id, text, rating, ...)`` plus ``sentiment``, ``fake_prob`` and explanations.

        Text weights, phrases and style features are row-local. Only the language
        model needs other tables, so its one number per review is joined in.
        ``external(product_id, review_id, p_ext)`` is averaged in where it has a value;
        ``perplexity(product_id, review_id, log_perplexity)`` replaces the built-in one;
        a model fitted with the caller's perplexity needs it here too. The sentiment
        column is that of the fit, unless another one is named. ``featured``: the reviews
        come from ``dense_features`` and hold all features, which are not computed again.
        """
        sentiment_col = sentiment_col or self.sentiment_col
        if self.use_dense and perplexity is None and self.language is None and not featured:
            raise ValueError("the model was fitted with the caller's perplexity: pass perplexity= to score")
        kept = [c for c in reviews.columns if not (featured and c in ("sentiment", *lx.DENSE_FEATURES))]
        out = reviews
        if self.use_text:
            out = self._with_text(out, explained, top_phrases)
        else:
            out = out.withColumn("_z_text", F.lit(0.0))
        out = out if featured else local_features(out, sentiment_col)
        out = out.withColumn("_z_dense", F.lit(0.0))
        if self.use_dense:
            if not featured:
                out = (join_by_review(out, perplexity) if perplexity is not None
                       else with_log_perplexity(out, self.language))
            out = out.withColumn("_z", self.scaler.vector(self.dense_weight))
            out = out.withColumn("_z_dense", dot("_z", self.dense_coef))
        linear = 1.0 / (1.0 + F.exp(-(F.col("_z_text") + F.col("_z_dense") + self.intercept)))
        out = out.withColumn("fake_prob", linear)
        if external is not None:
            out = fuse(out, external)
        if not explained:
            return out.select(*kept, "sentiment", "fake_prob")
        none = "array<struct<{}:string,weight:double>>"
        shown = F.col("_phrases") if self.use_text else F.array().cast(none.format("phrase"))
        why = (explain.reasons(F.col("_z"), self.dense_coef, self.scaler.features, top_reasons)
               if self.use_dense else F.array().cast(none.format("reason")))
        return out.select(*kept, "sentiment", "fake_prob", shown.alias("phrases"), why.alias("reasons"))

    def _with_text(self, reviews: DataFrame, explained: bool, top_phrases: int) -> DataFrame:
        out = self.text_contributions(reviews).withColumn(
            "_z_text", F.aggregate("_text.contributions", F.lit(0.0), lambda a, x: a + x))
        if explained:
            out = out.withColumn("_phrases", explain.phrases(
                F.col("_text.indices"), F.col("_text.contributions"), self.vectorizer.terms, top_phrases))
        return out.drop("_text")

    def text_contributions(self, reviews: DataFrame, name: str = "_text") -> DataFrame:
        """Add struct<indices, contributions>: weight x coefficient of every known term of a row."""
        coef = doubles(self.text_coef)
        vectors = self.vectorizer.transform(reviews, "_tfidf")
        return vectors.withColumn(name, F.struct(
            F.col("_tfidf.indices").alias("indices"),
            F.zip_with("_tfidf.indices", "_tfidf.values", lambda i, x: x * F.element_at(coef, i + 1))
            .alias("contributions"))).drop("_tfidf")

    def term_table(self, spark: SparkSession) -> DataFrame:
        rows = zip(range(len(self.vectorizer)), self.vectorizer.terms, self.vectorizer.idf,
                   self.text_coef or [0.0] * len(self.vectorizer))
        return spark.createDataFrame(list(rows), "idx int, term string, idf double, coef double")

    def feature_table(self, spark: SparkSession) -> DataFrame:
        rows = zip(range(len(self.scaler.features)), self.scaler.features, self.scaler.mean, self.scaler.scale,
                   self.dense_coef or [0.0] * len(self.scaler.features))
        return spark.createDataFrame(list(rows), "pos int, feature string, mean double, scale double, coef double")

    # ------------------------------------------------------------------ storage
    def save(self, spark: SparkSession, path: str) -> None:
        """Write the model as parquet tables below ``path``."""
        self.term_table(spark).coalesce(1).write.parquet(f"{path}/terms")
        self.feature_table(spark).coalesce(1).write.parquet(f"{path}/features")
        if self.language is not None:
            self.language.pairs.write.parquet(f"{path}/pairs")
        meta = [(self.intercept, self.dense_weight, self.use_text, self.use_dense,
                 self.language.folds if self.language is not None else None, self.sentiment_col)]
        spark.createDataFrame(meta, "intercept double, dense_weight double, use_text boolean, use_dense boolean, "
                                    "folds int, sentiment_col string").coalesce(1).write.parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TrustModel:
        meta = spark.read.parquet(f"{path}/meta").first()
        terms = spark.read.parquet(f"{path}/terms").orderBy("idx").collect()
        dense = spark.read.parquet(f"{path}/features").orderBy("pos").collect()
        language = None
        if meta["folds"] is not None:
            language = BigramModel(spark.read.parquet(f"{path}/pairs"), meta["folds"])
        return cls(
            Vectorizer([r["term"] for r in terms], [r["idf"] for r in terms]),
            [r["coef"] for r in terms] if meta["use_text"] else [],
            Scaler([r["feature"] for r in dense], [r["mean"] for r in dense], [r["scale"] for r in dense]),
            [r["coef"] for r in dense] if meta["use_dense"] else [],
            meta["intercept"], language, meta["dense_weight"], meta["sentiment_col"])


def dot(array_col: str, weights: list[float]) -> Column:
    return F.aggregate(F.zip_with(F.col(array_col), doubles(weights), lambda x, w: x * w),
                       F.lit(0.0), lambda a, x: a + x)


def fuse(scored: DataFrame, external: DataFrame) -> DataFrame:
    """Average ``fake_prob`` with ``external(product_id, review_id, p_ext)`` where that has a value."""
    both = join_by_review(scored, external.select(*review_keys(scored, external), "p_ext"))
    return both.withColumn("fake_prob", F.coalesce((F.col("fake_prob") + F.col("p_ext")) / 2.0,
                                                   F.col("fake_prob"))).drop("p_ext")


def class_weights(labelled: DataFrame) -> DataFrame:
    """(label, weight): n / (2 n_c), so that both classes weigh the same; rows without a label do not count."""
    per_class = labelled.filter(F.col("label").isNotNull()).groupBy("label").agg(F.count("*").alias("n_c"))
    n = per_class.agg(F.sum("n_c").alias("n")).scalar()
    return per_class.select("label", (n / (2 * F.col("n_c"))).alias("weight"))


def as_vectors(rows: DataFrame, size: int, indices: Column, values: Column) -> DataFrame:
    """(label, weight, features): sparse vectors, put together in Catalyst, written, and read with the vector type."""
    parts = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), indices.alias("indices"),
                     values.alias("values"))
    kind = T.StructType([T.StructField("label", T.DoubleType()), T.StructField("weight", T.DoubleType()),
                         T.StructField("features", VectorUDT())])
    return materialize(rows.select("label", "weight", parts.alias("features")), "vectors", kind)


@dataclass
class TrainingTable:
    """Dense features of the training reviews, written once and shared by all fits; term weights are row-local."""

    rows: DataFrame  # label, weight, text, _z array
    vectorizer: Vectorizer
    scaler: Scaler
    language: BigramModel | None
    count: int
    dense_weight: float
    sentiment_col: str | None = None


def prepare(labelled: DataFrame, max_features: int = lx.MAX_FEATURES, dense_weight: float = 1.0,
            folds: int = lx.FOLDS, perplexity: DataFrame | None = None,
            sentiment_col: str | None = None) -> TrainingTable:
    """Fit language model, vocabulary and scaler on ``labelled(review_id, text, rating, label)``.

    Rows without a label take no part. ``perplexity`` and ``sentiment_col`` replace
    the built-in scores, as in ``TrustModel.score``.
    """
    labelled = labelled.filter(F.col("label").isNotNull())
    language = None
    if perplexity is not None:
        rows, lp = materialize(labelled, "labelled"), perplexity
    else:
        rows = materialize(with_folds(labelled, folds), "folds")
        crossfit = fit_bigrams(rows.filter(F.col("label") == 0), folds)
        crossfit = BigramModel(materialize(crossfit.pairs, "pairs"), folds)
        lp, language = log_perplexity(rows, crossfit), crossfit.without_folds()
    vectorizer = Vectorizer.fit(rows, max_features)
    features = materialize(dense_features(rows, lp, sentiment_col), "features")
    scaler = Scaler.fit(features)
    weights = {r["label"]: r["weight"] for r in class_weights(rows).collect()}  # one row per class
    weight = F.lit(None).cast("double")
    for label, value in weights.items():
        weight = F.when(F.col("label") == label, value).otherwise(weight)
    shared = features.select(F.col("label").cast("double").alias("label"), weight.alias("weight"), "text",
                             scaler.vector(dense_weight).alias("_z"))
    return TrainingTable(shared, vectorizer, scaler, language, features.count(), dense_weight, sentiment_col)


def fit_table(table: TrainingTable, c: float = lx.INVERSE_REGULARISATION, use_text: bool = True,
              use_dense: bool = True, max_iter: int = lx.MAX_ITERATIONS) -> TrustModel:
    """L2 logistic regression on one or both feature blocks."""
    n_text = len(table.vectorizer) if use_text else 0
    n_dense = len(table.scaler.features) if use_dense else 0
    rows, indices, values = table.rows, [], []
    if use_text:
        rows = table.vectorizer.transform(rows)
        indices.append(F.col("tfidf.indices"))
        values.append(F.col("tfidf.values"))
    if use_dense:
        indices.append(F.sequence(F.lit(n_text), F.lit(n_text + n_dense - 1)))
        values.append(F.col("_z"))
    packed = as_vectors(rows, n_text + n_dense, F.concat(*indices), F.concat(*values))
    solver = LogisticRegression(regParam=1.0 / (c * table.count), elasticNetParam=0.0, standardization=False,
                                weightCol="weight", maxIter=max_iter, tol=1e-6)
    fitted = solver.fit(packed)
    coefficients = [float(x) for x in fitted.coefficients.toArray()]
    return TrustModel(copy.copy(table.vectorizer), coefficients[:n_text], table.scaler, coefficients[n_text:],
                      float(fitted.intercept), table.language, table.dense_weight, table.sentiment_col)


def fit(labelled: DataFrame, c: float = lx.INVERSE_REGULARISATION, max_features: int = lx.MAX_FEATURES,
        dense_weight: float = 1.0, **options) -> TrustModel:
    return fit_table(prepare(labelled, max_features, dense_weight, **options), c)


def coefficients(model: TrustModel, spark: SparkSession) -> DataFrame:
    """(block, name, coef): every coefficient of a model, and its intercept."""
    def block(table: DataFrame, kind: str, name: str) -> DataFrame:
        return table.select(F.lit(kind).alias("block"), F.col(name).alias("name"), "coef")

    intercept = spark.range(1).select(F.lit("intercept").alias("block"), F.lit("").alias("name"),
                                      F.lit(model.intercept).alias("coef"))
    return block(model.term_table(spark), "text", "term").unionByName(
        block(model.feature_table(spark), "dense", "feature")).unionByName(intercept)


def ablation(table: TrainingTable, test: DataFrame, external: DataFrame | None = None,
             perplexity: DataFrame | None = None) -> DataFrame:
    """(model, accuracy, f1, auc) for both blocks, text only and dense only; with an outside score also for that
    alone and for the fused model."""
    from .metrics import compare
    test = materialize(test, "test")
    external = materialize(external, "external") if external is not None else None
    lp = materialize(perplexity if perplexity is not None else log_perplexity(test, table.language), "perplexity")
    variants = {"text and dense": (True, True), "text only": (True, False), "dense only": (False, True)}
    scored = {}
    for name, (text, dense) in variants.items():
        model = fit_table(table, use_text=text, use_dense=dense)
        scored[name] = model.score(test, perplexity=lp, explained=False).select("label", "fake_prob")
        if external is not None and text and dense:
            alone = join_by_review(test, external.select(*review_keys(test, external), "p_ext"))
            scored["outside only"] = alone.filter("p_ext is not null").select(
                "label", F.col("p_ext").cast("double").alias("fake_prob"))
            scored["fused"] = model.score(
                test, external=external, perplexity=lp, explained=False).select("label", "fake_prob")
    return compare(scored)
