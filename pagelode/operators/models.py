"""Features, clusters and probes over vectors and texts."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, MinMaxScaler, Normalizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .stats import spread_rank


def as_vectors(df: DataFrame, vector: str, name: str = "features") -> DataFrame:
    return df.where(F.col(vector).isNotNull()).withColumn(name, array_to_vector(F.col(vector).cast("array<double>")))


def scaled(df: DataFrame, kind: str, name: str = "features") -> DataFrame:
    """L2 normalised, standardised or min-max scaled features."""
    if kind == "l2":
        return Normalizer(p=2.0, inputCol=name, outputCol="__s").transform(df).drop(name).withColumnRenamed("__s", name)
    scaler = StandardScaler(withMean=True, withStd=True, inputCol=name, outputCol="__s") if kind == "standard" else MinMaxScaler(inputCol=name, outputCol="__s")
    return scaler.fit(df).transform(df).drop(name).withColumnRenamed("__s", name)


def principal(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """The first k principal components of centred vectors."""
    x = scaled(as_vectors(df, vector).select(key, "features"), "standard")
    return PCA(k=k, inputCol="features", outputCol="p").fit(x).transform(x).select(key, vector_to_array("p").alias("components"))


def residual_codes(df: DataFrame, key: str, vector: str, levels: int = 8, k: int = 32, seed: int = 42) -> DataFrame:
    """Residual quantisation: at each level the nearest of k centres of what the levels before left over."""
    rest = durable(as_vectors(df, vector).select(key, "features", F.array().cast("array<int>").alias("codes")))
    for level in range(levels):
        fitted = KMeans(k=k, seed=seed + level, featuresCol="features", predictionCol="c").fit(rest)
        centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in fitted.clusterCenters()])
        moved = fitted.transform(rest).withColumn("x", F.zip_with(vector_to_array("features"), F.element_at(centres, F.col("c") + 1), lambda a, b: a - b))
        rest = durable(moved.select(key, array_to_vector("x").alias("features"), F.concat("codes", F.array("c")).alias("codes")))
    norm = F.sqrt(F.aggregate(vector_to_array("features"), F.lit(0.0), lambda s, x: s + x * x))
    return rest.select(key, "codes", norm.alias("residual_norm"))


def auc(scored: DataFrame, by: str, score: str, label: str) -> DataFrame:
    """Exact area under the ROC curve by average ranks, and average precision, per group."""
    counts = scored.groupBy(by, score).agg(F.count(F.lit(1)).alias("c"), F.sum(label).alias("p"))
    up = Window.partitionBy(by).orderBy(score).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(by).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("rank", F.sum("c").over(up) - (F.col("c") - 1) / 2).withColumn("prec", F.sum("p").over(down) / F.sum("c").over(down))
    out = ranked.groupBy(by).agg(F.sum(F.col("p") * F.col("rank")).alias("r"), F.sum("p").alias("np"), F.sum("c").alias("n"), F.sum(F.col("prec") * F.col("p")).alias("ap"))
    area = F.try_divide(F.col("r") - F.col("np") * (F.col("np") + 1) / 2, F.col("np") * (F.col("n") - F.col("np")))
    return out.select(by, "n", area.alias("roc_auc"), F.try_divide("ap", "np").alias("pr_auc"))


def cross_validated(df: DataFrame, key: str, vector: str, label: str, folds: int = 5, reg: float = 0.01, seed: int = 42, method: str = "l2") -> DataFrame:
    """Accuracy, ROC and PR areas of a classifier on each held-out fold; folds are stratified by label.

    ``method`` is l2 or l1 (logistic regression), gaussian or multinomial
    (naive Bayes; multinomial needs features of at least 0).
    """
    ranked = spread_rank(df.where(F.col(label).isNotNull()), [label], F.xxhash64(F.lit(seed), F.col(key)), key, "fold")
    data = durable(as_vectors(ranked.withColumn("fold", (F.col("fold") % folds).cast("int")), vector).select(key, "features", F.col(label).alias("y"), "fold"))
    parts = None
    for i in range(folds):
        model = _classifier(method, reg).fit(data.where(F.col("fold") != i))
        part = model.transform(data.where(F.col("fold") == i)).select("fold", "y", "prediction", vector_to_array("probability")[1].alias("score"))
        parts = part if parts is None else parts.unionByName(part)
    parts = durable(parts)
    accuracy = parts.groupBy("fold").agg(F.avg((F.col("prediction") == F.col("y")).cast("double")).alias("accuracy"))
    return auc(parts, "fold", "score", "y").join(accuracy, "fold")


def silhouette(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Mean silhouette of labelled vectors under squared Euclidean distance: one row."""
    x = as_vectors(df, vector).withColumn("prediction", F.col(label).cast("int"))
    value = ClusteringEvaluator(featuresCol="features", predictionCol="prediction").evaluate(x)
    return df.sparkSession.createDataFrame([(float(value),)], "silhouette double")


def tf_idf(df: DataFrame, key: str, text: str, top: int) -> DataFrame:
    """The ``top`` terms of each text by sublinear term frequency times smoothed inverse document frequency."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[a-z]{2,}"), F.lit(0))
    tf = df.where(F.col(text).isNotNull()).select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    n = df.where(F.col(text).isNotNull()).count()
    frequency = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = tf.join(frequency, "term").withColumn("weight", (1 + F.log("tf")) * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col("weight").desc(), "term"))).where(F.col("rank") <= top)


def _classifier(method: str, reg: float):
    columns = {"featuresCol": "features", "labelCol": "y"}
    if method in ("l1", "l2"):
        return LogisticRegression(**columns, regParam=reg, elasticNetParam=float(method == "l1"), maxIter=50)
    if method in ("gaussian", "multinomial"):
        return NaiveBayes(**columns, modelType=method)
    raise ValueError(f"unknown method {method}")
