"""A trained style model: standardised measures, weighted logistic regression, stratified folds."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import FEATURES

LEAST_PER_CLASS = 50


def balanced(rows: DataFrame, label: str = "label") -> DataFrame:
    """rows with a weight that makes both classes count the same."""
    n = rows.groupBy(label).agg(F.count("*").alias("__n"))
    total = n.agg(F.sum("__n").alias("__t"), F.count("*").alias("__k"))
    weights = n.crossJoin(total).select(label, (F.col("__t") / (F.col("__k") * F.col("__n"))).alias("weight"))  # two rows by one
    return rows.join(F.broadcast(weights), label)


def estimator(label: str = "label") -> Pipeline:
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="raw")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True)
    return Pipeline(stages=[vector, scaler, LogisticRegression(labelCol=label, weightCol="weight", regParam=0.01, maxIter=50)])


def train(rows: DataFrame, label: str = "label", least: int = LEAST_PER_CLASS) -> PipelineModel:
    """rows has the measures and a 0/1 label; fewer than `least` rows of a class are refused."""
    few = [r for r in rows.groupBy(label).count().collect() if r["count"] < least]
    if few or rows.select(label).distinct().count() < 2:
        raise ValueError(f"at least {least} rows of each class are needed")
    return estimator(label).fit(balanced(rows, label))


def with_folds(rows: DataFrame, k: int, key: str, label: str = "label") -> DataFrame:
    """rows with a fold by the hash of key and label: no class is brought together, and folds have about equal shares of each."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(key, label), F.lit(k)).cast("int"))


def cross_validated(rows: DataFrame, k: int = 3, key: str = "doc_id", label: str = "label") -> DataFrame:
    """fold, n, accuracy, precision, recall, f1, auc of each of k folds; measures that are not defined are null."""
    folded = with_folds(rows, k, key, label).persist()
    out = []
    try:
        for i in range(k):
            model = estimator(label).fit(balanced(folded.where(F.col("fold") != i), label))
            held = model.transform(folded.where(F.col("fold") == i)).select(label, "prediction", "rawPrediction").persist()
            y, p = F.col(label) == 1, F.col("prediction") == 1
            r = held.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c.cast("int")), F.lit(0)).alias(a) for a, c in (("tp", y & p), ("fp", ~y & p), ("fn", y & ~p), ("tn", ~y & ~p)))).first()
            both = r["tp"] + r["fn"] and r["fp"] + r["tn"]
            auc = BinaryClassificationEvaluator(labelCol=label).evaluate(held) if both else None
            held.unpersist()
            precision, recall = _ratio(r["tp"], r["tp"] + r["fp"]), _ratio(r["tp"], r["tp"] + r["fn"])
            f1 = _ratio(2 * r["tp"], 2 * r["tp"] + r["fp"] + r["fn"])
            out.append((i, r["n"], _ratio(r["tp"] + r["tn"], r["n"]), precision, recall, f1, auc))
    finally:
        folded.unpersist()
    return rows.sparkSession.createDataFrame(out, "fold int, n long, accuracy double, precision double, recall double, f1 double, auc double")


def _ratio(a: int, b: int) -> float | None:
    return a / b if b else None


def fold_means(folds: DataFrame) -> DataFrame:
    """The mean of each measure over the folds that have it; NaN counts as missing."""
    return folds.agg(*(F.round(F.avg(F.when(~F.isnan(c), F.col(c))), 4).alias(c) for c in ("accuracy", "precision", "recall", "f1", "auc")), F.sum("n").alias("n"), F.count("*").alias("folds"))


def sources_of(rows: DataFrame, source: str = "source") -> DataFrame:
    """The distinct sources of a corpus in order, as one array; sources are few."""
    return rows.agg(F.sort_array(F.collect_set(source)).alias("sources"), F.count("*").alias("n"))


def class_counts(rows: DataFrame, label: str = "label", least: int = LEAST_PER_CLASS) -> DataFrame:
    """label, n, enough of each class."""
    return rows.groupBy(label).agg(F.count("*").alias("n")).withColumn("enough", F.col("n") >= least)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with style_probability of label 1."""
    return model.transform(rows).withColumn("style_probability", vector_to_array("probability")[1]).drop("raw", "features", "rawPrediction", "probability", "prediction")
