"""Metrics per cluster and overall. Long form: scope, cluster_id, n, metric, value.

``predictions``: row_id, cluster_id, label, prediction. Every metric comes from counts or sums
that are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _levels(df: DataFrame, *aggregates: Column) -> DataFrame:
    """The same aggregates per cluster and over everything (cluster_id NULL)."""
    return df.rollup("cluster_id").agg(F.grouping("cluster_id").alias("__all"), *aggregates).withColumn(
        "scope", F.when(F.col("__all") == 1, "overall").otherwise("cluster")).drop("__all")


def merge_predictions(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Join on row_id; raises when a row has no prediction or no truth."""
    joined = predictions.join(truth, "row_id", "full")
    bad = joined.agg(F.sum(F.col("prediction").isNull().cast("int")).alias("p"),
                     F.sum(F.col("label").isNull().cast("int")).alias("t")).first()
    if bad["p"] or bad["t"]:
        raise ValueError(f"{bad['p']} rows without prediction, {bad['t']} without label")
    return joined


def accuracy(predictions: DataFrame) -> DataFrame:
    return _levels(predictions, F.count("*").alias("n"), F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("cluster_id", "label", "prediction").agg(F.count("*").alias("n"))


def f1_weighted(predictions: DataFrame) -> DataFrame:
    """F1 per class weighted by true support; classes are few, so the confusion table is small."""
    pairs = confusion(predictions)
    both = pairs.select("cluster_id", F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("truth"), F.lit(0).cast("bigint").alias("guess"), F.lit(0).cast("bigint").alias("hit")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("truth"), F.col("n").alias("guess"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0)).alias("hit")))).alias("c"))
    flat = both.select("cluster_id", "c.*")
    sums = [F.sum(x).alias(x) for x in ("truth", "guess", "hit")]
    every = flat.groupBy("cluster_id", "class").agg(*sums).withColumn("scope", F.lit("cluster")).unionByName(
        flat.groupBy("class").agg(*sums).withColumn("scope", F.lit("overall")).withColumn(
            "cluster_id", F.lit(None).cast(flat.schema["cluster_id"].dataType)))
    f1 = 2.0 * F.col("hit") / (F.col("truth") + F.col("guess"))
    return every.groupBy("scope", "cluster_id").agg(
        F.sum("truth").alias("n"), (F.sum(f1 * F.col("truth")) / F.sum("truth")).alias("f1"))


def f1_binary(predictions: DataFrame, positive: float = 1.0) -> DataFrame:
    truth, guess = F.col("label") == positive, F.col("prediction") == positive
    count = lambda c: F.sum(c.cast("bigint"))
    sums = predictions.agg(F.count("*").alias("n"), count(truth & guess).alias("tp"), count(truth).alias("t"), count(guess).alias("g"))
    return sums.select("n", F.when(F.col("t") + F.col("g") == 0, 0.0).otherwise(2.0 * F.col("tp") / (F.col("t") + F.col("g"))).alias("f1"))


def mse_rmse(predictions: DataFrame) -> DataFrame:
    error = F.col("label") - F.col("prediction")
    return _levels(predictions, F.count("*").alias("n"), F.avg(error * error).alias("mse")).withColumn("rmse", F.sqrt("mse"))


def r2(predictions: DataFrame) -> DataFrame:
    """1 - SSE/SST; constant target gives 1 if exact, else 0; fewer than two rows give NaN."""
    error = F.col("label") - F.col("prediction")
    sums = _levels(predictions, F.count("*").alias("n"), F.sum(error * error).alias("sse"),
                   (F.var_pop("label") * F.count("*")).alias("sst"),
                   (F.max("label") == F.min("label")).alias("constant"))
    score = (F.when(F.col("n") < 2, F.lit(float("nan")))
             .when(F.col("constant"), (F.col("sse") == 0).cast("double"))
             .otherwise(1 - F.col("sse") / F.col("sst")))
    return sums.select("scope", "cluster_id", "n", score.alias("r2"))


def target_range(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.max("label").alias("y_max"), F.min("label").alias("y_min"))


def metrics(predictions: DataFrame, task: str) -> DataFrame:
    """All metrics of a task in long form."""
    def long(df: DataFrame, *names: str) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).cast("double").alias("value")) for x in names])
        return df.select("scope", "cluster_id", "n", F.explode(entries).alias("m")).select("scope", "cluster_id", "n", "m.*")

    if task == "clf":
        weighted = f1_weighted(predictions)
        labels = predictions.agg(F.count_distinct("label")).scalar()
        kind = predictions.schema["cluster_id"].dataType
        binary = f1_binary(predictions).withColumn("scope", F.lit("overall")).withColumn("cluster_id", F.lit(None).cast(kind))
        overall = weighted.filter((F.col("scope") == "cluster") | (labels != 2)).unionByName(
            binary.filter(labels == 2).select("scope", "cluster_id", "n", "f1"))
        return long(accuracy(predictions), "accuracy").unionByName(long(overall, "f1"))
    return long(mse_rmse(predictions), "mse", "rmse").unionByName(long(r2(predictions), "r2"))
