"""Experiment sweep: one pipeline run per configuration, metrics in one table."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pipeline import Config, Pipeline


METRICS = "scope string, cluster_id int, n bigint, metric string, value double"


def grid(base: Config, entropy_ratios: list[float | None], ks: list[int | None]) -> list[Config]:
    return [replace(base, entropy_ratio=e, k=k) for e in entropy_ratios for k in ks]


def sweep(datasets: dict[str, tuple[DataFrame, DataFrame]], configs: list[Config]) -> DataFrame:
    """metrics of every (dataset, configuration) with dataset, run_id, entropy_ratio and k.

    A run is itself a set of cluster-wide jobs, so runs follow one another. A run that fails
    is a row with its ``error`` and no metric.
    """
    tables = []
    for name, (train, test) in datasets.items():
        for number, config in enumerate(configs):
            try:
                metrics = Pipeline(config).run(train, test).metrics
            except ValueError as error:
                metrics = train.sparkSession.createDataFrame([(None, None, None, None, None, str(error))], METRICS + ", error string")
            else:
                metrics = metrics.withColumn("error", F.lit(None).cast("string"))
            tables.append(metrics.select(
                F.lit(name).alias("dataset"), F.lit(number).alias("run_id"), F.lit(config.entropy_ratio).cast("double").alias("entropy_ratio"),
                F.lit(config.k).cast("int").alias("k"), "*"))
    return reduce(DataFrame.unionByName, tables)


def best_runs(metrics: DataFrame, metric: str) -> DataFrame:
    """Best overall value per dataset (smallest for errors); ties go to the first run."""
    sign = -1 if metric in ("mse", "rmse") else 1
    overall = metrics.filter((F.col("scope") == "overall") & (F.col("metric") == metric))
    order = F.struct(F.col("value") * sign, -F.col("run_id"))
    return overall.groupBy("dataset").agg(F.max_by(F.struct("run_id", "value"), order).alias("b")).select(
        "dataset", "b.run_id", "b.value")
