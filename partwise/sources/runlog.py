"""Summaries of run logs: one row per log file, one column per item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textfiles import register

# Item names as they stand in the log files, in matching order.
CONFIGURATION_KEYS = [
    "Task type", "SVM implementation", "Parallel training", "Clustering enabled",
    "Cascade clustering", "Fixed k", "Algorithm", "Method", "k range", "Parallel clustering",
    "entorpy selection", "Entropy ratio", "Cluster jobs",
    "Data balancing enabled", "Minimum class ratio", "Maximum balance samples",
    "Feature processing enabled", "Feature construction", "Mutual info selection",
    "Tuning enabled", "Optimizer", "Number of iterations", "Cross-validation folds", "Parallel tuning",
    "Tuning jobs", "cluster number",
]
RESULT_KEYS = ["Overall Accuracy", "Overall F1 Score"]
TIMING_KEYS = [
    "Loading training data", "Loading test data", "Data normalization", "Clustering",
    "Data balancing", "Feature processing", "SVM processing", "Hyperparameter tuning",
    "Training time", "Testing time", "Prediction time", "Total execution time",
]


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """lines(file, line_no, text) of the log_*.log files in a folder; a log is read line by line."""
    return register(spark).read.format("partwise_logs").load(path)


def write_logs(logs: DataFrame, path: str) -> None:
    """One file per row (file, text) in a new folder."""
    register(logs.sparkSession)
    logs.select("file", "text").write.format("partwise_logs").mode("append").save(path)


def _claimed(keys: list[str], timing: bool) -> Column:
    """(key, value) of a line: the first listed key it contains, the text after the last 'key:'."""
    found = F.lit(None)
    for key in reversed(keys):
        tail = F.regexp_replace(F.substring_index("text", key + ":", -1), r"^\s+|\s+$", "")
        value = F.split(tail, " ")[0] if timing else tail
        entry = F.struct(F.lit(key).alias("key"), F.when(F.col("text").contains(key + ":"), value).alias("value"))
        found = F.when(F.col("text").contains(key), entry).otherwise(found)
    return found


def summarise(lines: DataFrame) -> DataFrame:
    """Last matching line wins; dataset is the second part of the file name."""
    sections = F.array(_claimed(CONFIGURATION_KEYS, False), _claimed(RESULT_KEYS, False), _claimed(TIMING_KEYS, True))
    items = lines.select("file", "line_no", F.explode(F.filter(sections, lambda s: s.isNotNull())).alias("s"))
    known = items.filter(F.col("s.value").isNotNull()).select("file", "line_no", "s.key", "s.value")
    last = known.groupBy("file", "key").agg(F.max_by("value", "line_no").alias("value"))
    order = RESULT_KEYS + TIMING_KEYS + CONFIGURATION_KEYS
    wide = last.groupBy("file").pivot("key", order).agg(F.first("value"))
    every = lines.select("file").distinct().join(wide, "file", "left")
    return every.select(F.split("file", "_")[1].alias("Dataset"), *[F.col(k) for k in order], F.col("file").alias("Log File")).orderBy(
        F.col("Task type").asc_nulls_last(), "Log File")
