"""LIBSVM text source and sink."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import dense_index
from .textfiles import register


def _parsed(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, line, label, idx, val) as they stand in the files, by the library's own data source."""
    parts = [register(spark).read.format("partwise_libsvm").load(p).withColumn("path", F.lit(i)) for i, p in enumerate(paths)]
    return reduce(DataFrame.unionByName, parts)


def lowest_index(spark: SparkSession, *paths: str) -> int:
    """0 if any of the files uses index 0, else 1. Looked up over all files together."""
    return 0 if _parsed(spark, *paths).agg(F.min(F.array_min("idx"))).first()[0] == 0 else 1


def read_libsvm(spark: SparkSession, path: str, base: int | str = "auto", with_files: tuple[str, ...] = ()) -> DataFrame:
    """Samples of a LIBSVM file or folder.

    ``base`` is 0, 1 or "auto"; auto also looks at ``with_files`` so that the train and test
    part of one dataset agree. ``row_id`` follows the order of the files and lines.
    """
    shift = lowest_index(spark, path, *with_files) if base == "auto" else int(base)
    nonzero = F.filter(F.arrays_zip("idx", "val"), lambda e: e["val"] != 0)
    rows = dense_index(_parsed(spark, path).withColumn("at", F.struct("file", "line")), "at", "row_id")
    return rows.select("row_id", "label", nonzero.alias("c")).select(
        "row_id", "label",
        F.transform("c.idx", lambda i: i - shift).alias("idx"), F.col("c.val").alias("val"))


def write_libsvm(samples: DataFrame, path: str) -> None:
    """1-based LIBSVM text, one line per row, written by the executors into a new folder."""
    register(samples.sparkSession)
    samples.select("label", "idx", "val").write.format("partwise_libsvm").mode("append").save(path)
