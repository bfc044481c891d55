"""Dataset statistics and profile reports."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import sample_threshold, sort_key
from ..functions.hashing import SEED
from ..session import cut


def dataset_stats(samples: DataFrame, path: str) -> DataFrame:
    """Path, number of features (largest index + 1) and number of rows in one scan."""
    return samples.agg(F.coalesce(F.max(F.array_max("idx")) + 1, F.lit(0)).cast("bigint").alias("n_features"),
                       F.count("*").alias("n_samples")).select(F.lit(path).alias("filepath"), "*")


def profile(samples: DataFrame, name: str = "all") -> DataFrame:
    """Rows, features, mean row sparsity and one line per label."""
    # One pass over the rows; the totals come from the label table.
    by_label = cut(samples.groupBy("label").agg(
        F.count("*").alias("label_count"), F.max(F.array_max("idx")).alias("top"), F.sum(F.size("idx")).alias("nonzero")))
    n, top, nonzero = by_label.agg(F.sum("label_count"), F.max("top"), F.sum("nonzero")).first()
    d = (top if top is not None else -1) + 1
    sparsity = 1 - nonzero / n / d if n and d else None
    return by_label.select(
        F.lit(name).alias("dataset"), F.lit(n).cast("bigint").alias("n_samples"), F.lit(d).cast("bigint").alias("n_features"),
        F.lit(sparsity).cast("double").alias("avg_sparsity"), "label", "label_count")


def profile_bags(rows: DataFrame, entries: DataFrame, name: str = "all") -> DataFrame:
    """The same profile of bags of named features: ``rows`` (row_id, label) and ``entries`` (row_id, token), each
    token once per row. Tokens are only counted; no token gets a number."""
    entries = cut(entries.select("row_id", "token"))
    n_features = entries.select("token").distinct().count()
    sizes = entries.groupBy("row_id").agg(F.count("*").alias("nonzero"))
    by_label = cut(rows.join(sizes, "row_id", "left").groupBy("label").agg(F.count("*").alias("label_count"), F.coalesce(F.sum("nonzero"), F.lit(0)).alias("nonzero")))
    n, nonzero = by_label.agg(F.sum("label_count"), F.sum("nonzero")).first()
    sparsity = 1 - nonzero / n / n_features if n and n_features else None
    return by_label.select(
        F.lit(name).alias("dataset"), F.lit(n).cast("bigint").alias("n_samples"), F.lit(n_features).cast("bigint").alias("n_features"),
        F.lit(sparsity).cast("double").alias("avg_sparsity"), "label", "label_count")


def profile_by(samples: DataFrame) -> DataFrame:
    """Profiles of many datasets in one job, keyed by ``dataset``."""
    by_label = samples.groupBy("dataset", "label").agg(
        F.count("*").alias("label_count"),
        F.max(F.array_max("idx")).alias("top"),
        F.sum(F.size("idx")).alias("nonzero"))
    # Everything else follows from the label table, which map-side combining keeps small.
    total = by_label.groupBy("dataset").agg(
        F.sum("label_count").alias("n_samples"),
        (F.max("top") + 1).cast("bigint").alias("n_features"),
        F.sum("nonzero").alias("nonzero"))
    total = total.withColumn("avg_sparsity", 1 - F.col("nonzero") / F.col("n_samples") / F.col("n_features"))
    return by_label.select("dataset", "label", "label_count").join(total, "dataset").select(
        "dataset", "n_samples", "n_features", "avg_sparsity", "label", "label_count")


def profile_report(datasets: dict[str, DataFrame]) -> DataFrame:
    """One profile block per named dataset. One that cannot be planned is a row with its ``error`` and nothing else."""
    tagged, failed = [], []
    for name, samples in datasets.items():
        try:
            tagged.append(samples.select(F.lit(name).alias("dataset"), "label", "idx"))
        except AnalysisException as error:      # unreadable source: report the others
            failed.append((name, str(error)))
    if not tagged:
        raise ValueError(f"no readable dataset: {failed}")
    report = profile_by(reduce(DataFrame.unionByName, tagged)).withColumn("error", F.lit(None).cast("string"))
    if failed:
        report = report.unionByName(report.sparkSession.createDataFrame(failed, "dataset string, error string"), allowMissingColumns=True)
    return report


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").csv(path, header=True)


def with_test_flag(samples: DataFrame, share: float = 0.2, seed: int = SEED) -> DataFrame:
    """Mark exactly ceil(share * n) rows as test rows, in hash order."""
    size = samples.agg(F.ceil(F.lit(share) * F.count("*"))).first()[0]
    limit = sample_threshold(samples, ["row_id"], size, seed)
    return samples.withColumn("is_test", sort_key(["row_id"], seed) <= limit)


def split(samples: DataFrame, share: float = 0.2, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    flagged = with_test_flag(samples, share, seed)
    return flagged.filter(~F.col("is_test")).drop("is_test"), flagged.filter("is_test").drop("is_test")


def fit_sample(samples: DataFrame, ratio: float = 0.1, threshold: int = 10_000, seed: int = SEED) -> DataFrame:
    """All rows up to the threshold, otherwise exactly int(n * ratio) rows in hash order."""
    n = samples.count()
    if n <= threshold:
        return samples
    limit = sample_threshold(samples, ["row_id"], int(n * ratio), seed)
    return samples.filter(sort_key(["row_id"], seed) <= limit)
