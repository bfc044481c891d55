"""Feature entropy over uniform bins and the low/high entropy feature subset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import dense_index
from ..session import cut
from .rows import MAX_LOOKUP_BYTES

BINS = 20
SALTS = 16      # tasks at least over which the values of one feature are spread


def feature_entropy(cells: DataFrame, n_rows: Column, d: Column, bins: int = BINS) -> DataFrame:
    """(feature, entropy) for features 0..d-1; absent cells count as zeros.

    Equal values of a feature are counted first, so a feature that all rows have is no hot key unless its values
    differ; those are salted by their value when they meet the feature's range, and again when bins are counted.
    """
    values = cut(cells.groupBy("feature", "value").agg(F.count("*").alias("n")))
    span = values.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("n").alias("nnz"))
    sparse = F.col("nnz") < n_rows
    span = span.select("feature", "nnz",
                       F.when(sparse, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")).alias("lo"),
                       F.when(sparse, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")).alias("hi"))

    def bin_of(v: Column) -> Column:
        scaled = F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
        return F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.lit(bins - 1), scaled)).cast("int")

    salted = span.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = values.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(SALTS)).cast("int")).join(salted, ["feature", "salt"])
    filled = met.groupBy("feature", bin_of(F.col("value")).alias("bin")).agg(F.sum("n").alias("n"))
    zeros = span.filter(sparse).select("feature", bin_of(F.lit(0.0)).alias("bin"), (n_rows - F.col("nnz")).alias("n"))
    share = F.col("n") / n_rows
    counts = filled.unionByName(zeros).groupBy("feature", "bin").agg(F.sum("n").alias("n"))
    present = counts.groupBy("feature").agg((-F.sum(share * F.log2(share + 1e-9))).alias("entropy"))
    every = cells.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0), d - 1)).alias("feature"))
    empty = -F.log2(F.lit(1 + 1e-9))
    return every.join(present, "feature", "left").select("feature", F.coalesce("entropy", empty).alias("entropy"))


def entropy_select(entropy: DataFrame, ratio: float = 0.3, strategy: str = "bottom") -> DataFrame:
    """The ceil(d * ratio) features of lowest (bottom) or highest (top) entropy, in that order. Ranks come from
    ranges of the scores, so no task sorts more than about a million features."""
    if strategy not in ("bottom", "top"):
        raise ValueError(f"strategy must be bottom or top, not {strategy!r}")
    # A tenth decimal is beyond the noise of summing in a different order.
    score = F.round("entropy", 10)
    entropy = cut(entropy.withColumn("__k", F.struct((-score if strategy == "top" else score).alias("score"), "feature")))
    wanted = F.ceil(entropy.agg(F.count("*")).scalar() * F.lit(ratio))
    ranked = dense_index(entropy, "__k", "rank").withColumn("rank", F.col("rank") + 1)
    return ranked.filter(F.col("rank") <= wanted).select("feature", "entropy", "rank")


def continuous_features(cells: DataFrame, n_rows: Column, limit: float = 0.1) -> DataFrame:
    """Share of distinct values per feature, the implicit zero included."""
    stats = cells.groupBy("feature", "value").agg(F.count("*").alias("n")).groupBy("feature").agg(
        F.count("*").alias("distinct_values"), F.sum("n").alias("nnz"))
    distinct = F.col("distinct_values") + (F.col("nnz") < n_rows).cast("int")
    return stats.select("feature", (distinct / n_rows).alias("distinct_ratio"), (distinct / n_rows > limit).alias("continuous"))


def keep_subset(samples: DataFrame, features: DataFrame) -> DataFrame:
    """Cut sparse rows to a feature subset: in place by one array of flags (a byte per feature, broadcast up to
    MAX_LOOKUP_BYTES), or by a join on features where that would be too long."""
    top = features.agg(F.max("feature")).first()[0]
    if top is not None and top + 1 > MAX_LOOKUP_BYTES:
        entries = samples.select("row_id", F.explode(F.arrays_zip("idx", "val")).alias("e")).select("row_id", "e.*")
        kept = entries.join(features.select(F.col("feature").alias("idx")), "idx", "left_semi")
        packed = kept.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("idx", "val"))).alias("e"))
        rest = samples.drop("idx", "val").join(packed, "row_id", "left")
        none = F.array()
        return rest.select("*", F.coalesce("e.idx", none.cast("array<int>")).alias("idx"), F.coalesce("e.val", none.cast("array<double>")).alias("val")).drop("e")
    every = samples.sparkSession.range((top if top is not None else -1) + 1).select(F.col("id").alias("feature"))
    flags = every.join(features.select(F.col("feature").cast("bigint").alias("feature"), F.lit(True).alias("on")), "feature", "left")
    entry = F.struct("feature", F.coalesce("on", F.lit(False)).alias("on"))
    mask = flags.agg(F.sort_array(F.collect_list(entry))["on"].alias("__mask")).withColumn("__one", F.lit(0))
    met = samples.withColumn("__one", F.lit(0)).join(F.broadcast(mask), "__one")
    kept = met.withColumn("__c", F.filter(F.arrays_zip("idx", "val"), lambda c: F.coalesce(F.get("__mask", c["idx"]), F.lit(False))))
    return kept.withColumn("idx", F.col("__c.idx")).withColumn("val", F.col("__c.val")).select(*samples.columns)
