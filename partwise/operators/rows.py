"""Row and column shaping: conversions, shared feature space, feature filters, row norms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import small

MAX_LOOKUP_BYTES = 64 << 20


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed one time per row, not once per array element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cells_of(samples: DataFrame, *keep: str) -> DataFrame:
    """Explode sparse rows to (keep..., feature, value); row-local, no shuffle."""
    keep = keep or ("row_id",)
    zipped = F.arrays_zip(F.col("idx"), F.col("val"))
    return samples.select(*keep, F.explode(zipped).alias("c")).select(
        *keep, F.col("c.idx").alias("feature"), F.col("c.val").alias("value"))


def pack(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Collect cells back to sparse rows; a row is bounded by the number of features."""
    entry = F.struct(F.col("feature").cast("int").alias("i"), F.col("value").alias("v"))
    packed = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("c"))
    return packed.select(*keys, F.col("c.i").alias("idx"), F.col("c.v").alias("val"))


def width(cells: DataFrame) -> Column:
    """Number of features = largest index + 1, as a scalar subquery."""
    return cells.agg(F.max("feature") + 1).scalar()


def shared_features(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cut both cell sets to the feature prefix they share."""
    limit = F.least(width(train), width(test))
    return train.filter(F.col("feature") < limit), test.filter(F.col("feature") < limit)


def frequent_features(cells: DataFrame, n_rows: Column, max_zero_share: float = 0.98) -> DataFrame:
    """Features whose share of zeros is below the limit, renumbered in ascending order.

    Every kept feature is non-zero in more than 2 % of the rows, so at most 50 times the mean
    row length survive: the table stays small enough for one window and a broadcast.
    """
    counts = cells.groupBy("feature").agg(F.count("*").alias("nonzero"))
    kept = counts.filter(1 - F.col("nonzero") / n_rows < max_zero_share)
    return kept.select("feature", "nonzero", (F.row_number().over(W.orderBy("feature")) - 1).alias("new_feature"))


def keep_features(cells: DataFrame, kept: DataFrame) -> DataFrame:
    """Replay a (feature, new_feature) list on any cell set."""
    names = kept.select("feature", "new_feature")
    return cells.join(names, "feature").drop("feature").withColumnRenamed("new_feature", "feature")


def cluster_frequent_features(cells: DataFrame, sizes: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Per cluster, features whose non-zero share reaches the threshold; empty clusters vanish."""
    counts = cells.groupBy("cluster_id", "feature").agg(F.count("*").alias("nonzero"))
    joined = counts.join(sizes.select("cluster_id", F.col("n").alias("n")), "cluster_id")
    return joined.filter(F.col("nonzero") / F.col("n") >= threshold).select(
        "cluster_id", "feature", "nonzero", (F.col("nonzero") / F.col("n")).alias("nonzero_ratio"))


def row_norm(val: Column, norm: str) -> Column:
    if norm == "l2":
        return F.sqrt(F.aggregate(val, F.lit(0.0), lambda a, v: a + v * v))
    if norm == "l1":
        return F.aggregate(val, F.lit(0.0), lambda a, v: a + F.abs(v))
    if norm == "max":
        return F.aggregate(val, F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v)))
    raise ValueError(f"norm must be l1, l2 or max, not {norm!r}")


def normalize(samples: DataFrame, norm: str = "l2") -> DataFrame:
    """Divide every row by its norm; an all-zero row stays as it is. Row-local, no shuffle."""
    size = row_norm(F.col("val"), norm)
    divisor = F.when(size == 0, 1.0).otherwise(size)
    return samples.withColumn("val", once(divisor, lambda s: F.transform("val", lambda v: v / s)))


def project_selected(cells: DataFrame, selection: DataFrame) -> DataFrame:
    """Replay a per-cluster column choice.

    ``selection``: cluster_id, in_feature, out_feature. Rows of a cluster without any choice
    pass through unchanged.
    """
    known = small(selection.select("cluster_id").distinct().withColumn("known", F.lit(True)))     # a shuffle would put a cluster in one task
    chosen = selection.select("cluster_id", F.col("in_feature").alias("feature"), "out_feature")
    joined = cells.join(chosen, ["cluster_id", "feature"], "left").join(known, "cluster_id", "left")
    kept = joined.filter(F.col("out_feature").isNotNull() | F.col("known").isNull())
    return kept.withColumn("feature", F.coalesce("out_feature", "feature")).drop("out_feature", "known")


def selection_map(selection: DataFrame) -> DataFrame:
    """(cluster_id, out_of ARRAY<INT>): new column per old column, NULL where it was not chosen."""
    top = selection.groupBy("cluster_id").agg(F.max("in_feature").alias("top"))
    every = top.select("cluster_id", F.explode(F.sequence(F.lit(0), F.col("top").cast("int"))).alias("in_feature"))
    filled = every.join(selection.select("cluster_id", F.col("in_feature").cast("int").alias("in_feature"), "out_feature"),
                        ["cluster_id", "in_feature"], "left")
    return filled.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct(
        "in_feature", F.col("out_feature").cast("int").alias("o"))))["o"].alias("out_of"))


def apply_selection(rows: DataFrame, maps: DataFrame) -> DataFrame:
    """Replay a per-cluster column choice on sparse rows in place; unknown clusters pass through.

    ``maps`` comes from ``small(selection_map(...))``.
    """
    met = rows.join(maps, "cluster_id", "left")
    moved = F.transform(F.arrays_zip("idx", "val"), lambda c: F.struct(F.get("out_of", c["idx"]).alias("i"), c["val"].alias("v")))
    kept = met.withColumn("__c", F.when(F.col("out_of").isNotNull(), F.filter(moved, lambda c: c["i"].isNotNull())))
    return kept.withColumn("idx", F.coalesce("__c.i", "idx")).withColumn("val", F.coalesce("__c.v", "val")).drop("__c", "out_of")


def remap(samples: DataFrame, lookup: np.ndarray) -> DataFrame:
    """New column number per old one (-1 = drop), applied to sparse rows in place.

    ``lookup`` has one INT per feature and travels with the task; it must keep the order.
    """
    if lookup.nbytes > MAX_LOOKUP_BYTES:
        raise ValueError("too many features for a lookup; use keep_features on cells")

    def run(batches):
        for pdf in batches:
            idx = pdf["idx"].to_list()
            lengths = np.array([len(i) for i in idx], dtype=np.int64)
            old = np.concatenate(idx).astype(np.int64) if lengths.sum() else np.empty(0, dtype=np.int64)
            values = np.concatenate(pdf["val"].to_list()) if lengths.sum() else np.empty(0)
            new = np.where(old < len(lookup), lookup[np.minimum(old, len(lookup) - 1)], -1)
            keep = new >= 0
            kept_per_row = np.bincount(np.repeat(np.arange(len(idx)), lengths)[keep], minlength=len(idx))
            ends = np.cumsum(kept_per_row)[:-1]
            yield pdf.assign(idx=np.split(new[keep].astype(np.int32), ends), val=np.split(values[keep], ends))

    return samples.mapInPandas(run, samples.schema)


def renumber(samples: DataFrame, kept: DataFrame) -> DataFrame:
    """Apply a (feature, new_feature) list to sparse rows; beyond the lookup limit through a join."""
    top = kept.agg(F.max("feature")).first()[0]
    if top is not None and 4 * (int(top) + 1) > MAX_LOOKUP_BYTES:
        packed = pack(keep_features(cells_of(samples), kept), ["row_id"])
        others = [c for c in samples.columns if c not in ("idx", "val")]
        return samples.select(*others).join(packed, "row_id", "left").withColumn(
            "idx", F.coalesce("idx", F.array().cast("array<int>"))).withColumn("val", F.coalesce("val", F.array().cast("array<double>")))
    rows = kept.select("feature", "new_feature").toPandas()
    lookup = np.full(int(top) + 1 if top is not None else 1, -1, dtype=np.int32)
    lookup[rows["feature"].to_numpy(dtype=np.int64)] = rows["new_feature"]
    return remap(samples, lookup)
