"""Feature construction per cluster: standardise, quantile one-hot, pair products and ratios.

Columns are positions 0..d-1 inside a cluster. The fitted state is one row of arrays per
cluster; applying it is a join on cluster_id followed by row-local expressions, so neither
fitting nor replay moves more than the statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.ranking import cumulative_weight
from ..session import cut, small
from .rows import once

N_BINS = 5
PAIR_LEFT, PAIR_RIGHT = 5, 6     # first features that enter pair products and ratios


def shapes(rows: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """(cluster_id, n, d) of packed rows; ``columns`` (cluster_id, d) overrides the width."""
    seen = rows.groupBy("cluster_id").agg(F.count("*").alias("n"), (F.max(F.array_max("idx")) + 1).alias("d"))
    if columns is None:
        return seen
    return seen.drop("d").join(columns, "cluster_id")


def column_stats(cells: DataFrame, shape: DataFrame) -> DataFrame:
    """Mean, population std and range per (cluster, feature), implicit zeros included."""
    part = cells.groupBy("cluster_id", "feature").agg(
        F.count("*").alias("nnz"), F.avg("value").alias("m"), F.var_pop("value").alias("v"),
        F.min("value").alias("lo"), F.max("value").alias("hi"))
    grid = shape.select("cluster_id", "n", "d", F.explode(F.sequence(F.lit(0), F.col("d") - 1)).alias("feature"))
    full = grid.join(part, ["cluster_id", "feature"], "left").fillna({"nnz": 0, "m": 0.0, "v": 0.0})
    zeros = F.col("n") - F.col("nnz")
    square = F.col("v") * F.col("nnz") + F.col("m") * F.col("m") * F.col("nnz") * zeros / F.col("n")
    low = F.when(zeros > 0, F.least(F.coalesce("lo", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("lo"))
    high = F.when(zeros > 0, F.greatest(F.coalesce("hi", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("hi"))
    return full.select(
        "cluster_id", "feature", "n", "d", "nnz",
        (F.col("m") * F.col("nnz") / F.col("n")).alias("mean"),
        F.sqrt(square / F.col("n")).alias("std"), (high - low).alias("range"))


def range_rank(stats: DataFrame, ratio: float = 0.1) -> DataFrame:
    """The ceil(d * ratio) features of widest range per cluster, widest first."""
    order = W.partitionBy("cluster_id").orderBy(F.col("range").desc(), "feature")
    return stats.withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= F.ceil(F.col("d") * F.lit(ratio))).select("cluster_id", "feature", "n", "range", "rank")


def quantile_edges(cells: DataFrame, top: DataFrame, n_bins: int = N_BINS, per_bucket: int = 1_000_000) -> DataFrame:
    """(cluster_id, feature, edges) at linearly interpolated quantiles 0, 1/b, ..., 1.

    Exact at any size: equal values are counted first, then only the values standing at a
    wanted position are kept. No group is sorted or collected whole.
    """
    wanted = top.select("cluster_id", "feature", "n")
    inside = cells.join(wanted, ["cluster_id", "feature"])
    weights = inside.groupBy("cluster_id", "feature", "value").agg(F.count("*").alias("w"))
    filled = inside.groupBy("cluster_id", "feature").agg(F.count("*").alias("nnz"))
    zeros = wanted.join(filled, ["cluster_id", "feature"], "left").withColumn(
        "w", F.col("n") - F.coalesce("nnz", F.lit(0))).filter("w > 0").select(
        "cluster_id", "feature", F.lit(0.0).alias("value"), "w")
    groups = ["cluster_id", "feature"]
    placed = cumulative_weight(weights.unionByName(zeros), groups, "value", "w", "below", "total", per_bucket)
    last = F.col("total") - 1
    marks = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(side).alias("side"),
                               (F.floor(last * q / n_bins) if side == 0 else F.ceil(last * q / n_bins)).alias("p"))
                      for q in range(n_bins + 1) for side in (0, 1)])
    hits = F.filter(marks, lambda m: (m["p"] >= F.col("below")) & (m["p"] < F.col("below") + F.col("w")))
    found = placed.select(*groups, "value", "total", F.explode(hits).alias("m"))
    per_edge = found.groupBy(*groups, "m.q").agg(
        F.max(F.when(F.col("m.side") == 0, F.col("value"))).alias("low"),
        F.max(F.when(F.col("m.side") == 1, F.col("value"))).alias("high"),
        F.max("total").alias("total"))
    at = (F.col("total") - 1) * F.col("q") / n_bins
    edge = F.col("low") + (F.col("high") - F.col("low")) * (at - F.floor(at))
    listed = per_edge.groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct("q", edge.alias("e"))))["e"].alias("raw"))
    distinct = F.filter(F.transform("raw", lambda e, i: F.when(
        (i == 0) | (e - F.get("raw", i - 1) > 1e-8), e)), lambda e: e.isNotNull())
    return listed.select(*groups, distinct.alias("edges"))


def fit_construction(cells: DataFrame, shape: DataFrame, ratio: float = 0.1, n_bins: int = N_BINS,
                     per_bucket: int = 1_000_000) -> DataFrame:
    """State per cluster: d, mean[], std[], and for binned features feature, inner edges, first column."""
    stats = cut(column_stats(cells, shape))
    moments = stats.groupBy("cluster_id", "n", "d").agg(
        F.sort_array(F.collect_list(F.struct("feature", "mean", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")).alias("std")))).alias("s"))
    top = small(range_rank(stats, ratio))
    edges = top.join(quantile_edges(cells, top, n_bins, per_bucket), ["cluster_id", "feature"])
    inner = F.when(F.size("edges") > 2, F.slice("edges", 2, F.size("edges") - 2)).otherwise(F.array().cast("array<double>"))
    binned = edges.select("cluster_id", F.struct("rank", "feature", inner.alias("inner")).alias("b"))
    bins = binned.groupBy("cluster_id").agg(F.sort_array(F.collect_list("b")).alias("bins"))
    return moments.join(bins, "cluster_id").select(
        "cluster_id", "d", F.col("s.mean").alias("mean"), F.col("s.std").alias("std"), "bins")


def _dense(d: Column) -> Column:
    """Dense copy of a sparse row; rows without zeros are taken as they are."""
    lookup = F.transform(F.sequence(F.lit(0), d - 1), lambda j: F.coalesce(
        F.get("val", F.array_position("idx", j).cast("int") - 1), F.lit(0.0)))
    return F.when(F.size("idx") == d, F.col("val")).otherwise(lookup)


def standardise(x: str = "x") -> Column:
    return F.transform(x, lambda v, i: (v - F.get("mean", i)) / F.get("std", i))


def one_hot(x: str = "x") -> Column:
    """One column per quantile bin; a bin holds values from its lower edge up, the last is closed."""
    def block(b):
        place = F.size(F.filter(b["inner"], lambda e: e <= F.get(x, b["feature"])))
        return once(place, lambda p: F.transform(F.sequence(F.lit(0), F.size(b["inner"])), lambda j: (j == p).cast("double")))

    return F.flatten(F.transform("bins", block))


def pair_columns(x: str = "x", d: str = "d") -> Column:
    """Product and safe ratio for each pair of leading features, in pair order."""
    found = []
    for i in range(PAIR_LEFT):
        for j in range(i + 1, PAIR_RIGHT):
            a, b = F.get(x, F.lit(i)), F.get(x, F.lit(j))
            ratio = F.when(b != 0, a / b).otherwise(0.0)
            found.append(F.when(F.lit(j) < F.col(d), F.array(a * b, F.when(F.isnan(ratio), 0.0).otherwise(ratio))))
    return F.flatten(F.filter(F.array(*found), lambda p: p.isNotNull()))


def construct(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows with [original | scaled | one-hot | pairs]; clusters without state pass through.

    ``rows``: cluster_id, ..., idx, val.
    """
    joined = rows.join(state, "cluster_id", "left").withColumn("x", F.when(F.col("d").isNotNull(), _dense(F.col("d"))))
    wide = joined.withColumn("__all", F.concat("x", standardise(), one_hot(), pair_columns()))
    kept = F.filter(F.transform("__all", lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda c: c["v"] != 0)
    full = wide.withColumn("__c", kept)
    return full.withColumn("idx", F.coalesce("__c.i", "idx")).withColumn("val", F.coalesce("__c.v", "val")).drop(
        "__c", "__all", "x", "d", "mean", "std", "bins")


def constructed_width(state: DataFrame) -> DataFrame:
    """(cluster_id, d) after construction."""
    bins = F.aggregate("bins", F.lit(0), lambda a, b: a + F.size(b["inner"]) + 1)
    pairs = sum(F.when(F.lit(j) < F.col("d"), 1).otherwise(0)
                for i in range(PAIR_LEFT) for j in range(i + 1, PAIR_RIGHT))
    return state.select("cluster_id", (2 * F.col("d") + bins + 2 * pairs).cast("int").alias("d"))
