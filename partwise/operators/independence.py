"""Independence score of a feature and a cluster from non-zero counts.

Only cells that occur are stored. A feature that never occurs in a cluster has a score that depends
on the feature's total and the cluster's size alone, so these scores are kept per distinct total;
their rows are written out on demand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.ranking import bucket_rank
from ..session import cut, small

RUN = 65_536        # features that one task numbers


def score_of(nonzero: Column, total: Column, n: Column, rows: Column, smooth: float) -> Column:
    """Of one cell count against its feature's total and its cluster's size. "Outside" is the total minus the cluster's own."""
    o = F.lit(float(smooth))
    a, b = nonzero.cast("double"), (total - nonzero).cast("double")
    c, e = (n - nonzero).cast("double"), (rows - n - total + nonzero).cast("double")
    top = F.pow((a + o) * (e + o) - (b + o) * (c + o), 2)
    bottom = (a + b + o) * (a + c + o) * (c + b + o) * (c + e + o)
    return F.when(bottom == 0, 0.0).otherwise(top / bottom)


class Independence:
    """Scores of ``cells`` (cluster_id, feature, ...) for features 0..d-1 and clusters ``sizes`` (cluster_id, n)."""

    def __init__(self, cells: DataFrame, sizes: DataFrame, d: int, smooth: float = 1.0):
        self.d, self.smooth = int(d), smooth
        self.sizes = small(sizes.select("cluster_id", "n"))
        self.rows = F.lit(self.sizes.agg(F.sum("n")).first()[0] or 0)
        self.nonzero = cut(cells.groupBy("cluster_id", "feature").agg(F.count("*").alias("nonzero")))
        self.totals = self.nonzero.groupBy("feature").agg(F.sum("nonzero").alias("total"))

    def _scored(self, table: DataFrame) -> DataFrame:
        return table.withColumn("score", score_of(F.col("nonzero"), F.col("total"), F.col("n"), self.rows, self.smooth))

    def held(self) -> DataFrame:
        """(cluster_id, feature, nonzero, total, n, score) of the cells that occur."""
        return self._scored(self.nonzero.join(self.totals, "feature").join(self.sizes, "cluster_id"))

    def every_feature(self) -> DataFrame:
        """(feature, total) of all d features."""
        every = self.nonzero.sparkSession.range(self.d).select(F.col("id").cast(self.nonzero.schema["feature"].dataType).alias("feature"))
        return every.join(self.totals, "feature", "left").withColumn("total", F.coalesce("total", F.lit(0)))

    def absent_scores(self) -> DataFrame:
        """(cluster_id, total, score): what a feature with this total scores in a cluster where it never occurs."""
        levels = self.every_feature().select("total").distinct()
        clusters = self.sizes.agg(F.collect_list(F.struct("cluster_id", "n"))).scalar()
        each = levels.select("total", F.explode(clusters).alias("s")).select("s.*", "total", F.lit(0).alias("nonzero"))
        return self._scored(each).select("cluster_id", "total", "score")

    def counts(self) -> DataFrame:
        """(cluster_id, feature, nonzero, total, n) written out for every cluster and feature."""
        clusters = self.sizes.agg(F.collect_list("cluster_id")).scalar()
        holders = self.nonzero.groupBy("feature").agg(F.collect_list("cluster_id").alias("held"))
        none = F.array().cast(f"array<{self.nonzero.schema['cluster_id'].dataType.simpleString()}>")
        absent = self.every_feature().join(holders, "feature", "left").select(
            F.explode(F.array_except(clusters, F.coalesce("held", none))).alias("cluster_id"), "feature", F.lit(0).cast("bigint").alias("nonzero"), "total")
        present = self.nonzero.join(self.totals, "feature").select("cluster_id", "feature", "nonzero", "total")
        return present.unionByName(absent).join(self.sizes, "cluster_id")

    def scores(self) -> DataFrame:
        """The score of every cluster and feature, written out."""
        return self._scored(self.counts()).select("cluster_id", "feature", "score")

    def hits(self, threshold: float) -> DataFrame:
        """(cluster_id, feature) with a score at or above the threshold. Features that do not occur in a cluster
        are looked up by their total, and only where that total reaches the threshold."""
        present = self.held().filter(F.col("score") >= threshold).select("cluster_id", "feature")
        reached = small(self.absent_scores().filter(F.col("score") >= threshold).select("cluster_id", "total"))
        absent = self.every_feature().join(reached, "total").select("cluster_id", "feature")
        return present.unionByName(absent.join(self.nonzero, ["cluster_id", "feature"], "left_anti"))

    def selection(self, threshold: float = 1e-4) -> DataFrame:
        """(cluster_id, in_feature, out_feature); a cluster without a hit keeps all its features, which needs no rows here."""
        return as_selection(numbered(self.hits(threshold)))

    def select(self, threshold: float = 1e-4) -> DataFrame:
        """Every cluster and feature with ``score``, ``selected`` and the new number of selected features, written out."""
        scores = self.scores().withColumn("hit", F.col("score") >= threshold)
        some = small(self.hits(threshold).select("cluster_id").distinct().withColumn("some", F.lit(True)))
        flagged = cut(scores.join(some, "cluster_id", "left").withColumn("selected", F.col("hit") | F.col("some").isNull()).drop("hit", "some"))
        return flagged.join(numbered(flagged.filter("selected").select("cluster_id", "feature")).drop("selected"), ["cluster_id", "feature"], "left")


def numbered(chosen: DataFrame) -> DataFrame:
    """(cluster_id, feature) with ``selected`` and ``out_feature``, counted up in each cluster; no task sorts more than RUN."""
    ranked = bucket_rank(chosen.withColumn("__b", F.floor(F.col("feature") / RUN)), ["cluster_id"], "__b", [F.col("feature")], "__r")
    return ranked.select("cluster_id", "feature", F.lit(True).alias("selected"), (F.col("__r") - 1).cast("int").alias("out_feature"))


def independence_select(scores: DataFrame, threshold: float = 1e-4) -> DataFrame:
    """The same choice for any table of scores with a row per cluster and feature."""
    cluster = W.partitionBy("cluster_id")
    hit = scores.withColumn("hit", F.col("score") >= threshold)
    chosen = hit.withColumn("selected", F.col("hit") | ~F.max("hit").over(cluster)).drop("hit")
    number = F.sum(F.col("selected").cast("int")).over(cluster.orderBy("feature").rowsBetween(W.unboundedPreceding, 0)) - 1
    return chosen.withColumn("out_feature", F.when(F.col("selected"), number.cast("int")))


def as_selection(chosen: DataFrame) -> DataFrame:
    """The (cluster_id, in_feature, out_feature) table replayed on test rows."""
    return chosen.filter("selected").select("cluster_id", F.col("feature").alias("in_feature"), "out_feature")
