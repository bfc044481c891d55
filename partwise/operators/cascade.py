"""Two-level clustering: oversize clusters are split again, pairs get one flat label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.hashing import SEED
from .clusterers import ClusterMethod, KMeans, Placed, Placer, make_placer
from .entropy import entropy_select, feature_entropy, keep_subset
from .kselect import find_k
from .lloyd import Centres, assign, run_lloyd
from .rows import cells_of
from ..session import cut, small
from ..sources.profile import fit_sample

CLUSTER_CAP = 10_000


def cluster_sizes(labelled: DataFrame, column: str = "cluster") -> DataFrame:
    """Rows and share (percent) per label. Labels are few: the total is summed from the counts."""
    counts = labelled.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()))


def oversize(sizes: DataFrame, column: str = "cluster", cap: int = CLUSTER_CAP) -> DataFrame:
    """Clusters above the cap and the number of parts each is split into."""
    return sizes.filter(F.col("n") > cap).select(column, "n", F.ceil(F.col("n") / F.lit(cap)).cast("int").alias("k1"))


def flat_labels(pairs: DataFrame) -> DataFrame:
    """(level0, level1, cluster_id) of the pairs that occur, numbered in ascending order."""
    distinct = pairs.select("level0", "level1").distinct()
    counts = distinct.groupBy("level0").agg(F.count("*").alias("n"))
    before = counts.select("level0", (F.sum("n").over(W.orderBy("level0")) - F.col("n")).alias("before"))      # level-0 clusters only
    inner = F.row_number().over(W.partitionBy("level0").orderBy("level1"))
    return distinct.join(before, "level0").select("level0", "level1", (F.col("before") + inner - 1).cast("int").alias("cluster_id"))


def apply_flat_labels(pairs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Unmapped pairs get -1."""
    return pairs.join(mapping, ["level0", "level1"], "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))


class CascadeClusterer:
    """Level 0 by any clusterer (k fixed or searched), level 1 by k-means inside oversize clusters.

    The cap grows with the data at will: level-1 centres are n / cap in number.
    """

    def __init__(self, method: str | Placer = "kmeans", k: int | None = None, cascade: bool = True, entropy_ratio: float | None = None,
                 k_method: str = "silhouette", k_range: tuple[int, int] = (2, 100), cap: int = CLUSTER_CAP,
                 seed: int = SEED, n_init: int = 10, max_rounds: int = 300, scan_options: dict | None = None,
                 fit_ratio: float | None = None):
        self.own = None if isinstance(method, str) else method
        kind = ClusterMethod(method) if self.own is None else None
        if kind not in (None, ClusterMethod.KMEANS) and k_method != "silhouette":
            raise ValueError(f"method {k_method!r} needs kmeans")
        if kind not in (None, ClusterMethod.KMEANS) and k is None:
            raise ValueError(f"{method} needs a fixed k")
        self.method, self.k, self.cascade, self.entropy_ratio = kind, k, cascade, entropy_ratio
        self.k_method, self.k_range, self.cap, self.seed = k_method, k_range, cap, seed
        self.n_init, self.max_rounds, self.scan_options = n_init, max_rounds, scan_options or {}
        self.fit_ratio = fit_ratio
        self.level0: Placed | None = None
        self.level1: Centres | None = None
        self.mapping: DataFrame | None = None
        self.features: DataFrame | None = None
        self.k_scores: DataFrame | None = None

    def _view(self, samples: DataFrame) -> DataFrame:
        return samples if self.features is None else keep_subset(samples, self.features)

    def fit_predict(self, samples: DataFrame) -> DataFrame:
        """Samples plus level0, level1 and cluster_id. Call it on a persisted frame."""
        if self.entropy_ratio is not None:
            cells = cells_of(samples)
            n = samples.agg(F.count("*")).scalar()
            chosen = entropy_select(feature_entropy(cells, n, cells.agg(F.max("feature") + 1).scalar()), self.entropy_ratio)
            self.features = cut(chosen.select(F.col("feature").cast("int").alias("feature")))
        view = self._view(samples)
        k = self.k
        if k is None and self.own is None:
            scanned = view if self.fit_ratio is None else fit_sample(view, self.fit_ratio, seed=self.seed)
            k, self.k_scores = find_k(scanned, list(range(self.k_range[0], self.k_range[1] + 1)), self.k_method,
                                      self.seed, **self.scan_options)
        placer = self.own or (KMeans(k, self.seed, self.n_init, self.max_rounds, fit_ratio=self.fit_ratio)
                              if self.method is ClusterMethod.KMEANS else make_placer(self.method.value, k, self.seed))
        self.level0 = placer.place(view)
        if self.method is not ClusterMethod.KMEANS:
            labelled = samples.join(self.level0.train.select("row_id", F.col("cluster").alias("level0")), "row_id")
        else:
            labelled = self._level0_in_place(samples)
        sizes = cut(cluster_sizes(labelled, "level0"))
        if self.own is None and self.k is not None and (found := sizes.count()) != k:
            raise ValueError(f"asked for {k} clusters, {found} have rows")
        large = cut(oversize(sizes, "level0", self.cap).withColumn("fit_id", F.col("level0").cast("string")))
        pairs = sizes.select(F.col("level0").cast("int").alias("level0"))
        if self.cascade and not large.isEmpty():
            inside = labelled.join(small(large.select("level0")), "level0", "left_semi").select(
                F.col("level0").cast("string").alias("group"), "row_id", "idx", "val")
            width = int(samples.agg(F.max(F.array_max("idx"))).first()[0] or 0) + 1
            fits = large.select("fit_id", F.col("fit_id").alias("group"), F.col("k1").alias("k"))
            self.level1 = run_lloyd(inside, fits, width, self.n_init, self.max_rounds, seed=self.seed)
            parts = self.level1.table.filter("n > 0").select(F.col("group").cast("int").alias("level0"), F.col("centre").alias("level1"))
            pairs = pairs.join(parts, "level0", "left").select("level0", F.coalesce("level1", F.lit(-1)).alias("level1"))
        else:
            pairs = pairs.withColumn("level1", F.lit(-1))
        self.mapping = cut(flat_labels(pairs))
        return self._finish(labelled)

    def _level0_in_place(self, samples: DataFrame) -> DataFrame:
        view = samples if self.features is None else keep_subset(
            samples.withColumn("__i", F.col("idx")).withColumn("__v", F.col("val")), self.features)
        placed = self.level0.assign(view).withColumnRenamed("cluster", "level0")
        if self.features is None:
            return placed
        return placed.drop("idx", "val").withColumnRenamed("__i", "idx").withColumnRenamed("__v", "val")

    def _finish(self, labelled: DataFrame) -> DataFrame:
        if self.level1 is None:
            split = labelled.withColumn("level1", F.lit(-1))
        else:
            split = assign(labelled, self.level1, F.col("level0"), "level1")
        return apply_flat_labels(split, small(self.mapping))

    def predict(self, samples: DataFrame) -> DataFrame:
        """Every clusterer sees the features that it was fitted on; level 1 sees all."""
        if self.level0 is None:
            raise ValueError("fit the cascade before predicting")
        if self.method is ClusterMethod.KMEANS or self.features is None:
            return self._finish(self._level0_in_place(samples))
        placed = self.level0.assign(self._view(samples)).select("row_id", F.col("cluster").alias("level0"))
        return self._finish(samples.join(placed, "row_id"))
