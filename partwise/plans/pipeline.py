"""The whole run: align, filter, normalise, cluster, repair, build features, tune, train, route, score."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import SEED
from ..operators import construct as ct
from ..operators import evaluate as ev
from ..operators import independence as ind
from ..operators import mutual as mi
from ..operators import rows as rw
from ..operators import svm, tuning, wrapper
from ..operators.balance import balance
from ..operators.cascade import CLUSTER_CAP, CascadeClusterer
from ..session import cut, small


@dataclass
class Config:
    task: str
    clustering: bool = False
    method: object = "kmeans"
    k: int | None = None
    k_method: str = "silhouette"
    k_range: tuple[int, int] = (2, 100)
    cascade: bool = False
    cap: int = CLUSTER_CAP
    entropy_ratio: float | None = None
    balance: bool = False
    min_class_ratio: float = 0.1
    max_balance_samples: int = 100
    nonzero_ratio: float | None = None
    independence: bool = False
    independence_threshold: float = 1e-4
    independence_smooth: float = 1.0
    construction: bool = False
    discretize_ratio: float = 0.1
    mutual_info: bool = False
    mutual_percent: float = 50
    min_features: int = 5
    wrapper: wrapper.SwarmOptions | None = None
    tune: bool = False
    optimizer: str = "random"
    n_iter: int = 10
    cv_folds: int = 5
    defaults: dict = field(default_factory=dict)      # overrides of the untuned parameters
    max_zero_share: float = 0.98
    n_init: int = 10
    max_rounds: int = 300
    fit_ratio: float | None = None      # share of a large table that centres and k are fitted on; None: all rows
    landmarks: int = svm.LANDMARKS
    kernel_residual: float | None = None      # grow landmarks until the kernel misses no more than this share
    scan_options: dict = field(default_factory=dict)
    seed: int = SEED

    def __post_init__(self):
        if self.task not in ("clf", "reg"):
            raise ValueError(f"task must be clf or reg, not {self.task!r}")
        if self.method != "kmeans" and self.k_method != "silhouette":
            raise ValueError(f"k method {self.k_method!r} needs kmeans")
        if self.clustering and isinstance(self.method, str) and self.method != "kmeans" and self.k is None:
            raise ValueError(f"{self.method} needs a fixed k")
        if self.optimizer not in tuning.OPTIMIZERS:
            raise ValueError(f"optimizer must be one of {tuning.OPTIMIZERS}")


@dataclass
class Result:
    predictions: DataFrame
    metrics: DataFrame
    report: DataFrame
    models: DataFrame
    params: DataFrame
    run_info: DataFrame
    tables: dict[str, DataFrame]


class Pipeline:
    """``fit`` on train samples, ``predict`` on test samples, ``run`` for both plus metrics."""

    def __init__(self, config: Config):
        self.config = config
        self.seconds: dict[str, float] = {}
        self.tables: dict[str, DataFrame] = {}
        self._replay: list = []

    def _timed(self, name: str, start: float) -> None:
        self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - start

    def fit(self, train: DataFrame, test: DataFrame | None = None) -> "Pipeline":
        """``test`` only limits the feature space to the columns both parts have."""
        c, spark = self.config, train.sparkSession
        start = time.perf_counter()
        cells = rw.cells_of(train)
        if test is not None:
            cells = cells.filter(F.col("feature") < F.least(rw.width(cells), rw.width(rw.cells_of(test))))
        self.kept = cut(rw.frequent_features(cells, train.agg(F.count("*")).scalar(), c.max_zero_share))
        rows = rw.normalize(rw.renumber(train, self.kept), "l2").persist(StorageLevel.MEMORY_AND_DISK)
        self._timed("Data normalization", start)

        start = time.perf_counter()
        if c.clustering:
            self.clusterer = CascadeClusterer(c.method, c.k, c.cascade, c.entropy_ratio, c.k_method, c.k_range, c.cap,
                                              c.seed, c.n_init, c.max_rounds, c.scan_options, c.fit_ratio)
            placed = self.clusterer.fit_predict(rows).drop("level0", "level1")
            if self.clusterer.k_scores is not None:
                self.tables["k_scores"] = self.clusterer.k_scores
        else:
            self.clusterer = None
            placed = rows.withColumn("cluster_id", F.lit(0))
        placed = cut(placed.select("cluster_id", "row_id", "label", "idx", "val"))
        rows.unpersist()
        self._timed("Clustering", start)

        start = time.perf_counter()
        work = placed.withColumn("copy", F.lit(0))
        if c.balance and c.clustering and c.task == "clf" and c.method == "kmeans":
            members = placed.select("cluster_id", "row_id", "label")
            full = balance(members, placed.select("row_id", "label"), c.min_class_ratio, c.max_balance_samples, c.seed)
            added = full.filter("copy > 0").join(placed.select("row_id", "idx", "val"), "row_id")
            work = cut(work.unionByName(added.select(*work.columns)))
        self._timed("Data balancing", start)

        start = time.perf_counter()
        columns = work.select("cluster_id").distinct().withColumn("d", F.lit(max(1, self.kept.count())))
        work, columns = self._fit_features(work, columns)
        self._timed("Feature processing", start)
        return self._fit_models(work, columns, spark)

    def _select(self, work: DataFrame, selection: DataFrame, columns: DataFrame, drop: bool = False):
        """Record a fitted column choice and apply it. A cluster without any choice keeps its columns, or goes if ``drop``."""
        maps = small(rw.selection_map(selection))
        self._replay.append(lambda rows: rw.apply_selection(rows, maps))
        own = selection.groupBy("cluster_id").agg(F.count("*").cast("int").alias("own"))
        widths = columns.join(own, "cluster_id", "inner" if drop else "left").select("cluster_id", F.coalesce("own", "d").alias("d"))
        return rw.apply_selection(work, maps), cut(widths)

    def _fit_features(self, work: DataFrame, columns: DataFrame):
        c = self.config
        cells = lambda: rw.cells_of(work, "cluster_id", "row_id")
        if c.nonzero_ratio is not None:
            sizes = work.groupBy("cluster_id").agg(F.count("*").alias("n"))
            found = rw.cluster_frequent_features(cells(), sizes, c.nonzero_ratio)
            ranked = ind.numbered(found.select("cluster_id", "feature"))
            before = columns
            work, columns = self._select(work, ind.as_selection(ranked), columns, drop=True)
            work = work.join(columns.select("cluster_id"), "cluster_id", "left_semi")
            self.tables["dropped_clusters"] = before.join(columns, "cluster_id", "left_anti").select("cluster_id")
        if c.independence:
            sizes = work.groupBy("cluster_id").agg(F.count("*").alias("n"))
            scores = ind.Independence(cells(), sizes, columns.agg(F.max("d")).first()[0], c.independence_smooth)
            self.tables["independence_scores"] = scores.held()
            work, columns = self._select(work, cut(scores.selection(c.independence_threshold)), columns)
        if c.construction:
            state = small(ct.fit_construction(cells(), ct.shapes(work, columns), c.discretize_ratio))
            self._replay.append(lambda rows: ct.construct(rows, state))
            work, columns = ct.construct(work, state), cut(ct.constructed_width(state))
        if c.mutual_info:
            work = cut(work)
            target = work if c.task == "clf" else mi.quantile_label(work)
            scores = mi.mutual_information(target, columns, c.seed)
            chosen = cut(mi.select_features(scores, c.mutual_percent, c.min_features))
            self.tables["feature_stats"] = chosen
            work, columns = self._select(work, ind.as_selection(chosen), columns)
        if c.wrapper is not None:
            job = svm.SvmJob(svm.assign_folds(work, c.cv_folds, c.task, c.seed), c.task, c.landmarks)
            best = wrapper.select_features(job, columns, c.wrapper, c.seed)
            self.tables["wrapper_masks"] = best
            work, columns = self._select(work, wrapper.as_selection(best), columns)
            job.release()
        return work, columns

    def _fit_models(self, work: DataFrame, columns: DataFrame, spark) -> "Pipeline":
        c = self.config
        if c.tune:
            work = svm.assign_folds(work, c.cv_folds, c.task, c.seed)
        self.job = svm.SvmJob(work, c.task, c.landmarks, seed=c.seed)
        clusters = columns.select("cluster_id")
        start = time.perf_counter()
        tuned = None
        if c.tune:
            trials, tuned = tuning.tune(self.job, clusters, c.optimizer, c.n_iter, c.seed)
            self.tables["trials"] = trials
            self._timed("Hyperparameter tuning", start)
        params = svm.params_by_cluster(clusters, tuned)
        for name, value in c.defaults.items():
            if tuned is None:
                params = params.withColumn(name, F.lit(value))
        self.params = cut(params)
        start = time.perf_counter()
        if c.kernel_residual is not None:
            self.job.grow(self.params, c.kernel_residual)
        self.models = cut(self.job.train(self.params))
        self.shape = cut(svm.train_shape(self.job.blocks))
        self.marks = cut(self.job.marks)
        self.job.release()
        self._timed("Training time", start)
        return self

    def assign(self, test: DataFrame) -> DataFrame:
        """Test rows with their cluster and the fitted feature steps replayed."""
        rows = rw.normalize(rw.renumber(test, self.kept), "l2")
        placed = self.clusterer.predict(rows) if self.clusterer else rows.withColumn("cluster_id", F.lit(0))
        for step in self._replay:
            placed = step(placed)
        return placed.select("cluster_id", "row_id", "label", "idx", "val")

    def predict(self, test: DataFrame) -> DataFrame:
        routed = cut(self.assign(test))
        return svm.predict(routed, self.models, self.params, self.shape, self.config.task, self.marks).drop("trial")

    def run(self, train: DataFrame, test: DataFrame) -> Result:
        total = time.perf_counter()
        self.fit(train, test)
        start = time.perf_counter()
        predictions = cut(self.predict(test))
        merged = ev.merge_predictions(predictions.drop("label"), test.select("row_id", "label"))
        metrics = cut(ev.metrics(merged, self.config.task))
        self._timed("Testing time", start)
        self._timed("Total execution time", total)
        return Result(predictions, metrics, svm.train_report(self.models, self.config.task, self.job.residuals), self.models, self.params,
                      self.run_info(train.sparkSession), self.tables)

    def run_info(self, spark) -> DataFrame:
        """(section, key, value) of the configuration and the stage timings."""
        rows = [("configuration", k, str(v)) for k, v in asdict(self.config).items()]
        rows += [("timing", k, f"{v:.2f} seconds") for k, v in self.seconds.items()]
        return spark.createDataFrame(rows, "section string, key string, value string")


def run_lines(info: DataFrame, metrics: DataFrame) -> DataFrame:
    """value: the lines 'key: value' of a run's configuration, timings and overall metrics."""
    names = {"accuracy": "Overall Accuracy", "f1": "Overall F1 Score", "mse": "Overall MSE", "rmse": "Overall RMSE", "r2": "Overall R2"}
    mapping = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    overall = metrics.filter("scope = 'overall'").select(
        F.concat_ws(": ", mapping[F.col("metric")], F.format_number("value", 4)).alias("value"))
    return info.select(F.concat_ws(": ", "key", "value").alias("value")).unionByName(overall)


def write_run_log(result: Result, path: str) -> None:
    """The run as text lines, readable by the run-log summary."""
    run_lines(result.run_info, result.metrics).coalesce(1).write.mode("overwrite").text(path)
