"""One support-vector model per cluster, all clusters in the same jobs.

Rows are packed into blocks of one cluster each (bounded in rows and cells). A cluster that
fits one block is solved inside its task. A cluster of many blocks is solved by rounds over a
table of fits: the point at which a fit is measured joins its cluster's blocks, every task adds
the Gram matrices of its rows with non-zero loss, the shuffle sums them, and each fit's next
point is computed from its own sums. Only whether any fit is left comes back to the driver.
Both ways reach the same unique minimum.

The losses are squared (hinge, epsilon-insensitive), so each round solves a linear system.
Kernels are explicit feature maps over per-cluster landmarks.
"""

from __future__ import annotations

import pickle
import time

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import kernels as kn
from ..functions.hashing import SEED, hash_int
from ..functions.ranking import first_by_hash, hash_rank
from ..session import BROADCAST_BYTES, cut, small

BLOCK_ROWS = 8192
BLOCK_CELLS = 2_000_000
LANDMARKS = 64
MOST_LANDMARKS = 1024       # of one cluster, when they grow
SUM_BYTES = 256 << 20       # Gram matrices that a task holds before it hands them on
TURN_BYTES = BROADCAST_BYTES // 2    # of points that are broadcast at once

DEFAULTS = {"kernel": "rbf", "c": 1.0, "gamma": None, "epsilon": 0.1}     # gamma None = 1/(d Var X)
PARAM = "trial int, kernel string, c double, gamma double, epsilon double, mask array<boolean>"
MODEL = ("cluster_id int, trial int, fold int, class_pos double, class_neg double, weights array<double>, "
         "objective double, residual double, rounds int, n_train bigint, n_support bigint, seconds double, error string")
FIT = ("fit string, cluster_id int, trial int, fold int, class_pos double, class_neg double, kernel string, c double, gamma double, "
       "epsilon double, mask array<boolean>, at array<double>, way array<double>, state binary, n bigint, done boolean, seconds double, error string")
SCORE = "cluster_id int, trial int, fold int, n bigint, hits bigint, sse double, sum_y double, sum_yy double"


def assign_folds(rows: DataFrame, cv: int, task: str, seed: int = SEED) -> DataFrame:
    """Add ``fold`` and ``n_folds``: stratified by label for clf, plain for reg, reduced for small classes."""
    keyed = ["row_id", "copy"] if "copy" in rows.columns else ["row_id"]
    if task == "clf":
        counts = rows.groupBy("cluster_id", "label").agg(F.count("*").alias("n"))
        folds = counts.groupBy("cluster_id").agg(F.greatest(F.lit(2), F.least(F.lit(cv), F.min("n"))).cast("int").alias("n_folds"))
        groups = ["cluster_id", "label"]
    else:
        counts = rows.groupBy("cluster_id").agg(F.count("*").alias("n"))
        folds = counts.select("cluster_id", F.greatest(F.lit(2), F.least(F.lit(cv), F.floor(F.col("n") / 2))).cast("int").alias("n_folds"))
        groups = ["cluster_id"]
    ranked = hash_rank(rows.join(small(folds), "cluster_id"), groups, keyed, seed, out="__r")
    return ranked.withColumn("fold", ((F.col("__r") - 1) % F.col("n_folds")).cast("int")).drop("__r")


def pack_blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS, seed: int = SEED, with_ids: bool = True) -> DataFrame:
    """Blocks of at most about ``block_rows`` rows of one cluster, with the cluster's totals.

    cluster_id, block, blocks, d, variance, classes (NULL for many values), and per row arrays.
    """
    extra = [c for c in ("copy", "fold", "n_folds") if c in rows.columns]
    entry = F.aggregate("val", F.lit(0.0), lambda a, v: a + v)
    square = F.aggregate("val", F.lit(0.0), lambda a, v: a + v * v)
    stats = rows.groupBy("cluster_id").agg(
        F.count("*").alias("__n"), (F.coalesce(F.max(F.array_max("idx")), F.lit(0)) + 1).alias("d"),
        F.sum(entry).alias("__s"), F.sum(square).alias("__q"))
    cells = F.col("__n") * F.col("d")
    size = F.greatest(F.lit(64), F.least(F.lit(block_rows), F.floor(F.lit(BLOCK_CELLS) / F.col("d"))))
    stats = stats.select(
        "cluster_id", F.col("__n").alias("n_cluster"), "d",
        (F.col("__q") / cells - F.pow(F.col("__s") / cells, 2)).alias("variance"),
        F.ceil(F.col("__n") / size).cast("int").alias("blocks"))
    stats = small(stats)
    keyed = [F.col("row_id")] + ([F.col("copy")] if "copy" in extra else [])
    salted = rows.join(stats, "cluster_id").withColumn("block", (hash_int(seed, F.lit("block"), *keyed) % F.col("blocks")).cast("int"))
    # An explicit number keeps the blocks apart: they are few, but each is work for a task.
    gathered = _spread(salted, "cluster_id", "block").groupBy("cluster_id", "block", "blocks", "n_cluster", "d", "variance").agg(
        F.collect_list(F.struct(*(["row_id"] if with_ids else []), "label", "idx", "val", *extra)).alias("e"))
    return gathered.select(
        "cluster_id", "block", "blocks", "n_cluster", "d", "variance",
        *([F.col("e.row_id").alias("row_id")] if with_ids else []), F.col("e.label").alias("label"),
        F.transform("e", lambda r: F.size(r["idx"])).alias("lengths"),
        F.flatten("e.idx").alias("idx"), F.flatten("e.val").alias("val"),
        *[F.col(f"e.{c}").alias(c) for c in extra if c != "copy"])


def landmark_rows(rows: DataFrame, m: int = LANDMARKS, seed: int = SEED) -> DataFrame:
    """(cluster_id, rank, idx, val): the first ``m`` rows per cluster in hash order."""
    keyed = ["row_id", "copy"] if "copy" in rows.columns else ["row_id"]
    first = first_by_hash(rows.select("cluster_id", *keyed, "idx", "val"), ["cluster_id"], keyed, m, f"{seed}/landmark")
    return first.select("cluster_id", F.col("rank").cast("bigint").alias("rank"), "idx", "val")


def pack_landmarks(marks: DataFrame) -> DataFrame:
    """One row per cluster; at most MOST_LANDMARKS rows in it."""
    packed = marks.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("rank", "idx", "val"))).alias("l"))
    return packed.select("cluster_id", F.transform("l", lambda r: F.size(r["idx"])).alias("l_lengths"),
                         F.flatten("l.idx").alias("l_idx"), F.flatten("l.val").alias("l_val"))


def _matrix(lengths, idx, val, d: int) -> np.ndarray:
    block = np.zeros((len(lengths), d))
    columns = np.asarray(idx, dtype=np.int64)
    at = np.repeat(np.arange(len(lengths)), lengths)
    seen = columns < d
    block[at[seen], columns[seen]] = np.asarray(val, dtype=float)[seen]
    return block


def _landmarks(row, d: int):
    if row.l_lengths is None:
        return None
    return np.unique(_matrix(row.l_lengths, row.l_idx, row.l_val, d), axis=0)


def _mapped(x, row, param, marks):
    """Feature map of a block under one parameter set, with its column mask."""
    d = x.shape[1]
    mask = param["mask"]
    if mask is not None and len(mask):
        on = np.zeros(d, dtype=bool)
        on[:min(d, len(mask))] = np.asarray(mask[:d], dtype=bool)
        x = x[:, on]
        marks = None if marks is None else marks[:, on]
    return kn.feature_map(x, param["kernel"], _gamma(param["gamma"], x, row), marks)


def _own_kernel(x, row, param) -> np.ndarray:
    """Each row's kernel with itself."""
    if param["mask"] is not None:
        on = np.zeros(x.shape[1], dtype=bool)
        on[:min(len(on), len(param["mask"]))] = np.asarray(param["mask"][:len(on)], dtype=bool)
        x = x[:, on]
    return kn.self_kernel(x, param["kernel"], _gamma(param["gamma"], x, row))


def _gamma(gamma, x, row) -> float:
    if gamma is None or np.isnan(gamma):
        spread = x.shape[1] * row.variance
        return 1.0 / spread if spread > 0 else 1.0
    return gamma


def _targets(label, a, b, task):
    """Rows and targets of one fit: +-1 for a class pair, the label itself for regression."""
    if task == "reg":
        return np.ones(len(label), dtype=bool), label
    here = (label == a) | (label == b)
    return here, np.where(label[here] == a, 1.0, -1.0)


def _fit_pairs(classes, task):
    return [(np.nan, np.nan)] if task == "reg" else kn.class_pairs(classes)


def _folds(row, cross: bool):
    return range(int(row.n_folds[0])) if cross else (-1,)


def _local_kernel(task: str, cross: bool, max_rounds: int):
    """Kernel for clusters of one block: train (and score held-out folds) inside the task."""

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x = _matrix(row.lengths, row.idx, row.val, int(row.d))
                label = np.asarray(row.label, dtype=float)
                fold = np.asarray(row.fold) if cross else None
                marks = _landmarks(row, int(row.d))
                out, maps, paths = [], {}, {}
                # along a path of C all sets of one kernel and gamma share the map, and each fit starts from the last
                for param in sorted(row.params, key=lambda p: (p["kernel"], p["gamma"] or 0.0, p["c"], p["trial"])):
                    started = time.perf_counter()
                    try:
                        if task == "clf" and len(np.unique(label)) < 2:
                            raise ValueError("one class")
                        same = _map_key(param)
                        if same not in maps:
                            maps, paths = {same: _mapped(x, row, param, marks)}, {}
                        for f in _folds(row, cross):
                            out.append(_one_fold(row, param, maps[same], label, fold, f, task, max_rounds, started, paths))
                    except Exception as error:      # the other clusters go on
                        out.append((param["trial"], -1, None, str(error)))
                yield _score_frame(row, out) if cross else _model_frame(row, out)

    return run


def _map_key(param):
    """What a feature map depends on: linear ones on the mask alone."""
    gamma = None if param["kernel"] == "linear" else param["gamma"]
    mask = param["mask"]
    return param["kernel"], None if gamma is None or np.isnan(gamma) else gamma, None if mask is None else tuple(mask)


def _one_fold(row, param, phi, label, fold, f, task, max_rounds, started, paths):
    train = np.ones(len(label), dtype=bool) if f < 0 else fold != f
    states = []
    for a, b in _fit_pairs(np.unique(label[train]), task):
        here, target = _targets(label[train], a, b, task)
        path = (f, a, b) if task == "clf" else (f, param["epsilon"])
        state = kn.solve_rows(phi[train][here], target, param["c"], task, param["epsilon"], max_rounds, paths.get(path))
        paths[path] = state.w
        states.append((a, b, state, int(here.sum())))
    if f < 0:
        return param["trial"], f, (states, time.perf_counter() - started), None
    held = ~train
    return param["trial"], f, (label[held], predict_rows(phi[held], [(a, b, s.w) for a, b, s, _ in states], task)), None


def predict_rows(phi: np.ndarray, fits, task: str) -> np.ndarray:
    if task == "reg":
        return phi @ fits[0][2]
    return kn.vote(phi, fits)


def _model_frame(row, out) -> pd.DataFrame:
    lines = []
    for trial, f, done, error in out:
        if done is None:
            lines.append((row.cluster_id, trial, f, None, None, None, None, None, None, None, None, None, error))
            continue
        states, seconds = done
        for a, b, s, n in states:
            lines.append((row.cluster_id, trial, f, a, b, s.w, s.value, s.residual, s.rounds, n, s.active, seconds, None))
    return pd.DataFrame(lines, columns=[c.split()[0] for c in MODEL.split(", ")])


def _sums(label, guess):
    return (len(label), int((label == guess).sum()), float(((label - guess) ** 2).sum()), float(label.sum()), float(label @ label))


def _score_frame(row, out) -> pd.DataFrame:
    lines = [(row.cluster_id, trial, f, *_sums(*done)) for trial, f, done, error in out if done is not None]
    return pd.DataFrame(lines, columns=[c.split()[0] for c in SCORE.split(", ")])


def pack_params(params: DataFrame, per_task: int = 4) -> DataFrame:
    """Parameter sets of a cluster in short lists, so that few clusters still use many tasks; sets that share a
    feature map (kernel and gamma) stand in one list."""
    with_mask = with_masks(params)
    entry = F.struct(F.col("trial").cast("int").alias("trial"), "kernel", F.col("c").cast("double").alias("c"),
                     F.col("gamma").cast("double").alias("gamma"), F.col("epsilon").cast("double").alias("epsilon"), "mask")
    if per_task >= 1 << 30:
        part = F.lit(0).cast("bigint")
    else:
        gamma = F.when(F.col("kernel") == "linear", F.lit(0.0)).otherwise(F.coalesce(F.col("gamma").cast("double"), F.lit(-1.0)))
        masked = F.when(F.col("mask").isNotNull(), F.floor(F.col("trial") / per_task)).otherwise(F.lit(-1))
        part = F.xxhash64("kernel", gamma, masked)
    return with_mask.groupBy("cluster_id", part.alias("part")).agg(
        F.sort_array(F.collect_list(entry)).alias("params"))


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Blocks are few and heavy: give the tasks an even share of them."""
    parallel = df.sparkSession.sparkContext.defaultParallelism
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parallel, wanted), *keys)


class SvmJob:
    """Packed train rows plus landmarks; ``train`` and ``cross_validate`` take parameter tables.

    ``rows``: cluster_id, row_id, [copy], label, idx, val and for cross validation fold, n_folds.
    """

    def __init__(self, rows: DataFrame, task: str, landmarks: int = LANDMARKS, block_rows: int = BLOCK_ROWS,
                 max_rounds: int = 50, seed: int = SEED):
        if task not in ("clf", "reg"):
            raise ValueError(f"task must be clf or reg, not {task!r}")
        self.task, self.max_rounds = task, max_rounds
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        if rows.filter(F.col("label").isNull()).limit(1).count():
            raise ValueError("every row needs a label")
        self.seed, self.mark_rows = seed, cut(landmark_rows(rows, landmarks, seed))
        self.marks = small(pack_landmarks(self.mark_rows))
        self.residuals: DataFrame | None = None
        packed = pack_blocks(rows, block_rows, seed, with_ids=False).join(self.marks, "cluster_id", "left")
        # Read once per round or trial table; losing a copy only costs packing it again.
        self.blocks = packed.persist(StorageLevel.MEMORY_AND_DISK)
        self.many = not self.blocks.filter("blocks > 1").isEmpty()
        rows.unpersist()

    def release(self) -> None:
        self.blocks.unpersist()

    def grow(self, params: DataFrame, residual: float = 0.01, most: int = MOST_LANDMARKS) -> None:
        """Add landmarks until every cluster's kernels are met: the part of the kernel's trace that the map misses is at
        most ``residual``, or the cluster has ``most`` landmarks or has all its rows in.

        Every round doubles the landmarks of the clusters that miss more; new ones are drawn from all their rows,
        with a row's chance in proportion to what the map misses of it. ``residuals`` (cluster_id, landmarks,
        kernel_residual) says where each ended.
        """
        maps = with_masks(params).filter("kernel <> 'linear'").select("cluster_id", "kernel", F.col("gamma").cast("double").alias("gamma"), "mask").distinct()
        maps = small(maps.groupBy("cluster_id").agg(F.collect_list(F.struct("kernel", "gamma", "mask")).alias("maps")))
        bare = self.blocks.drop("l_lengths", "l_idx", "l_val")
        turn = 0
        while True:
            sizes = self.mark_rows.groupBy("cluster_id").agg(F.count("*").alias("landmarks"), F.max("rank").alias("top"))
            met = bare.join(self.marks, "cluster_id").join(maps, "cluster_id")
            seen = cut(met.mapInPandas(_missed(self.seed, turn, most), "cluster_id int, map int, missed double, trace double, key double, idx array<int>, val array<double>"))
            share = seen.filter("map is not null").groupBy("cluster_id", "map").agg((F.sum("missed") / F.sum("trace")).alias("r"))
            self.residuals = cut(share.groupBy("cluster_id").agg(F.max("r").alias("kernel_residual")).join(sizes, "cluster_id"))
            left = self.residuals.filter((F.col("kernel_residual") > residual) & (F.col("landmarks") < most))
            place = F.row_number().over(W.partitionBy("cluster_id").orderBy("key", "idx", "val"))
            fresh = seen.filter("key is not null").join(left.select("cluster_id", "landmarks", "top"), "cluster_id").withColumn("place", place)
            fresh = fresh.filter(F.col("place") <= F.least("landmarks", most - F.col("landmarks")))
            added = cut(fresh.select("cluster_id", (F.col("top") + F.col("place")).alias("rank"), "idx", "val"))
            if added.isEmpty():
                break
            self.mark_rows = cut(self.mark_rows.unionByName(added))
            self.marks = small(pack_landmarks(self.mark_rows))
            turn += 1
        old, self.blocks = self.blocks, bare.join(self.marks, "cluster_id", "left").persist(StorageLevel.MEMORY_AND_DISK)
        self.many = not self.blocks.filter("blocks > 1").isEmpty()
        old.unpersist()

    def _small(self, params: DataFrame, cross: bool, schema: str, per_task: int) -> DataFrame:
        joined = self.blocks.filter("blocks = 1").join(small(pack_params(params, per_task)), "cluster_id")
        return _spread(joined, "cluster_id", "part").mapInPandas(_local_kernel(self.task, cross, self.max_rounds), schema)

    def train(self, params: DataFrame) -> DataFrame:
        """Models (one row per cluster, trial and class pair) fitted on all rows of the cluster."""
        small = self._small(params, False, MODEL, 4)
        return small.unionByName(self._rounds(params, False)) if self.many else small

    def cross_validate(self, params: DataFrame, per_task: int = 4) -> DataFrame:
        """Sums per (cluster, trial, fold) on the held-out rows."""
        small = self._small(params, True, SCORE, per_task)
        if not self.many:
            return small
        models = self._rounds(params, True)
        scored = _score_large(self.blocks.filter("blocks > 1"), models, params, self.task)
        return small.unionByName(scored)

    # -- clusters of many blocks ---------------------------------------------------------------

    def _fits(self, params: DataFrame, cross: bool) -> DataFrame:
        """One row per fit of a large cluster, at its starting point."""
        many = self.blocks.filter("blocks > 1")
        folds = F.max(F.col("n_folds")[0]) if cross else F.lit(0)
        wanted = with_masks(params).join(many.groupBy("cluster_id").agg(F.max("d").alias("d"), F.max("variance").alias("variance"), folds.alias("n_folds")), "cluster_id")
        none = F.lit(float("nan"))
        if self.task == "clf":
            labels = many.select("cluster_id", F.explode(F.array_distinct("label")).alias("label")).groupBy("cluster_id")
            wanted = wanted.join(labels.agg(F.sort_array(F.collect_set("label")).alias("k")), "cluster_id")
            later = lambda x, i: F.transform(F.slice("k", i + 2, F.size("k")), lambda y: F.struct(x.alias("a"), y.alias("b")))
            pairs = F.when(F.size("k") > 1, F.flatten(F.transform("k", later))).otherwise(F.array(F.struct(none.alias("a"), none.alias("b"))))
            failed = F.when(F.size("k") < 2, F.lit("one class"))
        else:
            pairs, failed = F.array(F.struct(none.alias("a"), none.alias("b"))), F.lit(None).cast("string")
        wanted = wanted.withColumn("error", failed).withColumn("pair", F.explode(pairs))
        fold = F.explode(F.sequence(F.lit(0), F.col("n_folds") - 1)) if cross else F.lit(-1)
        wanted = (wanted.filter("error is null") if cross else wanted).withColumn("fold", fold)
        named = wanted.withColumn("fit", F.concat_ws("/", "cluster_id", "trial", "fold", "pair.a", "pair.b"))
        met = named.join(self.marks, "cluster_id", "left").select(
            "fit", F.col("cluster_id").cast("int").alias("cluster_id"), F.col("trial").cast("int").alias("trial"), F.col("fold").cast("int").alias("fold"),
            F.col("pair.a").alias("class_pos"), F.col("pair.b").alias("class_neg"), "kernel", F.col("c").cast("double").alias("c"),
            F.col("gamma").cast("double").alias("gamma"), F.col("epsilon").cast("double").alias("epsilon"), "mask", "error", "d", "variance", "l_lengths", "l_idx", "l_val")
        return cut(met.mapInPandas(_start_fits, FIT))

    def _rounds(self, params: DataFrame, cross: bool) -> DataFrame:
        """Models of the large clusters. Points of live fits join their clusters' blocks, TURN_BYTES at a time."""
        state = self._fits(params, cross)
        blocks = self.blocks.filter("blocks > 1")
        while True:
            live = state.filter(~F.col("done"))
            fits, size = live.agg(F.count("*"), F.sum(F.size("at") + F.when(F.col("way").isNull(), 0).otherwise(F.size("way")))).first()
            if not fits:
                break
            turns = max(1, -(-8 * size // TURN_BYTES))
            entry = F.struct("fit", "trial", "fold", "class_pos", "class_neg", "kernel", "c", "gamma", "epsilon", "mask", "at", "way")
            points = live.withColumn("turn", F.pmod(F.xxhash64("cluster_id", "trial"), F.lit(turns)))
            points = points.groupBy("cluster_id", "turn").agg(F.collect_list(entry).alias("fits"))
            sums = None
            for turn in range(turns):
                met = blocks.join(F.broadcast(points.filter(F.col("turn") == turn).drop("turn")), "cluster_id")
                found = met.mapInPandas(_sum_kernel(self.task), "fit string, rows bigint, sums array<double>")
                sums = found if sums is None else sums.unionByName(found)
            total = sums.groupBy("fit").agg(
                F.sum("rows").alias("rows"), vector_to_array(Summarizer.sum(array_to_vector(F.col("sums")))).alias("sums"))
            state = cut(state.join(total, "fit", "left").mapInPandas(_advance(self.max_rounds), FIT))
        return state.mapInPandas(_as_models, MODEL)


def _missed(seed: int, turn: int, most: int):
    """Kernel: for each block and map the missed and the whole trace, and rows drawn in proportion to what is missed."""
    def run(batches):
        columns = ["cluster_id", "map", "missed", "trace", "key", "idx", "val"]
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x, marks = _matrix(row.lengths, row.idx, row.val, int(row.d)), _landmarks(row, int(row.d))
                lines, worst = [], np.zeros(len(x))
                for number, m in enumerate(sorted(row.maps, key=lambda m: (m["kernel"], m["gamma"] or 0.0, str(m["mask"])))):
                    phi = _mapped(x, row, m, marks)[:, :-1]
                    whole = _own_kernel(x, row, m)
                    missed = np.maximum(whole - (phi * phi).sum(1), 0.0)
                    lines.append((row.cluster_id, number, float(missed.sum()), float(np.abs(whole).sum()) or 1.0, None, None, None))
                    worst = np.maximum(worst, missed / max(float(np.abs(whole).mean()), 1e-300))
                u = np.random.default_rng([seed, turn, int(row.cluster_id) & 0xFFFFFFFF, int(row.block)]).random(len(x))
                with np.errstate(divide="ignore"):
                    key = np.where(worst > 1e-9, -np.log(u) / worst, np.inf)
                ends = np.cumsum(row.lengths)
                for i in np.argsort(key, kind="stable")[: min(most, len(marks))]:
                    if np.isfinite(key[i]):
                        part = slice(ends[i] - row.lengths[i], ends[i])
                        lines.append((row.cluster_id, None, None, None, float(key[i]), row.idx[part], row.val[part]))
                yield pd.DataFrame(lines, columns=columns).astype({"map": "Int32", "missed": "Float64", "trace": "Float64", "key": "Float64"})

    return run


def with_masks(params: DataFrame) -> DataFrame:
    return params if "mask" in params.columns else params.withColumn("mask", F.lit(None).cast("array<boolean>"))


FIT_NAMES = [c.split()[0] for c in FIT.split(", ")]


def _start_fits(batches):
    """Kernel: the starting state of each fit, as wide as its feature map."""
    for pdf in batches:
        lines = []
        for row in pdf.itertuples(index=False):
            values = row._asdict()
            point = state = None
            if row.error is None:
                try:
                    width = _map_width(row)
                    kind = kn.WideState if width > kn.GRAM_COLUMNS else kn.NewtonState
                    state = kind(width, row.c)
                    point = state.candidate
                except Exception as error:      # the other fits go on
                    values["error"] = str(error)
            held = None if state is None else pickle.dumps((kind.__name__, vars(state)))
            lines.append([values.get(c) for c in FIT_NAMES[:-7]] + [point, None, held, 0, held is None, 0.0, values["error"]])
        yield pd.DataFrame(lines, columns=FIT_NAMES)


def _restored(data: bytes):
    name, held = pickle.loads(data)
    state = object.__new__(getattr(kn, name))
    vars(state).update(held)
    return state


def _advance(max_rounds: int):
    """Kernel: each live fit takes in its sums (upper Gram, right side, loss, active rows; for wide fits slope or
    curvature, loss, active rows) and names the point where it wants the next ones."""
    def run(batches):
        for pdf in batches:
            lines = []
            for row in pdf.itertuples(index=False):
                values = {c: getattr(row, c) for c in FIT_NAMES}
                if not row.done:
                    started = time.perf_counter()
                    state, v = _restored(row.state), np.asarray(row.sums)
                    if isinstance(state, kn.NewtonState):
                        m = len(state.candidate)
                        tri = m * (m + 1) // 2
                        gram = np.zeros((m, m))
                        gram[np.triu_indices(m)] = v[:tri]
                        gram = gram + np.triu(gram, 1).T
                        state.advance(v[-2], int(round(v[-1])), kn.newton_solution(gram, v[tri:tri + m], state.c), max_rounds)
                    elif state.phase == "solve":
                        state.solved(v[:-2])
                    else:
                        state.measured(v[:-2], v[-2], int(round(v[-1])), max_rounds)
                    solving = isinstance(state, kn.WideState) and state.phase == "solve"
                    values |= {"at": state.w if solving else state.candidate, "way": state.direction if solving else None, "n": row.rows,
                               "state": pickle.dumps((type(state).__name__, vars(state))), "done": state.done, "seconds": row.seconds + time.perf_counter() - started}
                lines.append([values[c] for c in FIT_NAMES])
            yield pd.DataFrame(lines, columns=FIT_NAMES)

    return run


def _as_models(batches):
    names = [c.split()[0] for c in MODEL.split(", ")]
    for pdf in batches:
        lines = []
        for row in pdf.itertuples(index=False):
            if row.state is None:
                lines.append((row.cluster_id, row.trial, row.fold, *[None] * 9, row.error))
                continue
            s = _restored(row.state)
            lines.append((row.cluster_id, row.trial, row.fold, row.class_pos, row.class_neg, s.w, float(s.value), float(s.residual),
                          int(s.rounds), int(row.n), int(s.active), row.seconds, None))
        yield pd.DataFrame(lines, columns=names)


def _map_width(row) -> int:
    """Columns of the feature map, found on the landmarks themselves."""
    d = int(row.d)
    if row.kernel == "linear":
        return (d if row.mask is None else int(np.sum(row.mask[:d]))) + 1
    points = np.unique(_matrix(row.l_lengths, row.l_idx, row.l_val, d), axis=0)
    return _mapped(points, row, {"mask": row.mask, "gamma": row.gamma, "kernel": row.kernel}, points).shape[1]


def _sum_kernel(task: str):
    """Kernel: sums of a task's blocks per fit, as one vector."""

    def run(batches):
        totals: dict = {}
        held = 0
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x = _matrix(row.lengths, row.idx, row.val, int(row.d))
                label = np.asarray(row.label, dtype=float)
                fold = np.asarray(row.fold) if hasattr(row, "fold") else None
                marks = _landmarks(row, int(row.d))
                same = phi = None
                for fit in sorted(row.fits, key=lambda f: (f["kernel"], f["gamma"] or 0.0, f["trial"])):
                    if same != _map_key(fit):
                        same, phi = _map_key(fit), _mapped(x, row, fit, marks)
                    train = np.ones(len(label), dtype=bool) if fit["fold"] < 0 else fold != fit["fold"]
                    here, target = _targets(label[train], fit["class_pos"], fit["class_neg"], task)
                    rows, at = phi[train][here], np.asarray(fit["at"])
                    if fit["way"] is not None:
                        vector = np.concatenate([kn.curvature(rows, target, at, np.asarray(fit["way"]), task, fit["epsilon"]), [0.0, 0.0]])
                    elif len(at) > kn.GRAM_COLUMNS:
                        slope, loss, active = kn.slopes(rows, target, at, task, fit["epsilon"])
                        vector = np.concatenate([slope, [loss, active]])
                    else:
                        gram, aim, loss, active = kn.newton_sums(rows, target, at, task, fit["epsilon"])
                        vector = np.concatenate([gram[np.triu_indices(len(aim))], aim, [loss, active]])
                    if fit["fit"] not in totals:
                        held += vector.nbytes
                    n, old = totals.get(fit["fit"], (0, 0.0))
                    totals[fit["fit"]] = (n + int(here.sum()), old + vector)
                    if held > SUM_BYTES:
                        yield _handed_on(totals)
                        totals, held = {}, 0
        if totals:
            yield _handed_on(totals)

    return run


def _handed_on(totals: dict) -> pd.DataFrame:
    return pd.DataFrame({"fit": list(totals), "rows": [n for n, _ in totals.values()], "sums": [v for _, v in totals.values()]})


def pack_models(models: DataFrame, params: DataFrame, marks: DataFrame | None) -> DataFrame:
    """One row per cluster: parameter sets, weights of all class pairs, landmarks."""
    fitted = models.filter(F.col("weights").isNotNull())
    entry = F.struct("trial", "fold", "class_pos", "class_neg", "weights")
    packed = fitted.groupBy("cluster_id").agg(F.collect_list(entry).alias("models"))
    joined = packed.join(pack_params(params, 1 << 30).drop("part"), "cluster_id")
    if marks is not None:
        return joined.join(marks, "cluster_id", "left")
    none = F.lit(None)
    return joined.withColumn("l_lengths", none.cast("array<int>")).withColumn("l_idx", none.cast("array<int>")).withColumn(
        "l_val", none.cast("array<double>"))


def _predict_kernel(task: str, width: str):
    """Kernel: predictions of a block under its own cluster's models."""

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                d = int(row.train_d)
                x = _matrix(row.lengths, row.idx, row.val, d)
                marks = _landmarks(row, d)
                for param in row.params:
                    phi = _mapped(x, row, param, marks)
                    fits = [(m["class_pos"], m["class_neg"], np.asarray(m["weights"])) for m in row.models if m["trial"] == param["trial"]]
                    yield pd.DataFrame({"row_id": row.row_id, "cluster_id": row.cluster_id, "trial": param["trial"],
                                        "label": np.asarray(row.label, dtype=float), "prediction": predict_rows(phi, fits, task)})

    return run


def check_routes(rows: DataFrame, models: DataFrame) -> None:
    """Every cluster with rows needs a model; names all that have none."""
    fitted = models.filter(F.col("weights").isNotNull()).select("cluster_id").distinct()
    lost = [r["cluster_id"] for r in rows.select("cluster_id").distinct().join(fitted, "cluster_id", "left_anti").collect()]
    if lost:
        raise ValueError(f"no model for clusters {sorted(lost)}")


def predict(rows: DataFrame, models: DataFrame, params: DataFrame, shape: DataFrame, task: str,
            marks: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """predictions(row_id, cluster_id, trial, label, prediction).

    Rows are packed per cluster; every block meets its cluster's models in one equi-join, so
    neither all models nor a whole cluster has to fit anywhere. ``shape``: cluster_id, d and
    variance of the train rows.
    """
    check_routes(rows, models)
    state = pack_models(models, params, marks).join(shape.select("cluster_id", F.col("d").alias("train_d"), F.col("variance").alias("train_variance")), "cluster_id")
    blocks = pack_blocks(rows.select("cluster_id", "row_id", "label", "idx", "val"), block_rows)
    met = blocks.join(small(state), "cluster_id").drop("variance").withColumnRenamed("train_variance", "variance")
    kind = rows.schema["row_id"].dataType.simpleString()
    out = f"row_id {kind}, cluster_id int, trial int, label double, prediction double"
    return _spread(met, "cluster_id", "block").mapInPandas(_predict_kernel(task, kind), out)


def train_shape(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("cluster_id").agg(F.max("d").alias("d"), F.max("variance").alias("variance"))


def _score_large(blocks: DataFrame, models: DataFrame, params: DataFrame, task: str) -> DataFrame:
    entry = F.struct("trial", "fold", "class_pos", "class_neg", "weights")
    packed = models.filter(F.col("weights").isNotNull()).groupBy("cluster_id").agg(F.collect_list(entry).alias("models"))
    state = packed.join(pack_params(params, 1 << 30).drop("part"), "cluster_id")
    met = blocks.join(small(state), "cluster_id")
    sums = [F.sum(c).alias(c) for c in ("n", "hits", "sse", "sum_y", "sum_yy")]
    return met.mapInPandas(_held_out_kernel(task), SCORE).groupBy("cluster_id", "trial", "fold").agg(*sums)


def _held_out_kernel(task: str):
    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x = _matrix(row.lengths, row.idx, row.val, int(row.d))
                label, fold = np.asarray(row.label, dtype=float), np.asarray(row.fold)
                marks = _landmarks(row, int(row.d))
                out = []
                for param in row.params:
                    phi = _mapped(x, row, param, marks)
                    for f in np.unique(fold):
                        fits = [(m["class_pos"], m["class_neg"], np.asarray(m["weights"])) for m in row.models
                                if m["trial"] == param["trial"] and m["fold"] == f]
                        if fits:
                            out.append((param["trial"], int(f), (label[fold == f], predict_rows(phi[fold == f], fits, task)), None))
                yield _score_frame(row, out)

    return run


def params_by_cluster(clusters: DataFrame, tuned: DataFrame | None = None) -> DataFrame:
    """Tuned parameters where a cluster has them, the defaults elsewhere."""
    default = {k: F.lit(v) if v is not None else F.lit(None).cast("double") for k, v in DEFAULTS.items()}
    if tuned is None:
        return clusters.select("cluster_id", F.lit(0).alias("trial"), *[v.alias(k) for k, v in default.items()])
    own = tuned.select("cluster_id", F.lit(True).alias("tuned"), *[F.col(k).alias(f"own_{k}") for k in default])
    joined = clusters.join(own, "cluster_id", "left")
    return joined.select("cluster_id", F.lit(0).alias("trial"),
                         *[F.when(F.col("tuned"), F.col(f"own_{k}")).otherwise(v).alias(k) for k, v in default.items()])


def get_model(models: DataFrame, cluster_id: int) -> DataFrame:
    return models.filter(F.col("cluster_id") == cluster_id)


def train_report(models: DataFrame, task: str, residuals: DataFrame | None = None) -> DataFrame:
    """Per cluster: seconds, support rows (rows with non-zero loss), pairs, and the error if it failed; with
    ``residuals`` of a job also its landmarks and what its kernels miss."""
    report = models.groupBy("cluster_id").agg(
        F.max("seconds").alias("training_time"), F.sum("n_support").alias("n_support_vectors"),
        F.count("weights").alias("n_fits"), F.max("residual").alias("residual"), F.max("error").alias("error")).withColumn(
        "task_type", F.lit(task))
    return report if residuals is None else report.join(residuals.select("cluster_id", "landmarks", "kernel_residual"), "cluster_id", "left")
