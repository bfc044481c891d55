"""Parameter search for all clusters at once: every round is one cross-validation job."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import proposals as pr
from ..functions.hashing import SEED, hash_int, hash_uniform
from ..session import cut
from .svm import SvmJob

OPTIMIZERS = ("random", "grid", "bayes", "tpe")

# Fixed values of the search spaces: log ranges, grid sizes, epsilon grid.
KERNELS = ["rbf", "linear", "poly", "sigmoid"]
GRID_C = (1e-3, 1e3, 7)
GRID_GAMMA = (1e-5, 1e2, 6)
GRID_EPSILON = (0.1, 1.0, 10)
RANDOM_SPACE = {"c": (1e-3, 1e3), "gamma": (1e-4, 1e1)}
BAYES_SPACE = {"c": (1e-4, 1e4), "gamma": (1e-4, 1e2)}
DEFAULT_EPSILON = 0.1


def grid_params(clusters: DataFrame, task: str) -> DataFrame:
    """All combinations for every cluster; trial numbers follow C, gamma, kernel, epsilon order."""
    def logs(lo, hi, n):
        return F.array(*[F.lit(float(v)) for v in np.logspace(np.log10(lo), np.log10(hi), n)])

    epsilon = [float(v) for v in np.linspace(*GRID_EPSILON)] if task == "reg" else [DEFAULT_EPSILON]
    grid = clusters.select("cluster_id", F.posexplode(logs(*GRID_C)).alias("i", "c"))
    grid = grid.select("*", F.posexplode(logs(*GRID_GAMMA)).alias("j", "gamma"))
    grid = grid.select("*", F.posexplode(F.array(*map(F.lit, KERNELS))).alias("k", "kernel"))
    grid = grid.select("*", F.posexplode(F.array(*map(F.lit, epsilon))).alias("l", "epsilon"))
    n_gamma, n_kernel, n_eps = GRID_GAMMA[2], len(KERNELS), len(epsilon)
    trial = ((F.col("i") * n_gamma + F.col("j")) * n_kernel + F.col("k")) * n_eps + F.col("l")
    return grid.select("cluster_id", trial.cast("int").alias("trial"), "kernel", "c", "gamma", "epsilon")


def random_params(clusters: DataFrame, n_iter: int, task: str, seed: int = SEED, space=None, first: int = 0) -> DataFrame:
    """``n_iter`` seeded draws per cluster: C and gamma log-uniform, kernel and epsilon uniform."""
    space = space or RANDOM_SPACE
    trials = clusters.select("cluster_id", F.explode(F.sequence(F.lit(first), F.lit(first + n_iter - 1))).alias("trial"))

    def log_uniform(name):
        lo, hi = (float(np.log(v)) for v in space[name])
        return F.exp(F.lit(lo) + hash_uniform(seed, F.lit(name), "cluster_id", "trial") * (hi - lo))

    kernel = F.element_at(F.array(*map(F.lit, KERNELS)), (hash_int(seed, F.lit("kernel"), "cluster_id", "trial") % 4 + 1).cast("int"))
    epsilon = hash_uniform(seed, F.lit("epsilon"), "cluster_id", "trial") if task == "reg" else F.lit(DEFAULT_EPSILON)
    return trials.select("cluster_id", "trial", kernel.alias("kernel"), log_uniform("c").alias("c"),
                         log_uniform("gamma").alias("gamma"), epsilon.alias("epsilon"))


def fold_scores(sums: DataFrame, task: str) -> DataFrame:
    """Score per (cluster, trial, fold): accuracy, or R2 from the held-out sums."""
    sst = F.col("sum_yy") - F.col("sum_y") * F.col("sum_y") / F.col("n")
    r2 = F.when(sst <= 1e-12 * F.abs(F.col("sum_yy")), (F.col("sse") == 0).cast("double")).otherwise(1 - F.col("sse") / sst)
    score = F.col("hits") / F.col("n") if task == "clf" else r2
    return sums.select("cluster_id", "trial", "fold", score.alias("score"))


def trial_scores(folds: DataFrame) -> DataFrame:
    return folds.groupBy("cluster_id", "trial").agg(F.avg("score").alias("score"))


def best_trials(scores: DataFrame) -> DataFrame:
    """Best mean score per cluster; ties go to the first trial."""
    return scores.groupBy("cluster_id").agg(
        F.max_by(F.struct("trial", "score"), F.struct("score", -F.col("trial"))).alias("b")).select(
        "cluster_id", "b.trial", F.col("b.score").alias("best_score"))


def good_trials(scores: DataFrame, share: float = 0.25) -> DataFrame:
    """Mark the best ceil(share * n) trials of each cluster."""
    from pyspark.sql.window import Window as W
    order = W.partitionBy("cluster_id").orderBy(F.col("score").desc(), "trial")
    total = F.count("*").over(W.partitionBy("cluster_id"))
    return scores.withColumn("good", F.row_number().over(order) <= F.greatest(F.lit(1), F.ceil(total * share)))


def _proposer(optimizer: str, task: str, trial: int, seed: int, space):
    choose = pr.by_gaussian_process if optimizer == "bayes" else pr.by_parzen_ratio

    def propose(history: pd.DataFrame) -> pd.DataFrame:
        """History holds one row per trial of one cluster, n_iter at most."""
        cluster = int(history["cluster_id"].iat[0])
        rng = np.random.default_rng([seed, cluster & 0xFFFFFFFF, trial])
        pool = pr.draw(rng, 256, space)
        if task == "clf":
            pool["epsilon"] = np.full(256, DEFAULT_EPSILON)
        seen = pr.encode(history["c"], history["gamma"], history["kernel"], history["epsilon"], space)
        score = history["score"].fillna(history["score"].min()).fillna(0.0).to_numpy()
        at = choose(seen, score, pr.encode(pool["c"], pool["gamma"], pool["kernel"], pool["epsilon"], space))
        return pd.DataFrame({"cluster_id": [cluster], "trial": [trial], "kernel": [pool["kernel"][at]], "c": [pool["c"][at]],
                             "gamma": [pool["gamma"][at]], "epsilon": [pool["epsilon"][at]]})

    return propose


def score_params(job: SvmJob, params: DataFrame) -> DataFrame:
    """Parameter table with its mean cross-validation score; a failed set scores NULL."""
    scores = trial_scores(fold_scores(job.cross_validate(params), job.task))
    return params.join(scores, ["cluster_id", "trial"], "left")


def tune(job: SvmJob, clusters: DataFrame, optimizer: str = "random", n_iter: int = 10, seed: int = SEED,
         n_initial: int = 5) -> tuple[DataFrame, DataFrame]:
    """(trials with scores, best parameters per cluster)."""
    if optimizer not in OPTIMIZERS:
        raise ValueError(f"optimizer must be one of {OPTIMIZERS}, not {optimizer!r}")
    if optimizer == "grid":
        trials = cut(score_params(job, grid_params(clusters, job.task)))
    elif optimizer == "random":
        trials = cut(score_params(job, random_params(clusters, n_iter, job.task, seed)))
    else:
        space = BAYES_SPACE if optimizer == "bayes" else RANDOM_SPACE
        start = min(n_initial, n_iter)
        trials = cut(score_params(job, random_params(clusters, start, job.task, seed, space)))
        for trial in range(start, n_iter):
            proposer = _proposer(optimizer, job.task, trial, seed, space)
            proposed = trials.groupBy("cluster_id").applyInPandas(
                proposer, "cluster_id int, trial int, kernel string, c double, gamma double, epsilon double")
            trials = cut(trials.unionByName(score_params(job, cut(proposed))))
    return trials, best_params(trials)


def best_params(trials: DataFrame) -> DataFrame:
    best = best_trials(trials.filter(F.col("score").isNotNull()).select("cluster_id", "trial", "score"))
    return best.join(trials.drop("score"), ["cluster_id", "trial"])
