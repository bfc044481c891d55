"""Wrapper feature selection: a bee-swarm search over column masks guided by a Q table.

All bees of all clusters move together. Masks, fitness values and Q values are tables; one
step is a few small joins and one cross-validation job for the masks not scored before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.hashing import SEED, hash_int, hash_uniform
from ..session import cut
from .rows import once
from .svm import SvmJob
from .tuning import fold_scores, trial_scores

NEVER = float("-inf")


@dataclass
class SwarmOptions:
    bees: int = 20
    generations: int = 100
    elite: int = 5
    best: int = 10
    elite_bees: int = 4
    best_bees: int = 2
    elite_steps: int = 5
    best_steps: int = 3
    learning_rate: float = 0.1
    discount: float = 0.9
    explore: float = 0.1
    min_features: int = 5


def candidate_masks(shape: DataFrame, bees: int, min_features: int, seed=SEED, first: int = 0) -> DataFrame:
    """candidates(cluster_id, bee, mask): each column with probability one half, at least ``min_features``.

    Columns are ordered by one uniform draw; those below one half are in, and the lowest
    ``min_features`` are in whatever their value.
    """
    bee = shape.select("cluster_id", "d", F.explode(F.sequence(F.lit(first), F.lit(first + bees - 1))).alias("bee"))
    draws = F.transform(F.sequence(F.lit(0), F.col("d") - 1),
                        lambda f: F.struct(hash_uniform(seed, F.lit("mask"), "cluster_id", "bee", f).alias("u"), f.alias("f")))
    drawn = bee.withColumn("draws", draws)
    floor = F.get(F.array_sort("draws"), F.least(F.lit(min_features), F.col("d")) - 1)
    mask = once(floor, lambda limit: F.transform("draws", lambda x: (x["u"] < 0.5) | (x <= limit)))
    return drawn.select("cluster_id", "bee", mask.alias("mask"))


def mask_key(mask: str = "mask"):
    return F.array_join(F.transform(mask, lambda b: b.cast("int").cast("string")), "")


def rank_bees(scored: DataFrame, elite: int = 5, best: int = 10) -> DataFrame:
    """Rank by fitness within the cluster and name the site kind."""
    order = W.partitionBy("cluster_id").orderBy(F.col("fitness").desc(), "bee")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked.withColumn("site", F.when(F.col("rank") <= elite, "elite").when(F.col("rank") <= elite + best, "best").otherwise("other"))


class Fitness:
    """Cross-validation score per (cluster, mask), computed once per mask."""

    def __init__(self, job: SvmJob, seed=SEED):
        self.job, self.seed = job, seed
        spark = job.blocks.sparkSession
        self.known = spark.createDataFrame([], "cluster_id int, state string, fitness double")

    def of(self, masks: DataFrame) -> DataFrame:
        """masks plus ``state`` and ``fitness``; an empty or failing mask scores -inf."""
        keyed = masks.withColumn("state", mask_key())
        fresh = keyed.select("cluster_id", "state", "mask").dropDuplicates(["cluster_id", "state"]).join(
            self.known.select("cluster_id", "state"), ["cluster_id", "state"], "left_anti")
        number = F.row_number().over(W.partitionBy("cluster_id").orderBy("state")) - 1
        kernel = "linear" if self.job.task == "clf" else "rbf"
        params = cut(fresh.filter(F.array_contains("mask", True)).select(
            "cluster_id", "state", number.cast("int").alias("trial"), F.lit(kernel).alias("kernel"), F.lit(1.0).alias("c"),
            F.lit(None).cast("double").alias("gamma"), F.lit(0.1).alias("epsilon"), "mask"))
        scores = trial_scores(fold_scores(self.job.cross_validate(params.drop("state")), self.job.task))
        rated = params.select("cluster_id", "state", "trial").join(scores, ["cluster_id", "trial"], "left")
        empty = fresh.filter(~F.array_contains("mask", True)).select("cluster_id", "state", F.lit(NEVER).alias("fitness"))
        self.known = cut(self.known.unionByName(rated.select(
            "cluster_id", "state", F.coalesce("score", F.lit(NEVER)).alias("fitness"))).unionByName(empty))
        return keyed.join(self.known, ["cluster_id", "state"])


def propose_flips(bees: DataFrame, q: DataFrame, turn: str, explore: float, seed=SEED) -> DataFrame:
    """One flip per bee: the best known action of its state, or a random one with probability ``explore``."""
    best = q.groupBy("cluster_id", "state").agg(F.max_by("action", F.struct("value", -F.col("action"))).alias("known_action"))
    met = bees.join(best, ["cluster_id", "state"], "left")
    lucky = hash_uniform(seed, F.lit(turn), F.lit("explore"), "cluster_id", "bee") < explore
    random = (hash_int(seed, F.lit(turn), F.lit("action"), "cluster_id", "bee") % F.size("mask")).cast("int")
    action = F.when(lucky | F.col("known_action").isNull(), random).otherwise(F.col("known_action"))
    flipped = once(action, lambda at: F.transform("mask", lambda b, i: F.when(i == at, ~b).otherwise(b)))
    return met.withColumn("next_mask", flipped).withColumn("action", action).drop("known_action")


def update_q(q: DataFrame, moves: DataFrame, rate: float, discount: float) -> DataFrame:
    """moves(cluster_id, state, action, reward, next_state): one Q-learning update per distinct move."""
    ahead = q.groupBy("cluster_id", F.col("state").alias("next_state")).agg(F.max("value").alias("ahead"))
    distinct = moves.dropDuplicates(["cluster_id", "state", "action"])
    met = distinct.join(ahead, ["cluster_id", "next_state"], "left").join(q, ["cluster_id", "state", "action"], "left")
    old = F.coalesce("value", F.lit(0.0))
    new = old + rate * (F.col("reward") + discount * F.coalesce("ahead", F.lit(0.0)) - old)
    changed = met.select("cluster_id", "state", "action", new.alias("value"))
    return q.join(changed.select("cluster_id", "state", "action"), ["cluster_id", "state", "action"], "left_anti").unionByName(changed)


def select_features(job: SvmJob, shape: DataFrame, options: SwarmOptions | None = None, seed=SEED) -> DataFrame:
    """Best mask per cluster: cluster_id, mask, fitness. ``shape``: cluster_id, d."""
    o = options or SwarmOptions()
    spark = shape.sparkSession
    fitness = Fitness(job, seed)
    q = spark.createDataFrame([], "cluster_id int, state string, action int, value double")
    bees = candidate_masks(shape, o.bees, o.min_features, seed)
    best = None
    for generation in range(o.generations):
        scored = cut(fitness.of(bees).select("cluster_id", "bee", "mask", "state", "fitness"))
        best = cut(_keep_best(scored, best))
        if generation == o.generations - 1:
            break
        ranked = rank_bees(scored, o.elite, o.best)
        recruits = ranked.filter("site != 'other'").select(
            "cluster_id", "rank", "mask", "state", "fitness",
            F.when(F.col("site") == "elite", o.elite_steps).otherwise(o.best_steps).alias("steps"),
            F.explode(F.when(F.col("site") == "elite", F.sequence(F.lit(1), F.lit(o.elite_bees)))
                      .otherwise(F.sequence(F.lit(1), F.lit(o.best_bees)))).alias("follower"))
        bee = F.row_number().over(W.partitionBy("cluster_id").orderBy("rank", "follower")) - 1
        moving = cut(recruits.withColumn("bee", bee).drop("rank", "follower"))
        for step in range(max(o.elite_steps, o.best_steps)):
            turn = f"{generation}/{step}"
            flips = cut(propose_flips(moving.filter(F.col("steps") > step), q, turn, o.explore, seed))
            rated = fitness.of(flips.select("cluster_id", "bee", F.col("next_mask").alias("mask"))).select(
                "cluster_id", "bee", F.col("state").alias("next_state"), F.col("fitness").alias("next_fitness"))
            moves = cut(flips.join(rated, ["cluster_id", "bee"]).withColumn("reward", F.col("next_fitness") - F.col("fitness")))
            q = cut(update_q(q, moves.filter(F.col("next_fitness") > NEVER).select("cluster_id", "state", "action", "reward", "next_state"),
                             o.learning_rate, o.discount))
            better = F.col("next_fitness") > F.col("fitness")
            moved = moves.select(
                "cluster_id", "bee", "steps", F.when(better, F.col("next_mask")).otherwise(F.col("mask")).alias("mask"),
                F.when(better, F.col("next_state")).otherwise(F.col("state")).alias("state"),
                F.greatest("fitness", "next_fitness").alias("fitness"))
            moving = cut(moved.unionByName(moving.filter(F.col("steps") <= step).select(*moved.columns)))
        recruited = o.elite * o.elite_bees + o.best * o.best_bees
        bees = moving.select("cluster_id", "bee", "mask")
        if o.bees > recruited:
            scouts = candidate_masks(shape, o.bees - recruited, o.min_features, f"{seed}/{generation}", first=recruited)
            bees = bees.unionByName(scouts.select("cluster_id", F.col("bee"), "mask"))
    return best


def _keep_best(scored: DataFrame, best: DataFrame | None) -> DataFrame:
    order = F.struct("fitness", -F.col("bee"))
    top = scored.groupBy("cluster_id").agg(F.max_by(F.struct("mask", "fitness"), order).alias("b")).select(
        "cluster_id", "b.mask", "b.fitness")
    if best is None:
        return top
    old = best.withColumnsRenamed({"mask": "old_mask", "fitness": "old_fitness"})
    met = top.join(old, "cluster_id", "left")
    rises = F.col("old_fitness").isNull() | (F.col("fitness") > F.col("old_fitness"))
    return met.select("cluster_id", F.when(rises, F.col("mask")).otherwise(F.col("old_mask")).alias("mask"),
                      F.when(rises, F.col("fitness")).otherwise(F.col("old_fitness")).alias("fitness"))


def as_selection(best: DataFrame) -> DataFrame:
    """(cluster_id, in_feature, out_feature) of the chosen masks."""
    on = best.select("cluster_id", F.posexplode("mask").alias("in_feature", "on")).filter("on")
    number = F.row_number().over(W.partitionBy("cluster_id").orderBy("in_feature")) - 1
    return on.select("cluster_id", "in_feature", number.cast("int").alias("out_feature"))
