"""Clusterers: objects with ``place(samples) -> Placed``. Anything with that method can stand in for them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import SEED, hash_int
from ..functions.ranking import dense_index, hash_rank
from ..sources.profile import fit_sample
from .lloyd import Centres, Fit, assign, fit_table, run_lloyd


class ClusterMethod(Enum):
    KMEANS = "kmeans"
    RANDOM = "random"
    FIFO = "fifo"


@dataclass
class Placed:
    """Outcome of a fit: the fitted rows with an INT column ``cluster``, and how to give it to other rows."""

    train: DataFrame
    assign: Callable[[DataFrame], DataFrame]
    fit: Centres | None = None


class Placer(Protocol):
    def place(self, samples: DataFrame) -> Placed: ...


@dataclass
class RandomSlices:
    """Random slices whose sizes differ by at most one; the first n mod k are the larger ones. Other rows fall anywhere."""

    k: int
    seed: int = SEED

    def place(self, samples: DataFrame) -> Placed:
        ranked = hash_rank(samples, [], ["row_id"], self.seed, out="__r", size_out="__size")
        at, base, extra = F.col("__r") - 1, F.floor(F.col("__size") / self.k), F.col("__size") % self.k
        large = extra * (base + 1)
        label = F.when(at < large, F.floor(at / (base + 1))).otherwise(extra + F.floor((at - large) / base))
        return Placed(ranked.withColumn("cluster", label.cast("int")).drop("__r", "__size"), self.anywhere)

    def anywhere(self, samples: DataFrame) -> DataFrame:
        return samples.withColumn("cluster", (hash_int(self.seed, "row_id") % self.k).cast("int"))


@dataclass
class RoundRobin:
    """Position modulo k, in ascending row id of any type."""

    k: int
    seed: int = SEED

    def place(self, samples: DataFrame) -> Placed:
        return Placed(self.in_turn(samples), self.in_turn)

    def in_turn(self, samples: DataFrame) -> DataFrame:
        placed = dense_index(samples, "row_id", "__p")
        return placed.withColumn("cluster", (F.col("__p") % self.k).cast("int")).drop("__p")


@dataclass
class KMeans:
    """k-means fitted on all rows, or on a share of large tables if ``fit_ratio`` says so, then applied to all."""

    k: int
    seed: int = SEED
    n_init: int = 10
    max_rounds: int = 300
    tol: float = 1e-6
    fit_ratio: float | None = None

    def place(self, samples: DataFrame) -> Placed:
        rows = samples if self.fit_ratio is None else fit_sample(samples, self.fit_ratio, seed=self.seed)
        grouped = rows.select(F.lit("all").alias("group"), "row_id", "idx", "val")
        width = int(samples.agg(F.max(F.array_max("idx"))).first()[0] or 0) + 1
        fits = fit_table(samples.sparkSession, [Fit("all", "all", self.k)])
        fit = run_lloyd(grouped, fits, width, self.n_init, self.max_rounds, self.tol, self.seed)
        place = lambda other: assign(other, fit, F.lit("all"))
        return Placed(place(samples), place, fit)


def single_cluster(samples: DataFrame) -> DataFrame:
    return samples.withColumn("cluster", F.lit(0))


def make_placer(method: str, k: int, seed: int = SEED) -> Placer:
    kinds = {ClusterMethod.KMEANS: KMeans, ClusterMethod.RANDOM: RandomSlices, ClusterMethod.FIFO: RoundRobin}
    return kinds[ClusterMethod(method)](k, seed)
