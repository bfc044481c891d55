"""Choosing the number of clusters: silhouette and gap statistic, all k in the same jobs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.hashing import SEED, hash_uniform
from ..functions.ranking import sample_threshold, sort_key
from ..session import cut
from .lloyd import Centres, Fit, assign, fit_table, run_lloyd

BLOCK_ROWS = 2048
COLUMN_CHUNK = 1024
PARTS = 512                 # of the blocks, at most; a task takes one of them
BESIDE = 4                  # parts read past it together
SUM_BYTES = 64 << 20        # of distance sums that a task holds before it hands them on


def silhouette_sample(samples: DataFrame, size: int, seed: int = SEED) -> DataFrame:
    """Exactly ``size`` rows in hash order, or all if there are no more."""
    limit = sample_threshold(samples, ["row_id"], size, seed)
    return samples.filter(sort_key(["row_id"], seed) <= limit)


def _sparse(idx, val):
    """(rows, columns, values, order by column) of two Arrow lists of lists."""
    rows = np.repeat(np.arange(len(idx)), np.asarray(idx.value_lengths().fill_null(0)))
    columns, values = np.asarray(idx.flatten()).astype(np.int64), np.asarray(val.flatten()).astype(float)
    order = np.argsort(columns, kind="stable")
    return len(idx), rows[order], columns[order], values[order]


def _distances(a, b) -> np.ndarray:
    """Euclidean distances of all rows of one block to all of another, some columns at a time."""
    product = np.zeros((a[0], b[0]))
    shared = np.intersect1d(a[2], b[2])
    for start in range(0, len(shared), COLUMN_CHUNK):
        some = shared[start:start + COLUMN_CHUNK]
        sides = []
        for n, rows, columns, values in (a, b):
            low, high = np.searchsorted(columns, some[0]), np.searchsorted(columns, some[-1], "right")
            at = np.minimum(np.searchsorted(some, columns[low:high]), len(some) - 1)
            hit = some[at] == columns[low:high]
            dense = np.zeros((n, len(some)))
            dense[rows[low:high][hit], at[hit]] = values[low:high][hit]
            sides.append(dense)
        product += sides[0] @ sides[1].T
    own, other = (np.bincount(x[1], x[3] ** 2, minlength=x[0]) for x in (a, b))
    product *= -2
    product += own[:, None]
    product += other[None, :]
    return np.sqrt(np.maximum(product, 0.0, out=product), out=product)


def _codes(labels, domain):
    """Column of each row in the table of all (fit, label), by fit; and where each fit's columns begin."""
    flat = np.asarray(labels.flatten()).reshape(len(labels), -1)
    known = [np.array([e["label"] for e in d["e"]]) for d in domain]
    starts = np.cumsum([0] + [len(k) for k in known])
    return np.stack([starts[f] + np.searchsorted(k, flat[:, f]) for f, k in enumerate(known)], axis=1), starts


def _pair_sums(batches):
    """Kernel: for each pair of blocks the first one's distances to the rows of the second, summed by (fit, label)."""
    held: dict = {}
    own = first = None

    def out():
        keys = list(held)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([held[k].ravel() for k in keys], pa.list_(pa.float64()))], names=["block", "sums"])

    for batch in batches:
        domain = batch.column("domain")[0].as_py()
        for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
            if a != own:
                own, first = a, _sparse(batch.column("a_idx")[i].values, batch.column("a_val")[i].values)
            second = first if a == b else _sparse(batch.column("b_idx")[i].values, batch.column("b_val")[i].values)
            codes, starts = _codes(batch.column("b_labels")[i].values, domain)
            member = np.zeros((len(codes), starts[-1]))
            member[np.arange(len(codes))[:, None], codes] = 1.0
            away = _distances(first, second)
            if a == b:
                np.fill_diagonal(away, 0.0)
            held[a] = held[a] + away @ member if a in held else away @ member
            if sum(v.nbytes for v in held.values()) > SUM_BYTES:
                yield out()
                held.clear()
    if held:
        yield out()


def _row_scores(batches):
    """Kernel: blocks with their rows' distance sums to the total silhouette of each fit."""
    for batch in batches:
        for i, row in enumerate(batch.select(["domain", "sums"]).to_pylist()):
            codes, starts = _codes(batch.column("labels")[i].values, row["domain"])
            sums = np.array(row["sums"]).reshape(len(codes), -1)
            at = np.arange(len(codes))
            for f, d in enumerate(row["domain"]):
                counts = np.array([e["n"] for e in d["e"]], float)
                own = codes[:, f] - starts[f]
                mine = sums[:, starts[f]:starts[f + 1]]
                size = counts[own]
                a = mine[at, own] / np.maximum(size - 1, 1)
                other = mine / counts
                other[at, own] = np.inf
                b = other.min(1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    s = np.where(size > 1, (b - a) / np.maximum(a, b), 0.0)
                yield pa.RecordBatch.from_pydict({"fit": pa.array([f], pa.int32()), "n": pa.array([len(at)], pa.int64()), "total": pa.array([float(np.nan_to_num(s).sum())])})


def silhouette(labelled: DataFrame, names: list[str]) -> DataFrame:
    """(name, score): mean Euclidean silhouette of all rows under each labelling. One label everywhere scores -1.

    ``labelled``: row_id, idx, val, labels ARRAY<INT> (one entry per name). The rows are dealt into blocks that are written
    once. A task takes a part of the blocks and reads all others past them, so no pair of blocks is shuffled or stored; the
    distance sums of a row go on when they are whole. The work grows with the square of the rows, so draw a
    ``silhouette_sample`` of large tables.
    """
    spark = labelled.sparkSession
    labelled = labelled.select("row_id", "idx", "val", "labels")
    n, cores = labelled.count(), spark.sparkContext.defaultParallelism
    count = max(1, -(-n // BLOCK_ROWS), min(cores, n // 128))
    parts = min(count, PARTS)
    dealt = labelled.withColumn("block", F.pmod(F.xxhash64("row_id"), F.lit(count)).cast("int")).repartition(parts, "block").groupBy("block")
    dealt = dealt.agg(F.collect_list(F.struct("idx", "val", "labels")).alias("e"))
    blocks = cut(dealt.select("block", "e.idx", "e.val", "e.labels"))       # rows must keep their places
    each = blocks.select(F.explode("labels").alias("l")).select(F.posexplode("l").alias("fit", "label"))
    domain = each.groupBy("fit", "label").agg(F.count("*").alias("n")).groupBy("fit").agg(F.sort_array(F.collect_list(F.struct("label", "n"))).alias("e"))
    domain = cut(domain.agg(F.sort_array(F.collect_list(F.struct("fit", "e"))).alias("domain")).withColumn("one", F.lit(0)))    # a row of all labels

    def side(name, *columns):
        return blocks.select(F.col("block").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])

    # The product's parts come row by row, so that joining neighbours gives each task a part of the blocks and all others.
    others = side("b", "idx", "val", "labels").coalesce(max(1, parts // BESIDE))
    pairs = side("a", "idx", "val").crossJoin(others.hint("shuffle_replicate_nl")).coalesce(parts).withColumn("one", F.lit(0))
    sums = pairs.join(F.broadcast(domain), "one").drop("one").mapInArrow(_pair_sums, "block int, sums array<double>")
    sums = sums.groupBy("block").agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("sums")))).alias("sums"))
    met = blocks.select("block", "labels").join(sums, "block").withColumn("one", F.lit(0)).join(F.broadcast(domain), "one")
    scored = met.select("domain", "labels", "sums").mapInArrow(_row_scores, "fit int, n bigint, total double")
    scored = scored.groupBy("fit").agg((F.sum("total") / F.sum("n")).alias("score"))
    labels = domain.select(F.explode("domain").alias("d")).select("d.fit", F.size("d.e").alias("labels"))
    named = spark.createDataFrame(list(enumerate(names)), "fit int, name string")
    return named.join(scored, "fit").join(labels, "fit").select("name", F.when(F.col("labels") == 1, -1.0).otherwise(F.col("score")).alias("score"))


def fit_many(samples: DataFrame, ks: list[int], n_init: int, max_rounds: int, seed: int, tol: float = 1e-6) -> Centres:
    width = int(samples.agg(F.max(F.array_max("idx"))).first()[0] or 0) + 1
    grouped = samples.select(F.lit("all").alias("group"), "row_id", "idx", "val")
    return run_lloyd(grouped, fit_table(samples.sparkSession, [Fit(str(k), "all", k) for k in ks]), width, n_init, max_rounds, tol, seed=seed)


def silhouette_scan(samples: DataFrame, ks: list[int], n_init: int = 10, max_rounds: int = 300, seed: int = SEED,
                    size: int | None = None) -> tuple[DataFrame, Centres]:
    """k_scores(k, score) for all k at once, and the fits. ``size`` scores a sample of so many rows."""
    fits = fit_many(samples, ks, n_init, max_rounds, seed)
    scored = samples if size is None else silhouette_sample(samples, size, seed)
    labelled = assign(scored, fits, F.lit("all"), "labels", [str(k) for k in ks])
    scores = silhouette(labelled, [str(k) for k in ks])
    return scores.select(F.col("name").cast("int").alias("k"), "score"), fits


def best_k(k_scores: DataFrame) -> DataFrame:
    """Highest score; ties go to the smallest k."""
    return k_scores.orderBy(F.col("score").desc(), F.col("k")).limit(1)


def dispersion(labelled: DataFrame, centres: DataFrame) -> DataFrame:
    """Squared distance to the own centre per cluster with more than one row.

    ``labelled``: row_id, cluster, idx, val. ``centres``: cluster, feature, value. Uses
    |x|^2 + |c|^2 - 2 x.c, so only the rows' own cells meet the centre table.
    """
    cells = labelled.select("cluster", F.explode(F.arrays_zip("idx", "val")).alias("c")).select(
        "cluster", F.col("c.idx").alias("feature"), F.col("c.val").alias("value"))
    # Sums per (cluster, feature) first: the centre then meets one row per feature.
    sums = cells.groupBy("cluster", "feature").agg(F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("ss"))
    met = sums.join(centres.withColumnRenamed("value", "at"), ["cluster", "feature"], "left")
    moved = met.groupBy("cluster").agg(F.sum(F.col("ss") - 2 * F.col("s") * F.coalesce("at", F.lit(0.0))).alias("moved"))
    own = centres.groupBy("cluster").agg(F.sum(F.col("value") ** 2).alias("centre_sq"))
    sizes = labelled.groupBy("cluster").agg(F.count("*").alias("n"))
    return sizes.filter("n > 1").join(own, "cluster", "left").join(moved, "cluster", "left").select(
        "cluster", "n",
        (F.coalesce("moved", F.lit(0.0)) + F.col("n") * F.coalesce("centre_sq", F.lit(0.0))).alias("dispersion"))


def reference_rows(samples: DataFrame, width: int, n_refs: int, seed: int = SEED) -> DataFrame:
    """Uniform rows with the shape and density of the samples, one independent set per reference.

    Every reference row has the same number of cells, at stratified random positions.
    """
    stats = samples.agg(F.count("*").alias("n"), F.sum(F.size("idx")).alias("nnz")).first()
    per_row = max(1, round(stats["nnz"] / max(1, stats["n"])))
    refs = samples.sparkSession.range(stats["n"] * n_refs).select(
        (F.col("id") % n_refs).cast("int").alias("ref"), F.floor(F.col("id") / n_refs).alias("row_id"))
    slot = F.sequence(F.lit(0), F.lit(per_row - 1))
    place = F.transform(slot, lambda j: F.floor((j + hash_uniform(seed, F.lit("at"), "ref", "row_id", j)) * width / per_row).cast("int"))
    value = F.transform(slot, lambda j: hash_uniform(seed, F.lit("value"), "ref", "row_id", j))
    return refs.select("ref", "row_id", place.alias("idx"), value.alias("val"))


def gap_scan(samples: DataFrame, ks: list[int], n_refs: int = 10, n_init: int = 10, max_rounds: int = 300,
             seed: int = SEED) -> DataFrame:
    """k_gap(k, gap, sk): every (k, reference) and (k, data) fit runs in one loop."""
    width = int(samples.agg(F.max(F.array_max("idx"))).first()[0] or 0) + 1
    refs = reference_rows(samples, width, n_refs, seed)
    rows = samples.select(F.lit("data").alias("group"), F.col("row_id").cast("string").alias("row_id"), "idx", "val").unionByName(
        refs.select(F.concat(F.lit("ref"), "ref").alias("group"), F.col("row_id").cast("string").alias("row_id"), "idx", "val"))
    groups = ["data"] + [f"ref{b}" for b in range(n_refs)]
    planned = fit_table(samples.sparkSession, [Fit(f"{g}/{k}", g, k) for g in groups for k in ks])
    fits = run_lloyd(rows, planned, width, n_init, max_rounds, seed=seed)
    number = F.element_at(F.split("fit_id", "/"), -1).cast("int")
    within = fits.table.filter("n > 1").groupBy(F.col("group").alias("source"), number.alias("k")).agg(F.sum("error").alias("within"))
    return gap_table(within, n_refs)


def gap_table(within: DataFrame, n_refs: int) -> DataFrame:
    """Gap and its error from within-cluster dispersions per source ('data' or a reference)."""
    is_ref = F.col("source") != "data"
    logs = within.withColumn("l", F.log("within"))
    return logs.groupBy("k").agg(
        (F.avg(F.when(is_ref, F.col("l"))) - F.max(F.when(~is_ref, F.col("l")))).alias("gap"),
        (F.stddev_pop(F.when(is_ref, F.col("l"))) * F.sqrt(F.lit(1 + 1 / n_refs))).alias("sk"))


def best_k_by_gap(k_gap: DataFrame) -> DataFrame:
    """Smallest k with gap(k) >= gap(k+1) - sk(k+1); the first k if none qualifies."""
    order = W.orderBy("k")
    following = k_gap.select("k", "gap", F.lead("gap").over(order).alias("g"), F.lead("sk").over(order).alias("s"))
    fits = F.when(F.col("gap") >= F.col("g") - F.col("s"), F.col("k"))
    return following.agg(F.coalesce(F.min(fits), F.min("k")).alias("k"))


def find_k(samples: DataFrame, ks: list[int], method: str = "silhouette", seed: int = SEED, **options) -> tuple[int, DataFrame]:
    """Best k and the score table of the scan."""
    if method == "silhouette":
        scores, _ = silhouette_scan(samples, ks, seed=seed, **options)
        return best_k(scores).first()["k"], scores
    if method == "gap":
        scores = gap_scan(samples, ks, seed=seed, **options)
        return best_k_by_gap(scores).first()["k"], scores
    raise ValueError(f"method must be silhouette or gap, not {method!r}")


def save_scores(table: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a score table (k search, independence scores)."""
    writer = table.write.mode("overwrite").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)
