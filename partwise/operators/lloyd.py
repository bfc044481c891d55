"""Many k-means fits in one loop of Spark jobs, with the centres as tables.

A fit belongs to a group of rows and has its own k; a group may have many fits and a fit many
starts. Rows are packed into blocks once and stay where they are. Centres are rows (fit, centre);
for a round they are packed into parcels of bounded size and joined to the blocks of their group.
Every task sums its own rows per centre, a shuffle adds the sums and they become the next table
of centres. Only the number of fits that still move comes back to the driver.

Parcels are broadcast as long as they take TURN_BYTES together. Beyond that the blocks meet them
in turns of that size, and the nearest centre of each turn competes with those of the others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window as W

from ..functions.dense import row_chunks, squared_distances
from ..functions.hashing import SEED, hash_key
from ..functions.ranking import first_by_hash
from ..session import BROADCAST_BYTES, cut

PARCEL_BYTES = 16 << 20      # of centres in one row, about (a row can take twice that)
TURN_BYTES = BROADCAST_BYTES
SUM_BYTES = 64 << 20         # of sums that a task holds before it hands them on
FEW = 64                     # centres whose distances are all computed

STATE = ["fit_id", "of", "start", "group", "part", "turn", "centre", "c"]
PAIRS = "fit_id string, centre int, n bigint, error double, total array<double>"


@dataclass(frozen=True)
class Fit:
    fit_id: str
    group: str
    k: int


def fit_table(spark, fits: list[Fit]) -> DataFrame:
    return spark.createDataFrame([(f.fit_id, f.group, f.k) for f in fits], "fit_id string, group string, k int")


@dataclass(frozen=True)
class Centres:
    """Fitted centres: fit_id, group, part, turn, centre, c ARRAY<DOUBLE>, and of the rows nearest to each: n and
    error (squared distances, summed)."""

    table: DataFrame
    width: int
    turns: int
    whole: bool      # no fit has centres in two parcels

    def cells(self) -> DataFrame:
        """(fit_id, centre, feature, value) of all non-zero entries."""
        each = self.table.select("fit_id", "centre", F.posexplode("c").alias("feature", "value"))
        return each.filter(F.col("value") != 0)

    def only(self, fit_ids: list[str]) -> Centres:
        return Centres(self.table.filter(F.col("fit_id").isin(fit_ids)), self.width, self.turns, self.whole)


# -- rows in blocks -----------------------------------------------------------------------------

def pack(rows: DataFrame, group: str) -> DataFrame:
    """Rows packed where they are: one row per Arrow batch and group, (group, block) and every other column as a list."""
    rest = [c for c in rows.columns if c != group]

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(group)).dictionary_encode()
            codes = keys.indices.fill_null(len(keys.dictionary)).to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            for code in np.unique(codes):
                mine = batch.take(pa.array(order[np.searchsorted(codes[order], code):np.searchsorted(codes[order], code, "right")]))
                ends = pa.array([0, mine.num_rows], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, mine.column(mine.schema.get_field_index(c))) for c in rest]
                yield pa.RecordBatch.from_arrays([mine.column(mine.schema.get_field_index(group)).slice(0, 1), pa.array([block]), *lists], names=[group, "block", *rest])
                block += 1

    schema = StructType([rows.schema[group], StructField("block", LongType()), *[StructField(c, ArrayType(rows.schema[c].dataType)) for c in rest]])
    return rows.mapInArrow(run, schema)


def dense_lists(idx, val, width: int) -> np.ndarray:
    """Dense rows from two Arrow lists of lists; indices past the width are unseen features."""
    lengths = np.asarray(idx.value_lengths().fill_null(0))
    rows = np.repeat(np.arange(len(idx)), lengths)
    columns = np.asarray(idx.flatten()).astype(np.int64)
    values = np.asarray(val.flatten()).astype(float)
    out = np.zeros((len(idx), width))
    seen = columns < width
    out[rows[seen], columns[seen]] = values[seen]
    return out


def parcels(state: DataFrame) -> DataFrame:
    """Centres of one part in one row: (group, part, turn, fits, centres, flat), in order of fit and centre."""
    entry = F.sort_array(F.collect_list(F.struct("fit_id", "centre", "c"))).alias("e")
    packed = state.groupBy("group", "part", "turn").agg(entry)
    return packed.select("group", "part", "turn", F.col("e.fit_id").alias("fits"), F.col("e.centre").alias("centres"), F.flatten("e.c").alias("flat"))


def read_parcel(row: dict, width: int):
    """(fit, centre numbers, centres) of each fit in a parcel."""
    names = np.array(row["fits"], object)
    numbers = np.array(row["centres"], np.int32)
    points = np.asarray(row["flat"], float).reshape(len(names), width)
    cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
    return [(names[a], numbers[a:b], points[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


# -- distances ------------------------------------------------------------------------------------

class Points:
    """Centres of one fit in groups around pivots.

    By the triangle inequality a centre of a group with radius r is at least |x - pivot| - r away from x, so only
    rows that are nearer to a pivot than that look at its group.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        self.groups = None
        if len(points) > FEW:
            pivots = np.unique(np.linspace(0, len(points) - 1, int(np.sqrt(len(points))) + 1).astype(int))
            owner = squared_distances(points, points[pivots]).argmin(1)
            away = np.sqrt(((points - points[pivots[owner]]) ** 2).sum(1))
            self.pivots = pivots
            self.groups = [np.flatnonzero(owner == g) for g in range(len(pivots))]
            self.radii = np.array([away[m].max(initial=0.0) for m in self.groups])
            self.measured = 0

    def nearest(self, block: np.ndarray) -> np.ndarray:
        """Place of the nearest centre; of equal ones the first."""
        if self.groups is None:
            return squared_distances(block, self.points).argmin(1)
        to_pivot = np.sqrt(squared_distances(block, self.points[self.pivots]))
        first = to_pivot.argmin(1)
        best, place = to_pivot[np.arange(len(block)), first] ** 2, self.pivots[first]
        for g in np.argsort(to_pivot.mean(0)):
            least = to_pivot[:, g] - self.radii[g]
            rows = np.flatnonzero((least <= 0) | (least ** 2 <= best * (1 + 1e-9) + 1e-12))
            if len(rows) and len(self.groups[g]):
                self.measured += len(rows) * len(self.groups[g])
                away = squared_distances(block[rows], self.points[self.groups[g]])
                at = away.argmin(1)
                found, where = away[np.arange(len(rows)), at], self.groups[g][at]
                closer = (found < best[rows]) | ((found == best[rows]) & (where < place[rows]))
                best[rows[closer]], place[rows[closer]] = found[closer], where[closer]
        return place


def placed(idx, val, width: int, fits: list):
    """For each fit of a parcel the rows' nearest centres (places) and squared distances, chunk by chunk of rows:
    (dense rows, slice, [(fit, numbers, places, distances)])."""
    known = [(name, numbers, points, Points(points)) for name, numbers, points in fits]
    for piece in row_chunks(len(idx), width):
        block = dense_lists(idx[piece], val[piece], width)
        out = []
        for name, numbers, points, search in known:
            at = search.nearest(block)
            out.append((name, numbers, at, ((block - points[at]) ** 2).sum(1)))
        yield block, piece, out


# -- one round ------------------------------------------------------------------------------------

class Sums:
    """Counts, errors and vector sums by (fit, centre), handed on when they take SUM_BYTES."""

    def __init__(self):
        self.held, self.size = {}, 0

    def add(self, name, numbers, at, away, block):
        k = int(at.max()) + 1 if len(at) else 0
        member = np.zeros((len(block), k))
        member[np.arange(len(block)), at] = 1.0
        live = np.flatnonzero(member.any(0))
        member = member[:, live]
        for j, n, error, total in zip(numbers[live].tolist(), member.sum(0), member.T @ away, member.T @ block, strict=True):
            old = self.held.get((name, j))
            if old is None:
                self.held[name, j] = [int(n), float(error), total.copy()]
                self.size += total.nbytes
            else:
                old[0] += int(n)
                old[1] += float(error)
                old[2] += total

    def full(self) -> bool:
        return self.size > SUM_BYTES

    def batch(self) -> pa.RecordBatch:
        names, counts = list(zip(*self.held, strict=True)), list(zip(*self.held.values(), strict=True))
        flat = np.concatenate(counts[2])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(t) for t in counts[2]])], pa.int32()), pa.array(flat))
        self.held, self.size = {}, 0
        return pa.RecordBatch.from_arrays([pa.array(names[0]), pa.array(names[1], pa.int32()), pa.array(counts[0], pa.int64()), pa.array(counts[1]), lists],
                                          names=["fit_id", "centre", "n", "error", "total"])


def _sum_whole(width: int):
    """Kernel: (block, parcel) rows to sums, where each fit is whole in its parcel."""
    def run(batches):
        sums = Sums()
        for batch in batches:
            idx, val = batch.column("idx"), batch.column("val")
            for i, parcel in enumerate(batch.select(["fits", "centres", "flat"]).to_pylist()):
                for block, _, out in placed(idx[i].values, val[i].values, width, read_parcel(parcel, width)):
                    for name, numbers, at, away in out:
                        sums.add(name, numbers, at, away, block)
                if sums.full():
                    yield sums.batch()
        if sums.held:
            yield sums.batch()

    return run


def _best_of_part(width: int):
    """Kernel: (block, parcel) rows to each fit's nearest centre in this parcel, (block, fit_id, away, centre) with lists."""
    def run(batches):
        for batch in batches:
            idx, val = batch.column("idx"), batch.column("val")
            for i, parcel in enumerate(batch.select(["block", "fits", "centres", "flat"]).to_pylist()):
                found: dict = {}
                for _, _, out in placed(idx[i].values, val[i].values, width, read_parcel(parcel, width)):
                    for name, numbers, at, away in out:
                        found.setdefault(name, ([], []))
                        found[name][0].append(away)
                        found[name][1].append(numbers[at])
                if found:
                    yield pa.RecordBatch.from_pydict({
                        "block": pa.array([parcel["block"]] * len(found)), "fit_id": pa.array(list(found)),
                        "away": pa.array([np.concatenate(a) for a, _ in found.values()], pa.list_(pa.float64())),
                        "centre": pa.array([np.concatenate(c) for _, c in found.values()], pa.list_(pa.int32()))})

    return run


def _least(group):
    """The nearest of all parcels for each row of a block; of equal ones the lowest centre."""
    away = np.stack([np.asarray(x) for x in group.column("away").to_pylist()])
    centre = np.stack([np.asarray(x) for x in group.column("centre").to_pylist()])
    at = np.lexsort((centre, away), axis=0)[0]
    rows = np.arange(away.shape[1])
    return pa.table({"block": group.column("block").slice(0, 1), "fit_id": group.column("fit_id").slice(0, 1),
                     "away": pa.array([away[at, rows]], pa.list_(pa.float64())), "centre": pa.array([centre[at, rows]], pa.list_(pa.int32()))})


BEST = "block bigint, fit_id string, away array<double>, centre array<int>"


def best_places(blocks: DataFrame, state: DataFrame, width: int, turns: int) -> DataFrame:
    """(block, fit_id, away, centre) over any number of parcels, TURN_BYTES of them at a time. Blocks must be fixed."""
    every = None
    packed = cut(parcels(state))
    for turn in range(turns):
        met = blocks.join(F.broadcast(packed.filter(F.col("turn") == turn)), "group")
        found = met.select("block", "idx", "val", "fits", "centres", "flat").mapInArrow(_best_of_part(width), BEST)
        every = found if every is None else every.unionByName(found)
    return every.groupBy("block", "fit_id").applyInArrow(_least, BEST)


def _sum_placed(width: int):
    """Kernel: blocks with known places to sums."""
    def run(batches):
        sums = Sums()
        for batch in batches:
            idx, val = batch.column("idx"), batch.column("val")
            for i, row in enumerate(batch.select(["fit_id", "away", "centre"]).to_pylist()):
                away, centre = np.array(row["away"]), np.array(row["centre"])
                for piece in row_chunks(len(away), width):
                    block = dense_lists(idx[i].values[piece], val[i].values[piece], width)
                    numbers, at = np.unique(centre[piece], return_inverse=True)
                    sums.add(row["fit_id"], numbers, at, away[piece], block)
                    if sums.full():
                        yield sums.batch()
        if sums.held:
            yield sums.batch()

    return run


def measured(blocks: DataFrame, state: DataFrame, width: int, turns: int, whole: bool) -> DataFrame:
    """The state with n and error of each centre, where its rows' mean lies (``moved``) and how far off that is. An empty
    cluster keeps its centre."""
    if whole and turns == 1:
        met = blocks.join(F.broadcast(parcels(together(state, turns))), "group")
        partial = met.select("idx", "val", "fits", "centres", "flat").mapInArrow(_sum_whole(width), PAIRS)
    else:
        best = best_places(blocks, state, width, turns)
        partial = blocks.select("block", "idx", "val").join(best, "block").select("fit_id", "away", "centre", "idx", "val").mapInArrow(_sum_placed(width), PAIRS)
    # old centres and new sums meet in the shuffle that adds the sums
    old = state.select(*STATE, F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("error"), F.transform("c", lambda v: F.lit(0.0)).alias("total"))
    every = old.unionByName(partial, allowMissingColumns=True)
    kept = [F.first(c, ignorenulls=True).alias(c) for c in STATE if c not in ("fit_id", "centre")]
    joined = every.groupBy("fit_id", "centre").agg(*kept, F.sum("n").alias("n"), F.sum("error").alias("error"),
                                                   vector_to_array(Summarizer.sum(array_to_vector(F.col("total")))).alias("total"))
    moved = F.when(F.col("n") == 0, F.col("c")).otherwise(F.transform("total", lambda v: v / F.col("n")))
    joined = joined.select(*STATE, "n", "error", moved.alias("moved"))
    return joined.withColumn("shift", F.array_max(F.zip_with("moved", "c", lambda a, b: F.abs(a - b))))


def together(state: DataFrame, turns: int) -> DataFrame:
    """Centres of one turn (TURN_BYTES at most) in one partition, so that packing and comparing them needs no shuffle."""
    return state.coalesce(1) if turns == 1 else state


# -- fits -----------------------------------------------------------------------------------------

def plan_parcels(fits: DataFrame, width: int, n_init: int) -> tuple[DataFrame, int, bool]:
    """(fit_id, of, start, group, k, low, high, part, turn): which centres of each start lie in which parcel; the
    number of turns, and whether every fit is in one parcel. Only numbers per fit are looked at."""
    per = max(1, PARCEL_BYTES // (8 * width))
    starts = fits.withColumnRenamed("fit_id", "of").withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(n_init - 1))))
    starts = starts.withColumn("fit_id", F.concat("of", F.lit("#"), "start"))
    before = F.sum("k").over(W.partitionBy("group").orderBy("of", "start")) - F.col("k")
    large = F.col("k") > per
    cut_at = F.when(large, F.sequence(F.lit(0), F.col("k") - 1, F.lit(per))).otherwise(F.array(F.lit(0)))
    own = F.concat_ws("/", "group", F.when(large, F.concat_ws("/", "fit_id", "low")).otherwise(F.floor(F.col("before") / per).cast("string")))
    parts = starts.withColumn("before", before).withColumn("low", F.explode(cut_at)).withColumn("part", own)
    parts = parts.withColumn("high", F.least(F.col("low") + (F.when(large, per).otherwise(F.col("k"))), F.col("k")))
    total, most = fits.agg(F.sum("k"), F.max("k")).first()
    whole = (most or 0) <= per
    if (total or 0) * n_init * 8 * width <= TURN_BYTES:
        return parts.withColumn("turn", F.lit(0)).drop("before"), 1, whole
    sizes = parts.groupBy("part").agg(F.sum(F.col("high") - F.col("low")).alias("size"))
    upto = F.sum(F.col("size") * 8 * width).over(W.orderBy("part"))      # parcels: some MB of centres each
    sizes = cut(sizes.select("part", F.floor((upto - 1) / max(1, TURN_BYTES // 2)).cast("int").alias("turn")))
    turns = (sizes.agg(F.max("turn")).first()[0] or 0) + 1
    return cut(parts.join(sizes, "part").drop("before")), turns, whole


def initial_centres(samples: DataFrame, parts: DataFrame, width: int, spare: int, seed) -> DataFrame:
    """The first distinct rows of each whole group in hash order; start r takes the r-th run of k, going round
    where a group has fewer distinct rows. Equal rows count as the one whose hash is first."""
    digest = samples.select("group", "row_id", F.xxhash64("idx", "val").alias("digest"))
    first = F.min(F.struct(hash_key(seed, "row_id").alias("h"), "row_id"))
    distinct = digest.groupBy("group", "digest").agg(first.alias("m")).select("group", "m.row_id")
    drawn = cut(first_by_hash(distinct, ["group"], ["row_id"], spare, seed).select("group", "row_id", "rank"))
    counts = drawn.groupBy("group").agg(F.max("rank").alias("pool"))
    wanted = parts.join(counts, "group").withColumn("centre", F.explode(F.sequence("low", F.col("high") - 1))).filter("centre < pool")
    wanted = wanted.withColumn("rank", F.pmod(F.col("start") * F.col("k") + F.col("centre"), F.col("pool")) + 1)
    # at most ``spare`` rows of each group
    rows = samples.join(drawn, ["group", "row_id"]).select("group", "rank", "idx", "val")
    chosen = wanted.join(rows, ["group", "rank"]).select(*STATE[:-1], "idx", "val")

    def run(batches):
        for batch in batches:
            for piece in row_chunks(batch.num_rows, width):
                part = batch.slice(piece.start, piece.stop - piece.start)
                dense = dense_lists(part.column("idx"), part.column("val"), width)
                ends = pa.array(np.arange(len(dense) + 1) * width, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in STATE[:-1]] + [pa.ListArray.from_arrays(ends, pa.array(dense.ravel()))], names=STATE)

    return chosen.mapInArrow(run, StructType([chosen.schema[c] for c in STATE[:-1]] + [StructField("c", ArrayType(DoubleType()))]))


def run_lloyd(samples: DataFrame, fits: DataFrame, width: int, n_init: int = 1, max_rounds: int = 20,
              tol: float = 1e-6, seed=SEED) -> Centres:
    """Fit everything; keeps the best start (lowest squared error, of equal ones the first) of each fit.

    ``samples``: group STRING, row_id, idx, val. ``fits``: fit_id, group, k. Groups without rows have no centres.
    """
    parts, turns, whole = plan_parcels(fits, width, n_init)
    spare = n_init * (fits.agg(F.max("k")).first()[0] or 0)
    samples = samples.select("group", "row_id", "idx", "val")
    blocks = pack(samples.select("group", "idx", "val"), "group")
    # read once per round; where places are found in turns, blocks must also keep their numbers
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK) if whole and turns == 1 else cut(blocks)
    try:
        state = cut(initial_centres(samples, parts, width, spare, seed))
        finished = []
        # The last round only measures: counts and errors belong to the final centres.
        for turn in range(max_rounds + 1):
            now = cut(measured(blocks, state, width, turns, whole))
            now = together(now, turns)
            shifts = now.groupBy("fit_id").agg((F.max("shift") > tol).alias("moves"))
            going, settled = shifts.agg(F.count_if("moves"), F.count_if(~F.col("moves"))).first()
            if turn == max_rounds or not going:
                finished.append(now)
                break
            if settled:
                finished.append(now.join(shifts.filter(~F.col("moves")), "fit_id", "left_semi"))
                now = now.join(shifts.filter("moves"), "fit_id", "left_semi")
            state = now.select(*STATE[:-1], F.col("moved").alias("c"))
        every = finished[0]
        for more in finished[1:]:
            every = every.unionByName(more)
        errors = every.groupBy("of", "start").agg(F.sum("error").alias("error"))
        best = errors.groupBy("of").agg(F.min(F.struct("error", "start"))["start"].alias("start"))
        kept = every.join(best, ["of", "start"], "left_semi").select(F.col("of").alias("fit_id"), "group", "part", "turn", "centre", "c", "n", "error")
        return Centres(cut(kept), width, turns, whole)
    finally:
        blocks.unpersist()


# -- labels ---------------------------------------------------------------------------------------

def assign(samples: DataFrame, centres: Centres, group: Column, out: str = "cluster", fits: list[str] | None = None) -> DataFrame:
    """The samples with the number of their nearest centre in ``out``, -1 where their group has no centres; with
    ``fits`` an array with the number under each of these fits. Rows are packed where they are and unpacked again."""
    samples = samples.drop(out)
    columns, width = samples.columns, centres.width
    rows = pack(samples.withColumn("__key", group.cast("string")), "__key")
    kind = ArrayType(IntegerType()) if fits else IntegerType()
    schema = StructType([*samples.schema.fields, StructField(out, kind)])

    def unpacked(batch, i, labels):
        lists = [batch.column(c)[i].values for c in columns]
        n = len(lists[0])
        if fits:
            each = np.stack([labels.get(f, np.full(n, -1, np.int32)) for f in fits], axis=1)
            mark = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(fits), pa.int32()), pa.array(each.ravel(), pa.int32()))
        else:
            mark = pa.array(next(iter(labels.values()), np.full(n, -1)), pa.int32())
        return pa.RecordBatch.from_arrays([*lists, mark], names=[*columns, out])

    def direct(batches):
        for batch in batches:
            idx, val = batch.column("idx"), batch.column("val")
            for i, parcel in enumerate(batch.select(["__fits", "__centres", "__flat"]).to_pylist()):
                labels: dict = {}
                if parcel["__fits"]:
                    parcel = {"fits": parcel["__fits"], "centres": parcel["__centres"], "flat": parcel["__flat"]}
                    for _, _, some in placed(idx[i].values, val[i].values, width, read_parcel(parcel, width)):
                        for name, numbers, at, _ in some:
                            labels.setdefault(name, []).append(numbers[at])
                yield unpacked(batch, i, {name: np.concatenate(x) for name, x in labels.items()})

    def known(batches):
        for batch in batches:
            for i, row in enumerate(batch.select(["__fits", "__places"]).to_pylist()):
                yield unpacked(batch, i, {f: np.array(p) for f, p in zip(row["__fits"] or (), row["__places"] or (), strict=True)})

    parts = together(centres.table, centres.turns).groupBy("group").agg(F.count_distinct("part").alias("parts"))
    if centres.turns == 1 and (parts.agg(F.max("parts")).first()[0] or 0) <= 1:
        met = parcels(together(centres.table, 1)).select(F.col("group").alias("__key"), F.col("fits").alias("__fits"), F.col("centres").alias("__centres"), F.col("flat").alias("__flat"))
        return rows.join(F.broadcast(met), "__key", "left").select(*[f"`{c}`" for c in columns], "__fits", "__centres", "__flat").mapInArrow(direct, schema)
    rows = cut(rows)        # blocks must keep their numbers
    best = best_places(rows.select(F.col("__key").alias("group"), "block", "idx", "val"), centres.table, width, centres.turns)
    best = best.groupBy(F.col("block").alias("__block")).agg(F.collect_list(F.struct("fit_id", "centre")).alias("e"))
    best = best.select("__block", F.col("e.fit_id").alias("__fits"), F.col("e.centre").alias("__places"))
    return rows.join(best, F.col("block") == F.col("__block"), "left").select(*[f"`{c}`" for c in columns], "__fits", "__places").mapInArrow(known, schema)
