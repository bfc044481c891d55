"""Mutual information between features and the label by nearest neighbours, in NumPy over sorted values.

Continuous/discrete estimator of Ross (2014): for each row the distance r to its k-th
neighbour of the same label, then the number m of rows of any label closer than r.
MI = psi(N) + mean psi(k) - mean psi(n_label) - mean psi(m), not below 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window as W

from ..functions.dense import row_chunks
from ..functions.hashing import SEED, hash_uniform
from ..session import cut, small, stored

NEIGHBOURS = 3
EULER = 0.5772156649015329
GROUP_CELLS = 2_000_000     # of a cluster that one task takes whole
PIECE_BYTES = 32 << 20      # of points that a task holds before it hands them on
DRAWN = 200                 # values drawn per range to place its bounds


def digamma(n: Column) -> Column:
    """psi of a positive integer: partial sums below 10, the asymptotic series from there."""
    harmonic, small = 0.0, F.when(n == 1, -EULER)
    for i in range(2, 10):
        harmonic += 1.0 / (i - 1)
        small = small.when(n == i, harmonic - EULER)
    x = n.cast("double")
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, F.lit(4.0))) - 1 / (252 * F.pow(x, F.lit(6.0)))
    return small.otherwise(series)


def psi(n: np.ndarray) -> np.ndarray:
    """The same of an array of positive integers."""
    x = np.maximum(n, 10).astype(float)
    series = np.log(x) - 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x ** 4) - 1 / (252 * x ** 6)
    low = np.concatenate([[0.0], np.cumsum([0.0] + [1.0 / i for i in range(1, 9)]) - EULER])
    return np.where(n < 10, low[np.minimum(n, 9)], series)


def spread_of(total: int, n: np.ndarray, mean: np.ndarray, square: np.ndarray, size: np.ndarray):
    """(scale, tiny) of a column from its ``n`` non-zero cells among ``total`` rows: mean, squared deviations, sum of sizes."""
    s = np.sqrt((square + mean * mean * n * ((total - n) / total)) / total)
    s = np.where(s == 0, 1.0, s)
    return s, 1e-10 * np.maximum(1.0, size / total / s)


def spots(values: np.ndarray, u: np.ndarray, scale: float, tiny: float) -> np.ndarray:
    """Values at unit deviation, ties broken by a tiny offset per row."""
    return values / scale + tiny * (2 * u - 1)


def closer(v: np.ndarray, code: np.ndarray, k: np.ndarray, halo=None, before: int = 0):
    """(m, mirror, left, beside) of rows sorted by ``v``: for each the rows nearer than its k-th neighbour of the same code.

    ``m`` is -1 for rows whose interval is still to be closed: it reaches from the neighbour to ``mirror``, and ``beside``
    rows lie up to the neighbour's far (left) or near side. ``halo``: (v, code, lt, le) of neighbours in ranges beside this
    one, with their ranks among all rows; ``before`` rows lie in the ranges below.
    """
    n = len(v)
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    lt, le = before + first[run], before + np.append(first[1:], n)[run]
    if halo is not None and len(halo[0]):
        every = [np.concatenate([a, b]) for a, b in zip((v, code, lt, le), halo, strict=True)]
        by_v = np.argsort(every[0], kind="stable")
    else:
        every, by_v = [v, code, lt, le], np.arange(n)
    of = every[1][by_v]
    order = by_v[np.argsort(of.astype(np.uint16) if len(of) and of.max() < 65536 else of, kind="stable")]
    sv, sc = every[0][order], every[1][order]
    gaps = np.full((2, NEIGHBOURS, len(sv)), np.inf)        # to the right, to the left
    for i in range(1, NEIGHBOURS + 1):
        same = sc[i:] == sc[:-i]
        away = np.where(same, sv[i:] - sv[:-i], np.inf)
        gaps[0, i - 1, :-i], gaps[1, i - 1, i:] = away, away
    own = np.flatnonzero(order < n)
    row = order[own]
    wanted = k[row]
    gaps = gaps[:, :, own]
    at = np.arange(len(own))
    rights, lefts, step = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    for i in range(1, NEIGHBOURS + 1):      # equal gaps: the right one first
        right = gaps[0, np.minimum(rights, NEIGHBOURS - 1), at] <= gaps[1, np.minimum(lefts, NEIGHBOURS - 1), at]
        rights, lefts = rights + right, lefts + ~right
        hit = wanted == i
        step[hit] = np.where(right, rights, -lefts)[hit]
    other = own + step
    left = step < 0
    there = sv[other]
    gap = np.abs(sv[own] - there)
    beside = np.where(left, every[3][order[other]], every[2][order[other]])
    out = np.full(n, -1, np.int64), np.empty(n), np.empty(n, bool), np.empty(n, np.int64)
    out[0][row] = np.where(gap == 0, (le - lt)[row], -1)
    out[1][row], out[2][row], out[3][row] = 2 * sv[own] - there, left, beside
    return out


def rows_up_to(v: np.ndarray, mirror: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Rows below the mirror of a left neighbour, or up to and with that of a right one."""
    out = np.empty(len(mirror), np.int64)
    out[left], out[~left] = np.searchsorted(v, mirror[left], "left"), np.searchsorted(v, mirror[~left], "right")
    return out


def between(far: np.ndarray, beside: np.ndarray, left: np.ndarray) -> np.ndarray:
    return np.where(left, far - beside, beside - far)


def psi_total(m: np.ndarray) -> tuple[float, int]:
    """Sum of psi and its terms; intervals that rounding has closed give none."""
    m = m[m > 0]
    return float(psi(m).sum()), len(m)


def group_scores(label: np.ndarray, u: np.ndarray, block: np.ndarray) -> list[float]:
    """Scores of the columns of one cluster held whole; nothing if no label stands twice."""
    _, code, n_label = np.unique(label, return_inverse=True, return_counts=True)
    kept = np.flatnonzero(n_label[code] > 1)
    n = len(kept)
    if not n:
        return []
    code, u, block = code[kept], u[kept], block[kept]
    k = np.minimum(NEIGHBOURS, n_label[code] - 1)
    start = float(psi(np.array([n]))[0] + psi(k).mean() - psi(n_label[code]).mean())
    scores = []
    for values in block.T:
        some = values != 0
        count, mean = some.sum(), values[some].mean() if some.any() else 0.0
        s, tiny = spread_of(n, count, mean, np.square(values[some] - mean).sum(), np.abs(values).sum())
        if not np.isfinite(s):
            scores.append(0.0)
            continue
        v = spots(values, u, float(s), float(tiny))
        by = np.argsort(v, kind="stable")
        v = v[by]
        m, mirror, left, beside = closer(v, code[by], k[by])
        open_ = m < 0
        m[open_] = between(rows_up_to(v, mirror[open_], left[open_]), beside[open_], left[open_])
        total, terms = psi_total(m)
        scores.append(max(0.0, start - total / terms) if terms else 0.0)
    return scores


def mutual_information(rows: DataFrame, shape: DataFrame, seed: int = SEED, per_bucket: int = 500_000) -> DataFrame:
    """(cluster_id, feature, score) of rows cluster_id, row_id, copy, label, idx, val; labels that stand once are left out.

    ``shape``: cluster_id, d. A cluster of few cells is scored whole in one task. The features of larger clusters are cut
    into value ranges of about ``per_bucket`` rows. A range is sorted once and stored; then it receives the nearest three
    rows of each label from the ranges beside it, and intervals that reach into another range are closed there.
    """
    shape = small(shape.filter(F.col("d") > 0).select("cluster_id", F.col("d").cast("int").alias("d")))
    labels = rows.groupBy("cluster_id", "label").agg(F.count("*").alias("n_label")).filter("n_label > 1 and cluster_id is not null and label is not null")
    labels = small(labels.withColumn("code", F.row_number().over(W.partitionBy("cluster_id").orderBy("label")) - 1))
    sizes = labels.groupBy("cluster_id").agg(
        F.sum("n_label").alias("n"), (F.sum(digamma(F.least(F.lit(NEIGHBOURS), F.col("n_label") - 1)) * F.col("n_label")) / F.sum("n_label")).alias("psi_k"),
        (F.sum(digamma(F.col("n_label")) * F.col("n_label")) / F.sum("n_label")).alias("psi_l"))
    wide = (F.col("n") > per_bucket) | (F.col("n") * F.col("d") > GROUP_CELLS)
    sizes = cut(sizes.join(shape, "cluster_id").withColumn("wide", wide))
    large = sizes.filter("wide").orderBy("cluster_id").collect()       # at most one per GROUP_CELLS cells or per_bucket rows
    parts, names = [], None
    if large:
        names = F.broadcast(rows.sparkSession.createDataFrame([(r["cluster_id"], i) for i, r in enumerate(large)],
                                                              StructType([rows.schema["cluster_id"], StructField("c", IntegerType())])))
        found = _large_scores(rows.join(small(labels.join(names, "cluster_id")), ["cluster_id", "label"]), large, seed, per_bucket)
        parts.append(found.join(names, "c").select("cluster_id", "feature", "score"))
    if not large or sizes.filter("not wide").limit(1).count():
        parts.append(_whole_scores(rows.join(small(sizes.filter("not wide").select("cluster_id", "d")), "cluster_id"), seed))
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def _whole_scores(rows: DataFrame, seed: int) -> DataFrame:
    """Clusters that one task takes whole."""
    def score(group):
        label, u = (group.column(c).to_numpy() for c in ("label", "u"))
        scores = group_scores(label, u, _block(group.combine_chunks(), group.column("d")[0].as_py()))
        ids = pa.array([group.column("cluster_id")[0].as_py()] * len(scores), group.schema.field("cluster_id").type)
        return pa.table({"cluster_id": ids, "feature": pa.array(range(len(scores)), pa.int32()), "score": pa.array(scores, pa.float64())})

    kind = rows.schema["cluster_id"].dataType.simpleString()
    asked = rows.filter("label is not null").select("cluster_id", "label", hash_uniform(seed, "row_id", "copy").alias("u"), "idx", "val", "d")
    return asked.groupBy("cluster_id").applyInArrow(score, f"cluster_id {kind}, feature int, score double")


def _block(table, d: int) -> np.ndarray:
    """Dense rows of the Arrow columns idx and val; columns from d on are left out, nulls are zeros."""
    idx, val = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (table.column("idx"), table.column("val")))
    row = np.repeat(np.arange(len(idx)), idx.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    column, value = idx.flatten().to_numpy(zero_copy_only=False), val.flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
    block = np.zeros((len(idx), d))
    seen = column < d
    block[row[seen], column[seen]] = value[seen]
    return block


def _large_scores(rows: DataFrame, large: list, seed: int, per_bucket: int) -> DataFrame:
    """(c, feature, score) of clusters numbered ``c`` as in ``large``; rows carry c, the label's code and n_label."""
    spark = rows.sparkSession
    cells = rows.select("c", F.explode(F.arrays_zip("idx", "val")).alias("e")).select("c", F.col("e.idx").alias("feature"), F.col("e.val").alias("value"))
    stats = cells.filter("value <> 0").groupBy("c", "feature").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("*")).alias("square"), F.sum(F.abs("value")).alias("size"))
    stats = stats.toPandas()
    spread = []
    for i, r in enumerate(large):
        own = stats[(stats["c"] == i) & (stats["feature"] < r["d"])]
        full = np.zeros((4, r["d"]))
        full[:, own["feature"].to_numpy()] = own[["n", "mean", "square", "size"]].to_numpy(dtype=float).T
        spread.append(spread_of(r["n"], *full))
    code = (F.col("code") * 4 + F.least(F.lit(NEIGHBOURS), F.col("n_label") - 1)).cast("int").alias("code")
    points = lambda rows, u: rows.select("c", code, u.alias("u"), "idx", "val")
    ranges = [-(-r["n"] // per_bucket) for r in large]
    bounds: dict = {}
    if max(ranges) > 1:      # where ranges are cut changes no result
        shares = spark.createDataFrame([(i, min(1.0, max(DRAWN * b, 2000) / large[i]["n"])) for i, b in enumerate(ranges) if b > 1], "c int, share double")
        drawn = points(rows.join(F.broadcast(shares), "c").filter(F.rand(seed) < F.col("share")), F.rand(seed + 1)).mapInArrow(_pieces(spread, {}), PIECE)

        def place(group):
            v = np.sort(_values(group, "v", np.float64))
            cuts = np.unique(v[np.arange(1, ranges[group.column("c")[0].as_py()]) * len(v) // ranges[group.column("c")[0].as_py()]])
            return pa.table({"c": group.column("c")[:1], "feature": group.column("feature")[:1], "at": pa.array([cuts], pa.list_(pa.float64()))})

        bounds = {(r["c"], r["feature"]): np.array(r["at"]) for r in drawn.groupBy("c", "feature").applyInArrow(place, "c int, feature int, at array<double>").collect()}
    units = points(rows, hash_uniform(seed, "row_id", "copy")).mapInArrow(_pieces(spread, bounds), PIECE).groupBy("c", "feature", "b").applyInArrow(_unit(bounds), UNIT)
    if not bounds:
        sums = units.select("c", "feature", "total", "terms")
    else:
        units = stored(units, 16 << 20)
        sums = units.filter("v is null").select("c", "feature", "total", "terms").unionByName(_joined_ranges(units.filter("v is not null"), bounds))
    facts = spark.createDataFrame([(i, r["d"], r["n"], r["psi_k"], r["psi_l"]) for i, r in enumerate(large)], "c int, d int, n bigint, psi_k double, psi_l double")
    every = F.broadcast(facts).withColumn("feature", F.explode(F.sequence(F.lit(0), F.col("d") - 1)))
    met = every.join(sums.groupBy("c", "feature").agg((F.sum("total") / F.sum("terms")).alias("psi_m")), ["c", "feature"], "left")
    return met.select("c", "feature", F.greatest(F.lit(0.0), digamma(F.col("n")) + F.col("psi_k") - F.col("psi_l") - F.col("psi_m")).alias("score"))


PIECE = "c int, feature int, b int, v binary, code binary"
END = "struct<code: int, v: double, lt: bigint, le: bigint, b: int>"
UNIT = f"c int, feature int, b int, n bigint, total double, terms bigint, v binary, code binary, ends array<{END}>"
CLOSED = "c int, feature int, b int, total double, terms bigint, mirror array<double>, left array<boolean>, beside array<bigint>"


def _values(table, column: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(column)])


def _pieces(spread: list, bounds: dict):
    """Kernel: rows to the points of each cluster, feature and value range; columns without a finite spread give none."""
    def run(batches):
        held: dict = {}
        size = 0

        def out():
            keys = list(held)
            joined = [[np.concatenate(x).tobytes() for x in zip(*held[k], strict=True)] for k in keys]
            columns = [pa.array([k[i] for k in keys], pa.int32()) for i in range(3)] + [pa.array([j[i] for j in joined], pa.binary()) for i in range(2)]
            return pa.RecordBatch.from_arrays(columns, names=["c", "feature", "b", "v", "code"])

        for batch in batches:
            cluster, code, u = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("c", "code", "u"))
            for c in np.unique(cluster):
                s, tiny = spread[c]
                mine = np.flatnonzero(cluster == c)
                for some in row_chunks(len(mine), len(s)):
                    at = mine[some]
                    block = _block(batch.take(pa.array(at)), len(s))
                    for f in np.flatnonzero(np.isfinite(s)):
                        v, cuts = spots(block[:, f], u[at], s[f], tiny[f]), bounds.get((c, f))
                        if cuts is None:
                            held.setdefault((c, f, 0), []).append((v, code[at]))
                        else:
                            b = np.searchsorted(cuts, v, "right")
                            by = np.argsort(b.astype(np.uint16) if len(cuts) < 65536 else b, kind="stable")
                            ends = np.flatnonzero(np.diff(b[by])) + 1
                            for part in np.split(by, ends):
                                held.setdefault((c, f, b[part[0]]), []).append((v[part], code[at][part]))
                        size += 12 * len(v)
                    if size > PIECE_BYTES:
                        yield out()
                        held.clear()
                        size = 0
        if held:
            yield out()

    return run


def _unit(bounds: dict):
    """Kernel: pieces of one range to a sorted range with the outermost rows of each label, or to sums where it is the only one."""
    def run(group):
        c, f, b = (group.column(x)[0].as_py() for x in ("c", "feature", "b"))
        v, code = _values(group, "v", np.float64), _values(group, "code", np.int32)
        by = np.argsort(v, kind="stable")
        v, code = v[by], code[by]
        total, terms, ends, kept = 0.0, 0, None, [None, None]
        if (c, f) in bounds:
            kept = [v.tobytes(), code.tobytes()]
            order = np.argsort(code, kind="stable")
            start = np.flatnonzero(np.concatenate([[True], code[order][1:] != code[order][:-1]]))
            length = np.diff(np.append(start, len(order)))
            place = np.arange(len(order)) - np.repeat(start, length)
            outer = order[(place < NEIGHBOURS) | (place >= np.repeat(length, length) - NEIGHBOURS)]
            ends = [{"code": int(code[i]), "v": float(v[i]), "lt": int(lt), "le": int(le), "b": b}
                    for i, lt, le in zip(outer, np.searchsorted(v, v[outer], "left"), np.searchsorted(v, v[outer], "right"), strict=True)]
        else:
            m, mirror, left, beside = closer(v, code, code & 3)
            todo = m < 0
            m[todo] = between(rows_up_to(v, mirror[todo], left[todo]), beside[todo], left[todo])
            total, terms = psi_total(m)
        kind = pa.list_(pa.struct([("code", pa.int32()), ("v", pa.float64()), ("lt", pa.int64()), ("le", pa.int64()), ("b", pa.int32())]))
        row = [pa.array([c], pa.int32()), pa.array([f], pa.int32()), pa.array([b], pa.int32()), pa.array([len(v)]), pa.array([total]), pa.array([terms]),
               pa.array(kept[:1], pa.binary()), pa.array(kept[1:], pa.binary()), pa.array([ends], kind)]
        return pa.Table.from_arrays(row, names=["c", "feature", "b", "n", "total", "terms", "v", "code", "ends"])

    return run


def _joined_ranges(units: DataFrame, bounds: dict) -> DataFrame:
    """(c, feature, total, terms) of features cut into stored ranges."""
    keys = ["c", "feature", "b"]
    counts = units.select(*keys, "n").toPandas()
    before = {}
    for (c, f), cuts in bounds.items():
        n = np.zeros(len(cuts) + 1, np.int64)
        own = counts[(counts["c"] == c) & (counts["feature"] == f)]
        n[own["b"].to_numpy()] = own["n"]
        before[c, f] = np.cumsum(n) - n
    ends = units.select("c", "feature", F.explode("ends").alias("e")).groupBy("c", "feature", F.col("e.code").alias("code"), F.col("e.b").alias("b")).agg(
        F.sort_array(F.collect_list(F.struct("e.v", "e.lt", "e.le", "e.b"))).alias("e"))
    order = W.partitionBy("c", "feature", "code").orderBy("b")
    beside = lambda step, turns: F.flatten(F.array_compact(F.array(*[step("e", i).over(order) for i in turns])))
    ends = ends.withColumn("low", beside(F.lag, range(NEIGHBOURS, 0, -1))).withColumn("high", F.slice(beside(F.lead, range(1, NEIGHBOURS + 1)), 1, NEIGHBOURS))
    low = F.when(F.size("low") > NEIGHBOURS, F.slice("low", -NEIGHBOURS, NEIGHBOURS)).otherwise(F.col("low"))
    lent = F.transform(F.concat(low, F.col("high")), lambda e: F.struct(F.col("code").alias("code"), *[e[x].alias(x) for x in ("v", "lt", "le", "b")]))
    halo = small(ends.groupBy(*keys).agg(F.flatten(F.collect_list(lent)).alias("halo")))

    def close(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                c, f, b = (batch.column(x)[i].as_py() for x in keys)
                v, code = (np.frombuffer(batch.column(x)[i].as_py(), kind) for x, kind in (("v", np.float64), ("code", np.int32)))
                halo = batch.column("halo")[i].values.flatten() if batch.column("halo")[i].is_valid else []
                if len(halo):
                    hcode, hv, lt, le, src = (x.to_numpy(zero_copy_only=False) for x in halo)
                    halo = (hv, hcode, lt + before[c, f][src], le + before[c, f][src])
                m, mirror, left, beside = closer(v, code, code & 3, halo or None, before[c, f][b])
                target = np.searchsorted(bounds[c, f], mirror, "right")
                here = (m < 0) & (target == b)
                m[here] = between(before[c, f][b] + rows_up_to(v, mirror[here], left[here]), beside[here], left[here])
                away = np.flatnonzero((m < 0) & (target != b))
                m[away] = 0
                away = away[np.argsort(target[away], kind="stable")]
                parts = [p for p in np.split(away, np.flatnonzero(np.diff(target[away])) + 1) if len(p)]
                total, terms = psi_total(m)
                n = len(parts)
                yield pa.RecordBatch.from_arrays([
                    pa.array([c] * (n + 1), pa.int32()), pa.array([f] * (n + 1), pa.int32()), pa.array([None] + [int(target[p[0]]) for p in parts], pa.int32()),
                    pa.array([total] + [0.0] * n), pa.array([terms] + [0] * n), pa.array([None] + [mirror[p] for p in parts], pa.list_(pa.float64())),
                    pa.array([None] + [left[p] for p in parts], pa.list_(pa.bool_())), pa.array([None] + [beside[p] for p in parts], pa.list_(pa.int64()))],
                    names=["c", "feature", "b", "total", "terms", "mirror", "left", "beside"])

    def look_up(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                c, f, b = (batch.column(x)[i].as_py() for x in keys)
                v = np.frombuffer(batch.column("v")[i].as_py(), np.float64)
                mirror, left, beside = (batch.column(x)[i].values.to_numpy(zero_copy_only=False) for x in ("mirror", "left", "beside"))
                total, terms = psi_total(between(before[c, f][b] + rows_up_to(v, mirror, left), beside, left))
                yield pa.RecordBatch.from_pydict({"c": pa.array([c], pa.int32()), "feature": pa.array([f], pa.int32()), "total": [total], "terms": [terms]})

    closed = stored(units.select(*keys, "v", "code").join(halo, keys, "left").mapInArrow(close, CLOSED))
    asked = closed.filter("b is not null").groupBy(*keys).agg(*[F.flatten(F.collect_list(x)).alias(x) for x in ("mirror", "left", "beside")])
    found = units.select(*keys, "v").join(small(asked), keys).mapInArrow(look_up, "c int, feature int, total double, terms bigint")
    return closed.select("c", "feature", "total", "terms").unionByName(found)


def quantile_label(rows: DataFrame, bins: int = 10, per_bucket: int = 1_000_000) -> DataFrame:
    """Regression target cut into quantile classes per cluster, so that the same estimator applies."""
    from .construct import quantile_edges

    cells = rows.select("cluster_id", F.lit(0).alias("feature"), F.col("label").alias("value"))
    top = rows.groupBy("cluster_id").agg(F.count("*").alias("n")).withColumn("feature", F.lit(0))
    edges = small(quantile_edges(cells, top, bins, per_bucket).select("cluster_id", "edges"))
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    place = F.size(F.filter(inner, lambda e: e <= F.col("label"))).cast("double")
    return rows.join(edges, "cluster_id").withColumn("label", place).drop("edges")


def select_features(scores: DataFrame, percent: float = 50, min_features: int = 5) -> DataFrame:
    """Features above the score percentile, ties in column order up to int(d * percent / 100);
    a cluster left with fewer than ``min_features`` takes its best ``min_features`` instead.

    Adds ``selected``, ``method`` and ``out_feature``.
    """
    cluster = W.partitionBy("cluster_id")
    rounded = scores.withColumn("__s", F.round("score", 10))
    cutoff = rounded.groupBy("cluster_id").agg(
        F.count("*").alias("d"), F.percentile("__s", F.lit(1 - percent / 100)).alias("cut"))
    ranked = rounded.join(cutoff, "cluster_id").withColumn(
        "above", (F.col("__s") > F.col("cut")) | F.lit(percent >= 100)).withColumn(
        "rank", F.row_number().over(cluster.orderBy(F.col("__s").desc(), "feature")))
    room = F.floor(F.col("d") * F.lit(percent / 100)) - F.sum(F.col("above").cast("int")).over(cluster)
    tie = F.col("__s") == F.col("cut")
    tie_place = F.sum((tie & ~F.col("above")).cast("int")).over(cluster.orderBy("feature").rowsBetween(W.unboundedPreceding, 0))
    first = ranked.withColumn("hit", F.col("above") | (tie & (tie_place <= room)))
    enough = first.withColumn("enough", F.sum(F.col("hit").cast("int")).over(cluster) >= min_features)
    chosen = enough.withColumn("selected", F.when(F.col("enough"), F.col("hit")).otherwise(F.col("rank") <= min_features))
    number = F.sum(F.col("selected").cast("int")).over(cluster.orderBy("feature").rowsBetween(W.unboundedPreceding, 0)) - 1
    return chosen.select(
        "cluster_id", "feature", "score", "selected",
        F.when(F.col("enough"), "percentile").otherwise("k_best").alias("method"),
        F.when(F.col("selected"), number.cast("int")).alias("out_feature"))


def feature_stats(selection: DataFrame, cluster_id: int) -> DataFrame:
    """Scores, features and method of one cluster's selection."""
    return selection.filter((F.col("cluster_id") == cluster_id) & F.col("selected"))
