"""Exact top-k by inner product: ball trees per shard, searched by branch and bound."""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import query, stored, table

SAMPLE_ROWS = 16_384    # the cells are cut on about so many vectors; every vector is indexed
CELLS = 256             # of one vector length, at most
SHARD_ROWS = 4096       # vectors of a tree, about
BLOCK_ROWS = 1024       # queries searched together, at most
LEAF_ROWS = 64
EXACT = 2.0 ** 53       # whole numbers up to it are exact as doubles


def finite(vector: Column) -> Column:
    """Whether a vector is not null and holds only finite, non-null components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as double; beyond 2^53 a double is whole anyway."""
    def cut(x):
        x = x.cast("double") * F.lit(float(scale))
        large = F.abs(x) >= EXACT
        return F.when(large, x).otherwise(F.floor(F.when(large, 0.0).otherwise(x)).cast("double"))

    return F.transform(vector, cut)


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows cut in two equal halves along the line between two far points."""
    a = x[np.argmax(((x - x[0]) ** 2).sum(axis=1))]
    b = x[np.argmax(((x - a) ** 2).sum(axis=1))]
    by = np.argsort(x @ (b - a), kind="stable")
    return by[: len(by) // 2], by[len(by) // 2:]


class BallTree:
    """Nodes with centre, radius and smallest id, all in flat arrays; node i has the children 2i + 1 and 2i + 2.

    The inner product of a query q with a point of a node is at most q.centre + |q| radius. As scores are whole
    numbers, that bound is cut to a whole number too; a node goes only if it is below the k-th score so far, or
    equal to it while no id of the node is smaller than the k-th id. So nothing is lost, ties included.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.depth = max(0, int(np.ceil(np.log2(max(1, len(ids)) / LEAF_ROWS))))
        parts = [np.argsort(ids, kind="stable")]
        levels = [parts]
        for _ in range(self.depth):
            parts = [p[h] for p in parts for h in halves(vectors[p])]
            levels.append(parts)
        order = np.concatenate([np.sort(p) for p in parts])
        self.ids, self.vectors = ids[order], vectors[order]
        self.cuts = np.cumsum([0] + [len(p) for p in parts])
        nodes = [p for level in levels for p in level]
        with np.errstate(all="ignore"):
            self.centres = np.array([vectors[p].mean(axis=0) for p in nodes])
            self.radii = np.array([np.sqrt(((vectors[p] - c) ** 2).sum(axis=1).max()) for p, c in zip(nodes, self.centres, strict=True)])
        self.least = np.array([ids[p].min() for p in nodes])
        self.largest = float(np.abs(vectors).max(initial=0))

    def packed(self) -> bytes:
        return pickle.dumps(vars(self))

    @classmethod
    def unpacked(cls, data: bytes) -> BallTree:
        tree = cls.__new__(cls)
        vars(tree).update(pickle.loads(data))
        return tree

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of each query in each leaf: the least of the bounds on the way down to it."""
        own = bound(queries, self.centres, self.radii)
        level = own[:, :1]
        for d in range(1, self.depth + 1):
            level = np.minimum(np.repeat(level, 2, axis=1), own[:, 2 ** d - 1: 2 ** (d + 1) - 1])
        return level

    def search(self, query_ids, queries, k, floor_score, floor_id):
        """(query, row) of what may be among the k best of each query, and its score.

        floor_score and floor_id: what a query's k-th best is already, -inf where it has fewer.
        Every query opens its leaves in the order of their bounds until the next cannot reach its k-th score.
        """
        best = np.full((len(queries), k), -np.inf)
        row = np.full((len(queries), k), -1, np.int64)
        label = np.full((len(queries), k), np.iinfo(np.int64).max)
        exact = queries.shape[1] * float(np.abs(queries).max(initial=0)) * self.largest < EXACT
        floor_score = floor_score.astype(float)
        if not exact:
            best, floor_score = best.astype(object), floor_score.astype(object)
        limit = self.bounds(queries)
        leaf_order = np.argsort(-limit, axis=1, kind="stable")
        leaf_least = self.least[2 ** self.depth - 1:]
        active = np.arange(len(queries))
        for turn in range(limit.shape[1]):
            leaf = leaf_order[active, turn]
            top = limit[active, leaf]
            full = best[active, -1] > floor_score[active]
            kth = np.where(full, best[active, -1], floor_score[active])
            kth_id = np.where(full, label[active, -1], np.where(best[active, -1] == floor_score[active], np.minimum(label[active, -1], floor_id[active]), floor_id[active]))
            # bounds fall along the order: below the k-th score nothing that follows can count either
            alive = (top >= kth).astype(bool)
            opens = alive & ((top > kth) | (leaf_least[leaf] <= kth_id)).astype(bool)
            for at in np.unique(leaf[opens]):
                q = active[opens & (leaf == at)]
                rows = np.arange(self.cuts[at], self.cuts[at + 1])
                score = product(queries[q], self.vectors[rows], exact)
                score[self.ids[rows][None, :] == query_ids[q][:, None]] = -np.inf
                both = np.concatenate([best[q], score], axis=1)
                at_row = np.concatenate([row[q], np.broadcast_to(rows, score.shape)], axis=1)
                at_id = np.concatenate([label[q], np.broadcast_to(self.ids[rows], score.shape)], axis=1)
                order = np.lexsort((at_id, -both), axis=1)[:, :k] if exact else np.array([sorted(range(both.shape[1]), key=lambda j, i=i: (-both[i, j], at_id[i, j]))[:k] for i in range(len(q))])
                best[q], row[q], label[q] = (np.take_along_axis(x, order, 1) for x in (both, at_row, at_id))
            active = active[alive]
            if not len(active):
                break
        hit = ((best > -np.inf) & (best >= floor_score[:, None])).astype(bool)
        q, j = np.nonzero(hit)
        return q, row[q, j], best[q, j]


def bound(queries, centres, radii):
    """Largest whole inner product that a point within the radius can have with each query, never too small."""
    with np.errstate(all="ignore"):
        size = np.sqrt((queries * queries).sum(axis=1))[:, None]
        reach = np.abs(queries) @ np.abs(centres).T + size * radii
        out = np.floor(queries @ centres.T + size * radii + 1e-9 * reach + 1e-6)
    return np.where(np.isnan(out), np.inf, out)             # squares beyond the range of doubles bound nothing


def product(a, b, exact):
    """Inner products of whole numbers; beyond 2^53 in whole Python numbers."""
    if exact:
        return a @ b.T
    a, b = ([[int(x) for x in v] for v in m.tolist()] for m in (a, b))
    return np.array([[sum(x * y for x, y in zip(u, v, strict=True)) for v in b] for u in a], object).reshape(len(a), len(b))


def as_matrix(column) -> np.ndarray:
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0))


def cut_cells(sample: np.ndarray) -> np.ndarray:
    """Centres of cells of about 64 sampled vectors, halved until there are CELLS at most."""
    parts = [np.arange(len(sample))]
    while len(parts) < CELLS and max(map(len, parts)) > 64:
        parts = [p[h] for p in parts for h in halves(sample[p]) if len(h)]
    return np.array([sample[p].mean(axis=0) for p in parts])


def fit_cells(vectors: DataFrame, rows: int) -> dict[int, np.ndarray]:
    """Cell centres by vector length, from SAMPLE_ROWS vectors drawn by a hash (a bounded table)."""
    share = min(1.0, SAMPLE_ROWS / max(1, rows))
    drawn = vectors.filter(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * SAMPLE_ROWS).select("v").toArrow()
    by_length: dict[int, list] = {}
    for v in drawn.column("v").to_pylist():
        by_length.setdefault(len(v), []).append(v)
    return {d: cut_cells(np.array(sorted(vs), np.float64).reshape(len(vs), d)) for d, vs in by_length.items()}


def placed(vectors: DataFrame, centres: dict[int, np.ndarray], by_product: bool) -> DataFrame:
    """(id, v, dim, cell): the nearest cell, or for queries the one whose centre has the largest inner product."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            dims = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            cell = np.zeros(batch.num_rows, np.int32)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                middle = shared.value.get(int(d))
                if middle is not None and d:
                    x = as_matrix(batch.column("v").take(pa.array(at)))
                    score = x @ middle.T
                    cell[at] = (score if by_product else score - (middle * middle).sum(axis=1) / 2).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(dims, pa.int32()), pa.array(cell)], names=["id", "v", "dim", "cell"])

    return vectors.select("id", "v").mapInArrow(run, "id long, v array<double>, dim int, cell int")


class Index:
    """Trees of every shard, the shards of every cell, and the balls of the cells."""

    def __init__(self, trees: DataFrame, cells: DataFrame, centres: dict[int, np.ndarray]):
        self.trees, self.cells, self.centres = trees, cells, centres


def build_index(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> Index:
    """Ball trees over floor(scale * x) of every vector that is not null and has only finite, non-null components.

    Rows without id take no part. Vectors fall into cells of near vectors (one set of cells for each vector length),
    and a cell into as many shards as its rows need, by hash: a vector that a third of the rows repeat fills many
    shards, never one. (dim, cell, shard) rows hold the trees; (dim) rows hold all its cells' balls, CELLS at most.
    """
    good = vectors.filter(F.col(id_col).isNotNull() & finite(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), whole(F.col(vector_col), scale).alias("v"))
    centres = fit_cells(good, good.count())
    at = placed(good, centres, by_product=False)
    counts = at.groupBy("dim", "cell").count().select("dim", "cell", F.ceil(F.col("count") / SHARD_ROWS).cast("int").alias("shards"))
    counts = stored(counts)
    keyed = at.withColumn("salt", F.xxhash64("id", "v")).join(counts, ["dim", "cell"]).withColumn("shard", F.pmod("salt", "shards").cast("int"))

    def build(group):
        import pyarrow as pa

        tree = BallTree(group.column("id").to_numpy(), as_matrix(group.column("v")))
        rest = {"centre": pa.array([tree.centres[0].tolist()], pa.list_(pa.float64())), "radius": pa.array([tree.radii[0]])}
        return pa.table({c: group.column(c).slice(0, 1).cast(pa.int32()) for c in ("dim", "cell", "shard")} | rest | {"tree": pa.array([tree.packed()], pa.binary())})

    schema = "dim int, cell int, shard int, centre array<double>, radius double, tree binary"
    trees = stored(keyed.select("dim", "cell", "shard", "id", "v").groupBy("dim", "cell", "shard").applyInArrow(build, schema))
    return Index(trees, counts, centres)


def search_index(index: Index, queries: DataFrame, id_col: str, vector_col: str, k: int, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query with other ids' vectors.

    Scores are whole numbers, exact; one beyond a long raises an error. Ties go to the smaller id. An id or vector
    that repeats is a candidate each time, a query that repeats is answered once for each different vector of its
    id, and only vectors of a query's length are its candidates (the empty vector scores 0 with empty ones). Null
    queries and empty tables find nothing.

    First each query is searched in one shard of the cell it points to. The k-th score found there goes with the
    query to every other shard, whose tree is opened only where its ball can still reach that score.
    """
    good = queries.filter(F.col(id_col).isNotNull() & finite(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), whole(F.col(vector_col), scale).alias("v")).distinct()
    asked = placed(good, index.centres, by_product=True).withColumn("query", F.xxhash64("id", "v"))
    some = index.trees.groupBy("dim").agg(F.min(F.struct("cell", "shard")).alias("any"))
    asked = asked.join(index.cells, ["dim", "cell"], "left").join(some, "dim")
    # a cell that no vector fell into has no shards: any shard will do to begin
    home = F.when(F.col("shards").isNull(), F.col("any")).otherwise(F.struct("cell", F.pmod("query", "shards").cast("int").alias("shard")))
    asked = stored(asked.select("query", "id", "v", "dim", home.cell.alias("home_cell"), home.shard.alias("home_shard")))

    def blocks(of: DataFrame, *keys: str) -> DataFrame:
        """Queries by keys in blocks of BLOCK_ROWS about, packed."""
        sizes = of.groupBy(*keys).count().select(*keys, F.ceil(F.col("count") / BLOCK_ROWS).alias("blocks"))
        return of.join(sizes, list(keys)).withColumn("block", F.pmod(F.xxhash64("query", F.lit(1)), "blocks").cast("int"))

    def first(key, group):
        import pyarrow as pa

        block = group.column("id").to_numpy(), as_matrix(group.column("v")), group.column("query").to_numpy()
        return pa.table({"dim": [key[0].as_py()], "cell": [key[1].as_py()], "shard": [key[2].as_py()], "queries": [pickle.dumps((*block, None, None))]},
                        schema=pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("shard", pa.int32()), ("queries", pa.binary())]))

    packed = "dim int, cell int, shard int, queries binary"
    start = blocks(asked.withColumnsRenamed({"home_cell": "cell", "home_shard": "shard"}), "dim", "cell", "shard")
    start = start.groupBy("dim", "cell", "shard", "block").applyInArrow(first, packed)
    found = stored(searched(start, index.trees, k))
    kth = found.groupBy("query").agg(F.count("*").alias("n"), F.max(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("i"))).alias("last"))
    told = asked.join(kth, "query", "left").select("*", F.when(F.col("n") >= k, -F.col("last.s")).alias("kth"), F.when(F.col("n") >= k, F.col("last.i")).alias("kth_id")).drop("n", "last")

    def pack(key, group):
        import pyarrow as pa

        columns = {c: group.column(c).to_numpy() for c in ("id", "query", "home_cell", "home_shard")}
        short = group.column("kth").is_null().to_numpy()
        floor = np.array([-np.inf if x is None else float(x) for x in group.column("kth").to_pylist()])
        block = columns, as_matrix(group.column("v")), np.nextafter(floor, -np.inf, where=np.abs(floor) >= EXACT, out=floor), np.where(short, np.iinfo(np.int64).max, group.column("kth_id").fill_null(0).to_numpy())
        return pa.table({"dim": [key[0].as_py()], "queries": [pickle.dumps(block)]}, schema=pa.schema([("dim", pa.int32()), ("queries", pa.binary())]))

    told = blocks(told, "dim").groupBy("dim", "block").applyInArrow(pack, "dim int, queries binary")
    parts = max(8, -(-(index.cells.agg(F.sum("shards")).first()[0] or 0) // BLOCK_ROWS))
    told = told.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    balls = index.trees.select("dim", "cell", "shard", "centre", "radius").withColumn("part", F.pmod(F.xxhash64("cell", "shard"), F.lit(parts)).cast("int"))
    balls = balls.groupBy("dim", "part").agg(F.collect_list(F.struct("cell", "shard", "centre", "radius")).alias("balls"))

    def judge(batches):
        """For each block and ball, the queries whose k-th score the ball can reach."""
        import pyarrow as pa

        for batch in batches:
            for dim, block, ball in zip(batch.column("dim").to_pylist(), batch.column("queries"), batch.column("balls"), strict=True):
                (columns, vectors, floor, floor_id), ball = pickle.loads(block.as_py()), ball.as_py()
                centres = np.array([b["centre"] for b in ball], np.float64).reshape(len(ball), dim)
                reach = bound(vectors, centres, np.array([b["radius"] for b in ball])) >= floor[:, None]
                out = []
                for j, b in enumerate(ball):
                    q = np.flatnonzero(reach[:, j] & ~((columns["home_cell"] == b["cell"]) & (columns["home_shard"] == b["shard"])))
                    if len(q):
                        out.append((dim, b["cell"], b["shard"], pickle.dumps((columns["id"][q], vectors[q], columns["query"][q], floor[q], floor_id[q]))))
                    if len(out) == 64 or out and j == len(ball) - 1:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["dim", "cell", "shard", "queries"])
                        out = []

    rest = told.join(balls, ["dim", "part"]).select("dim", "queries", "balls").mapInArrow(judge, packed)
    every = found.unionByName(searched(rest, index.trees, k))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))
    return every.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def searched(work: DataFrame, trees: DataFrame, k: int) -> DataFrame:
    """(query, query_id, vec_id, score) of blocks of queries, each in the tree of its shard."""
    joined = work.join(trees.select("dim", "cell", "shard", "tree"), ["dim", "cell", "shard"]).select("queries", "tree")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for block, tree in zip(batch.column("queries"), batch.column("tree"), strict=True):
                ids, vectors, names, floor, floor_id = pickle.loads(block.as_py())
                tree = BallTree.unpacked(tree.as_py())
                if floor is None:
                    floor, floor_id = np.full(len(ids), -np.inf), np.full(len(ids), np.iinfo(np.int64).max)
                q, row, score = tree.search(ids, vectors, k, floor, floor_id)
                yield pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(ids[q]), pa.array(tree.ids[row]), pa.array([int(s) for s in score], pa.int64())],
                                                 names=["query", "query_id", "vec_id", "score"])

    return joined.mapInArrow(run, "query long, query_id long, vec_id long, score long")


@query("op12_top_products", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""")
def op12_top_products(spark, sf_dir):
    """The five largest integer inner products of every 50th vector with all others."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search_index(build_index(vectors, "vec_id", "embedding"), vectors.filter("vec_id % 50 = 0"), "vec_id", "embedding", 5)
