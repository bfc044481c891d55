"""Nearest neighbours by vantage-point trees, one per shard of the vectors."""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut
from .common import query, table
from .vectors import cosine, doubles, matrix, unit, usable

SHARD_ROWS = 4096       # vectors of a tree, about
BLOCK_ROWS = 1024       # queries searched together, about
TURN_BLOCKS = 8         # query blocks that a task leads past one tree
TREE_FILES = 2000       # at most
LEAF_ROWS = 64
NOISE = 1e-10           # of a cosine from a matrix product, at most; what lies closer is told apart by the exact cosine
SLACK = 1e-6            # of a distance: the root of such noise near 0 (copies come out up to about 2e-8 apart)


class VantageTree:
    """A tree over unit vectors by chordal distance.

    A node keeps its vantage point and the range of distances from it to either half of its points. A half is
    left out for a query if its nearest possible point is further than the query's k-th best so far, divided by
    ``factor``: 1 never loses a neighbour, more cuts more. Points are ranked by ``cosine`` and then by id, whatever
    the noise of their distances.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, root=None):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.points = unit(self.vectors)
        self.root = self.build(np.arange(len(ids)), np.random.default_rng(1)) if root is None else root

    def packed(self) -> bytes:
        return pickle.dumps((self.ids, self.vectors, self.root))

    @staticmethod
    def unpacked(data: bytes) -> VantageTree:
        return VantageTree(*pickle.loads(data))

    def build(self, rows, rng):
        if len(rows) <= LEAF_ROWS:
            return rows
        vantage = int(rows[rng.integers(len(rows))])
        d = self.distances(self.points[[vantage]], rows)[0]
        by = np.argsort(d, kind="stable")
        half = len(rows) // 2
        near, far = by[:half], by[half:]
        spans = (float(d[near].min()), float(d[near].max()), float(d[far].min()), float(d[far].max()))
        return vantage, spans, self.build(rows[near], rng), self.build(rows[far], rng)

    def distances(self, queries, rows):
        return np.sqrt(np.maximum(0, 2 - 2 * (queries @ self.points[rows].T)))

    def search(self, query_ids, queries, k, factor):
        """Rows of the best k points of each query, its own id left out; -1 where there are fewer."""
        points = unit(queries)
        best = np.full((len(queries), k), -np.inf)
        found = np.full((len(queries), k), -1, np.int64)
        home = np.full(len(queries), -1, np.int64)          # the leaf a query was led to first, by its first row

        def look(rows, q):
            rough = 1 - self.distances(points[q], rows) ** 2 / 2
            rough[self.ids[rows][None, :] == query_ids[q][:, None]] = -np.inf
            floor = best[q, -1]
            if len(rows) >= k:
                floor = np.maximum(floor, np.partition(rough, len(rows) - k, axis=1)[:, len(rows) - k])
            at_q, at_row = np.nonzero(np.isfinite(rough) & (rough >= floor[:, None] - NOISE))
            score = np.full(rough.shape, -np.inf)
            score[at_q, at_row] = cosine(queries[q[at_q]], self.vectors[rows[at_row]])
            both = np.concatenate([best[q], score], axis=1)
            at = np.concatenate([found[q], np.broadcast_to(rows, score.shape)], axis=1)
            order = np.lexsort((at, -both), axis=1)[:, :k]           # equal scores: the smaller id, which has the smaller row
            best[q], found[q] = np.take_along_axis(both, order, 1), np.take_along_axis(at, order, 1)

        def descend(node, q):
            """The leaf on each query's own side first: a good k-th best before anything is judged."""
            if not len(q):
                return
            if isinstance(node, np.ndarray):
                home[q] = node[0]
                look(node, q)
                return
            vantage, spans, near, far = node
            inner = self.distances(points[q], np.array([vantage]))[:, 0] <= spans[1]
            descend(near, q[inner])
            descend(far, q[~inner])

        def visit(node, q):
            if isinstance(node, np.ndarray):
                q = q[home[q] != node[0]]
                if len(q):
                    look(node, q)
                return
            if not len(q):
                return
            vantage, (a, b, c, d), near, far = node
            r = self.distances(points[q], np.array([vantage]))[:, 0]
            for child, low, high in ((near, a, b), (far, c, d)):
                gap = np.maximum(low - r, r - high)
                reach = np.sqrt(np.maximum(0, 2 - 2 * best[q, -1]))
                visit(child, q[gap <= reach / factor + SLACK])

        every = np.arange(len(queries))
        if len(self.ids):
            descend(self.root, every)
            visit(self.root, every)
        found[~np.isfinite(best)] = -1
        return found


def build_index(vectors: DataFrame, id_col: str, vector_col: str, rows: int | None = None) -> tuple[DataFrame, int]:
    """(shard, tree) rows and the number of shards. Every usable vector is in one tree; shards are by hash of the id, so
    that their sizes do not depend on the data. They are checkpointed in files of a few trees: a Parquet writer looks at
    its size after 100 values, and a reader holds what a file has."""
    good = doubles(vectors.filter(usable(F.col(vector_col))).select(id_col, vector_col), vector_col)
    shards = max(1, -(-(rows if rows is not None else good.count()) // SHARD_ROWS))
    keyed = good.select(F.pmod(F.xxhash64(id_col, vector_col), F.lit(shards)).cast("int").alias("shard"), F.col(id_col).alias("id"), F.col(vector_col).alias("v"))

    def build(group):
        import pyarrow as pa

        tree = VantageTree(group.column("id").to_numpy(), matrix(group.column("v")))
        return pa.table({"shard": group.column("shard").slice(0, 1).cast(pa.int32()), "tree": pa.array([tree.packed()], pa.binary())})

    return cut(keyed.repartition(min(shards, TREE_FILES), "shard").groupBy("shard").applyInArrow(build, "shard int, tree binary")), shards


def search_index(index: DataFrame, shards: int, queries: DataFrame, id_col: str, vector_col: str, k: int, factor: float = 1.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each usable query by cosine, itself (its id) left out.

    Queries meet every tree in blocks of about BLOCK_ROWS, led past it in turns; each pair of tree and block gives k rows a
    query, and the k best of all trees remain. Ties go to the smaller id. An id or vector that repeats is a candidate each
    time; a query that repeats is answered each time it differs in its vector. An empty table finds nothing.
    """
    good = doubles(queries.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(id_col, vector_col), vector_col).distinct()
    blocks = max(1, -(-good.count() // BLOCK_ROWS))

    def pack(group):
        import pyarrow as pa

        block = (group.column("id").to_numpy(), matrix(group.column("v")))
        return pa.table({"block": group.column("block").slice(0, 1), "queries": pa.array([pickle.dumps(block)], pa.binary())})

    keyed = good.select(F.pmod(F.xxhash64(id_col, vector_col), F.lit(blocks)).cast("int").alias("block"), F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    packed = keyed.groupBy("block").applyInArrow(pack, "block int, queries binary")
    turns = max(1, -(-blocks // TURN_BLOCKS))
    each = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    asked = packed.withColumn("shard", each).select("shard", (F.col("block") % turns).alias("turn"), "block", F.col("queries").alias("data"))
    trees = index.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1)))).select("shard", "turn", F.lit(-1).alias("block"), F.col("tree").alias("data"))
    # A tree comes once for all blocks of its turn, ahead of them, and no partition holds more than a few trees.
    work = trees.unionByName(asked).repartition(2 * shards * turns, "shard", "turn").sortWithinPartitions("shard", "turn", "block")

    def search(batches):
        import pyarrow as pa

        key = tree = None
        for batch in batches:
            for i, (shard, turn, at) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("shard", "turn", "block")), strict=True)):
                if at < 0:
                    key, tree = (shard, turn), VantageTree.unpacked(batch.column("data")[i].as_py())
                    continue
                if key != (shard, turn):        # a shard without vectors
                    continue
                ids, vectors = pickle.loads(batch.column("data")[i].as_py())
                if tree.vectors.shape[1] != vectors.shape[1]:
                    raise ValueError("vectors of different lengths")
                found = tree.search(ids, vectors, k, factor)
                q, j = np.nonzero(found >= 0)
                hit = found[q, j]
                yield pa.RecordBatch.from_pydict({"query_id": ids[q], "vec_id": tree.ids[hit], "score": cosine(vectors[q], tree.vectors[hit])})

    near = work.mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


COSINE_SQL = """
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT *, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) AS norm FROM v)
"""


@query("op1_neighbours", "WITH " + COSINE_SQL + """,
p AS (SELECT q.vec_id AS query_id, c.vec_id, q.e AS qe, c.e AS ce, q.norm AS qn, c.norm AS cn, list_dot_product(q.e, c.e) / (q.norm * c.norm) AS rough
      FROM n q JOIN n c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
best AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rough DESC, vec_id) <= 8),
scored AS (SELECT query_id, vec_id, list_reduce(list_transform(range(1, len(qe) + 1), lambda i: qe[i] * ce[i]), lambda a, b: a + b) / (qn * cn) AS score FROM best),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""")
def op1_neighbours(spark, sf_dir):
    """The five nearest of every 50th vector among all others; factor 1, so none is missed."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").filter("vec_id is not null")
    index, shards = build_index(vectors, "vec_id", "embedding")
    return search_index(index, shards, vectors.filter("vec_id % 50 = 0"), "vec_id", "embedding", 5)
