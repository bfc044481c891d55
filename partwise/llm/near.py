"""Near duplicates among vectors: flat robust-pruned graphs over overlapping shards, searched by range."""

from __future__ import annotations

import math
import pickle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small
from .common import query, stored, table
from .graph import components
from .vectors import cosine, doubles, matrix, unit, usable

SHARD_ROWS = 1500       # a shard above it is split, or searched in pairs of blocks if it cannot be
SAMPLE_ROWS = 2048      # rows of a shard that its centres are fitted on, about
CENTRES = 64            # most parts of one split
DEGREE = 16             # neighbours that a vector keeps in a shard's graph
POOL = 48               # nearest vectors among which they are chosen
STRETCH = 1.2           # a neighbour goes if one already kept is so much nearer to it
BEAM = 16
AUDITED = (256, 4096)   # vectors drawn for the audit, the second number if the first draw has too few with links
VOTERS = 64             # distinct vectors with links to others than their copies that an audit needs
MARGINS = (3.0, 8.0)    # degrees beyond the nearest centre within which a vector joins further shards; then all that a link can need
RECALL = 0.97
ALIKE = 1 - 1e-9        # links with a higher cosine are to copies


def fit_centres(points: np.ndarray, count: int, seed: int = 3) -> np.ndarray:
    """Unit centres by a few rounds of spherical k-means."""
    rng = np.random.default_rng(seed)
    centres = points[np.sort(rng.choice(len(points), min(count, len(points)), replace=False))]
    for _ in range(8):
        at = np.argmax(points @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, points)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centres)
    return centres


def split_shards(rows: DataFrame, sizes: DataFrame, threshold: float, margin: float | None) -> DataFrame:
    """One split of the large shards: each row goes to the part of its nearest centre and to those whose angle
    is at most ``margin`` degrees more. Without a margin it goes to every part that may hold a partner: the plane
    between two centres is no further from it than the angle of a link, so each link's ends meet in the part of either.
    ``sizes`` (shard, n) names the shards to split.

    A shard's rows are dealt to salted groups; its centres travel to each of them as one row ahead of the others.
    """
    salts = F.ceil(F.col("n") / F.lit(4 * SHARD_ROWS)).cast("int")
    large = rows.join(sizes.select("shard", "n", salts.alias("salts")), "shard")
    sample = large.filter(F.pmod(F.xxhash64("id", F.lit(11)), F.col("n")) < SAMPLE_ROWS)

    def fit(group):
        import pyarrow as pa

        group = group.sort_by("id").slice(0, 2 * SAMPLE_ROWS)
        count = min(CENTRES, math.ceil(2 * group.column("n")[0].as_py() / SHARD_ROWS))
        centres = fit_centres(unit(matrix(group.column("v"))), count)
        return pa.table({"shard": group.column("shard").slice(0, 1), "salts": group.column("salts").slice(0, 1), "centres": pa.array([pickle.dumps(centres)], pa.binary())})

    fitted = sample.select("shard", "n", "salts", "id", "v").groupBy("shard").applyInArrow(fit, "shard string, salts int, centres binary")
    ahead = fitted.select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("tag"), "centres",
                          F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("v"))
    behind = large.select("shard", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("tag"),
                          F.lit(None).cast("binary").alias("centres"), "id", "v")
    dealt = ahead.unionByName(behind).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "tag")

    reach = math.sqrt(1 - threshold * threshold) if 0 < threshold < 1 else float(threshold <= 0)        # sine of the angle of a link

    def assign(batches):
        import pyarrow as pa

        centres = None
        for batch in batches:
            tags = batch.column("tag").to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(tags == 0)
            cuts = np.unique(np.r_[0, heads, len(tags)])
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                if tags[a] == 0:
                    centres, part = pickle.loads(part.column("centres")[0].as_py()), part.slice(1)
                if not part.num_rows:
                    continue
                near = unit(matrix(part.column("v"))) @ centres.T
                if margin is None:
                    own = np.argmax(near, axis=1)
                    apart = np.linalg.norm(centres[:, None] - centres[None], axis=2)
                    row, c = np.nonzero(near.max(axis=1, keepdims=True) - near <= reach * apart[own] + 1e-9)
                else:
                    angles = np.degrees(np.arccos(np.clip(near, -1, 1)))
                    row, c = np.nonzero(angles <= angles.min(axis=1, keepdims=True) + margin)
                shard = part.column("shard")[0].as_py()
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array([f"{shard}/{k}" for k in c.tolist()], pa.string()), taken.column("id"), taken.column("v")], names=["shard", "id", "v"])

    return dealt.mapInArrow(assign, "shard string, id long, v array<double>")


def shard_vectors(rows: DataFrame, threshold: float, margin: float | None) -> DataFrame:
    """(shard, id, v) rows in overlapping shards, stored. A shard is split until it holds SHARD_ROWS at most, or its
    split would more than triple its rows (a tight ball of vectors, which no centre divides)."""
    finished, todo = None, rows
    parent = F.regexp_replace("shard", "/[0-9]+$", "")
    for _ in range(4):
        sizes = stored(todo.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > SHARD_ROWS))
        if sizes.isEmpty():
            break
        parts = stored(split_shards(todo, sizes, threshold, margin))
        made = parts.groupBy(parent.alias("shard")).agg(F.count("*").alias("m"))
        divided = small(sizes.join(made, "shard").filter("m <= 3 * n").select("shard"))
        kept = todo.join(divided, "shard", "left_anti")
        finished = kept if finished is None else finished.unionByName(kept)
        todo = parts.join(divided.withColumnRenamed("shard", "parent"), parent == F.col("parent"), "left_semi")
    return stored(todo if finished is None else finished.unionByName(todo))


def with_groups(rows: DataFrame) -> DataFrame:
    """Adds ``work`` (shard, i, j), the rows searched together, ``block`` and ``shards``, all shards of the row.

    A shard that stayed large is cut by hash into blocks, and every pair of blocks is searched on its own.
    """
    shards = rows.groupBy("id").agg(F.array_sort(F.collect_set("shard")).alias("shards"))
    sizes = rows.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(2 * SHARD_ROWS)).cast("int").alias("blocks"))
    placed = rows.join(sizes, "shard").join(shards, "id")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = placed.withColumn("other", other)
    work = F.concat_ws("|", "shard", F.least("block", "other").cast("string"), F.greatest("block", "other").cast("string"))
    return placed.select(work.alias("work"), "shard", "block", "id", "v", "shards")


def prune(similar: np.ndarray) -> np.ndarray:
    """Robust pruning of each point's nearest POOL others: (points, DEGREE) neighbours, -1 padded.

    The nearest candidate stays; candidates at least STRETCH times nearer to it than to the point go; and again.
    """
    n = len(similar)
    pool = min(POOL, n - 1)
    if pool <= 0:
        return np.full((n, 1), -1, np.int64)
    masked = similar.copy()
    np.fill_diagonal(masked, -np.inf)
    near = np.argpartition(-masked, pool - 1, axis=1)[:, :pool]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(masked, near, 1), axis=1, kind="stable"), 1)
    far = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(similar, near, 1)))
    alive = np.ones(near.shape, bool)
    out = np.full((n, min(DEGREE, pool)), -1, np.int64)
    rows = np.arange(n)
    for k in range(out.shape[1]):
        first = np.argmax(alive, axis=1)
        some = alive[rows, first]
        out[some, k] = near[rows, first][some]
        between = np.sqrt(np.maximum(0, 2 - 2 * similar[near[rows, first][:, None], near]))
        alive &= STRETCH * between > far
        alive[rows, first] = False
    return out


def search_ranges(points: np.ndarray, graph: np.ndarray, threshold: float, chunk: int = 256) -> np.ndarray:
    """found[q, x]: x is at the threshold or nearer to q, as a greedy search on the graph finds.

    The search starts at the medoid and at the query's own node, expands its best node until the beam holds no
    unexpanded one, and then grows the range: neighbours of all nodes in range are looked at until none is new.
    """
    n = len(points)
    found = np.zeros((n, n), bool)
    medoid = int(np.argmax(points @ points.mean(axis=0)))
    links = np.zeros((n, n), np.float32)
    at, k = np.nonzero(graph >= 0)
    links[at, graph[at, k]] = links[graph[at, k], at] = 1
    for start in range(0, n, chunk):
        q = np.arange(start, min(n, start + chunk))
        rows = np.arange(len(q))
        seen = np.zeros((len(q), n), bool)
        ids = np.stack([np.full(len(q), medoid), q], axis=1)
        seen[rows, medoid] = seen[rows, q] = True
        near = np.einsum("qd,qrd->qr", points[q], points[ids])
        near[ids[:, 0] == ids[:, 1], 1] = -np.inf
        opened = ~np.isfinite(near)
        hits = np.zeros((len(q), n), bool)
        hits[rows, q] = True
        hits[rows, medoid] |= near[:, 0] >= threshold
        active = rows
        while len(active):
            waiting = np.where(opened[active], -np.inf, near[active])
            best = np.argmax(waiting, axis=1)
            active = active[np.isfinite(waiting[np.arange(len(active)), best])]
            if not len(active):
                break
            best = np.argmax(np.where(opened[active], -np.inf, near[active]), axis=1)
            opened[active, best] = True
            nexts = graph[ids[active, best]]
            fresh = (nexts >= 0) & ~seen[active[:, None], np.maximum(nexts, 0)]
            s = np.where(fresh, np.einsum("qd,qrd->qr", points[q[active]], points[np.maximum(nexts, 0)]), -np.inf)
            r, c = np.nonzero(fresh)
            seen[active[r], nexts[r, c]] = True
            in_range = s[r, c] >= threshold
            hits[active[r[in_range]], nexts[r[in_range], c[in_range]]] = True
            all_near = np.concatenate([near[active], s], axis=1)
            all_ids = np.concatenate([ids[active], np.maximum(nexts, 0)], axis=1)
            all_open = np.concatenate([opened[active], ~fresh], axis=1)
            order = np.argsort(-all_near, axis=1, kind="stable")[:, :BEAM]
            width = order.shape[1]
            if width > near.shape[1]:
                grow = width - near.shape[1]
                near = np.pad(near, ((0, 0), (0, grow)), constant_values=-np.inf)
                ids = np.pad(ids, ((0, 0), (0, grow)))
                opened = np.pad(opened, ((0, 0), (0, grow)), constant_values=True)
            near[active, :width] = np.take_along_axis(all_near, order, 1)
            ids[active, :width] = np.take_along_axis(all_ids, order, 1)
            opened[active, :width] = np.take_along_axis(all_open, order, 1)
        growing = np.flatnonzero(hits.sum(axis=1) > 1)
        edge = hits[growing]
        while len(growing):
            reach = (edge.astype(np.float32) @ links > 0) & ~seen[growing]
            seen[growing] |= reach
            r, c = np.nonzero(reach)
            edge = np.zeros_like(reach)
            for a in range(0, len(r), 1 << 16):
                rr, cc = r[a:a + (1 << 16)], c[a:a + (1 << 16)]
                edge[rr, cc] = np.einsum("nd,nd->n", points[q[growing[rr]]], points[cc]) >= threshold
            hits[growing] |= edge
            on = edge.any(axis=1)
            growing, edge = growing[on], edge[on]
        found[q] = hits
    return found | found.T


def class_labels(linked: np.ndarray) -> np.ndarray:
    """Smallest row index reachable from each row of a symmetric boolean matrix."""
    label = np.arange(len(linked))
    a, b = np.nonzero(linked)
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        least = least[least]
        if (least == label).all():
            return label
        label = least


def build(group):
    """Adjacency of one work group: (id, near)."""
    import pyarrow as pa

    group = group.sort_by("id")
    ids, points = group.column("id").to_numpy(), unit(matrix(group.column("v")))
    graph = prune(points @ points.T)
    return pa.table({"id": ids, "near": pa.array([ids[g[g >= 0]].tolist() for g in graph], pa.list_(pa.int64()))})


def all_in_range(points: np.ndarray, threshold: float, chunk: int = 512) -> np.ndarray:
    """found[q, x] for every pair of points."""
    return np.concatenate([points[a:a + chunk] @ points.T >= threshold for a in range(0, len(points), chunk)])


def searcher(threshold: float, whole: bool = False):
    """Search of a work group along its graph, or (``whole``) of all its pairs."""
    def graph_of(group, ids):
        n = len(ids)
        lists = group.column("near").to_pylist()
        flat = np.array([x for near in lists for x in near], np.int64)
        owner = np.repeat(np.arange(n), [len(near) for near in lists])
        at = np.minimum(np.searchsorted(ids, flat), n - 1)
        here = ids[at] == flat
        owner, at = owner[here], at[here]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        graph = np.full((n, int(rank.max()) + 1 if len(rank) else 1), -1, np.int64)
        graph[owner, rank] = at
        return graph

    def search(group):
        """Links of one work group: (id, links counted here, smallest id of its class here)."""
        import pyarrow as pa

        group = group.sort_by("id")
        ids, vectors = group.column("id").to_numpy(), matrix(group.column("v"))
        n = len(ids)
        points = unit(vectors)
        found = all_in_range(points, threshold - 1e-9) if whole else search_ranges(points, graph_of(group, ids), threshold - 1e-9)
        np.fill_diagonal(found, False)
        a, b = np.nonzero(np.triu(found))
        exact = np.concatenate([cosine(vectors[a[i:i + 65536]], vectors[b[i:i + 65536]]) >= threshold for i in range(0, len(a), 65536)] or [np.empty(0, bool)])
        a, b = a[exact], b[exact]
        found[:] = False
        found[a, b] = found[b, a] = True
        label = class_labels(found)
        # a pair counts in the first shard that holds both, and in the group of its two blocks
        shard = group.column("shard")[0].as_py()
        _, i, j = group.column("work")[0].as_py().rsplit("|", 2)
        lower = [[s for s in many if s < shard] for many in group.column("shards").to_pylist()]
        names = {s: k for k, s in enumerate(sorted({s for many in lower for s in many}))}
        if names:
            member = np.zeros((n, len(names)), np.float32)
            for row, many in enumerate(lower):
                member[row, [names[s] for s in many]] = 1
            found &= member @ member.T == 0
        if i != j:
            block = group.column("block").to_numpy()
            found &= block[:, None] != block[None, :]
        return pa.table({"id": ids, "n": found.sum(axis=1).astype(np.int64), "least": ids[label]})

    return search


def voters_of(rows: DataFrame, threshold: float) -> DataFrame:
    """(id, true, alike) of drawn distinct vectors that link with others than their copies: all their links and those
    to copies, each vector held against every vector of its label. More are drawn while VOTERS are not met."""
    spark = rows.sparkSession
    for drawn in AUDITED:
        sample = rows.orderBy(F.xxhash64("id", F.lit(17)), "id").limit(drawn).groupBy("shard", "v").agg(F.min("id").alias("id"))
        blocks = sample.groupBy("shard").agg(F.collect_list(F.struct("id", "v")).alias("r"))
        held = {b["shard"]: (np.array([r["id"] for r in b["r"]]), unit(np.array([r["v"] for r in b["r"]]))) for b in blocks.collect()}
        shared = spark.sparkContext.broadcast(held)

        def brute(batches, shared=shared):
            import pyarrow as pa

            for batch in batches:
                shards = np.array(batch.column("shard").to_pylist())
                points, ids = unit(matrix(batch.column("v"))), batch.column("id").to_numpy()
                for shard in set(shards.tolist()):
                    at = np.flatnonzero(shards == shard)
                    mine, v = shared.value.get(shard, (np.empty(0, np.int64), None))
                    for a in range(0, len(mine), 512):
                        near = np.where(mine[a:a + 512, None] == ids[at][None, :], -2, v[a:a + 512] @ points[at].T)
                        true, alike = (near >= threshold).sum(axis=1), (near >= max(threshold, ALIKE)).sum(axis=1)
                        yield pa.RecordBatch.from_pydict({"id": mine[a:a + 512], "true": true.astype(np.int64), "alike": alike.astype(np.int64)})

        linked = rows.mapInArrow(brute, "id long, true long, alike long").groupBy("id").agg(F.sum("true").alias("true"), F.sum("alike").alias("alike"))
        voters = stored(linked.filter(F.col("true") > F.col("alike")))
        if voters.count() >= VOTERS:
            break
    return voters


def audit(voters: DataFrame, counted: DataFrame) -> float:
    """Mean share of a voter's true links that were found, links to copies left out (taken as found)."""
    share = (F.coalesce("n", F.lit(0)) - F.col("alike")) / (F.col("true") - F.col("alike"))
    return voters.join(counted, "id", "left").agg(F.avg(F.greatest(share, F.lit(0.0)))).first()[0]


def near_duplicates(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, threshold: float) -> DataFrame:
    """(id, n_links, component_id, kept) of every vector: how many others of its label have a cosine of at least
    ``threshold``, and the smallest id reachable by such links.

    Unusable vectors, null labels and null ids link with nothing (component: their own id). Rows that repeat an id
    are one vector, the one with the least (label, vector hash) among the usable. Found links are verified in double precision, so none
    is below the threshold. Graphs over wider shards are searched until an audit finds RECALL of the links of a sample;
    where they miss it, or the sample has too few vectors with links to say, all pairs that can link are compared.
    """
    good = usable(F.col(vector_col)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("shard"), F.col(vector_col).alias("v"), good.alias("good"))
    first = F.min_by(F.struct("shard", "v"), F.struct("shard", F.xxhash64("v")))
    rows = named.filter("good").groupBy("id").agg(first.alias("r")).select(F.regexp_replace("r.shard", "[/|]", "_").alias("shard"), "id", F.col("r.v").alias("v"))
    rows = stored(doubles(rows, "v"))
    voters = voters_of(rows, threshold)
    for margin in [*MARGINS, None] if voters.count() >= VOTERS else [None]:
        work = stored(with_groups(shard_vectors(rows, threshold, margin)))
        if margin is not None:
            near = work.groupBy("work").applyInArrow(build, "id long, near array<long>")
            near = near.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
            work = work.join(near, "id")
        searched = stored(work.groupBy("work").applyInArrow(searcher(threshold, margin is None), "id long, n long, least long"))
        counted = stored(searched.groupBy("id").agg(F.sum("n").alias("n")))
        if margin is None or audit(voters, counted) >= RECALL:
            break
    classes = components(searched.select(F.col("id").alias("a"), F.col("least").alias("b")))
    ids = named.filter("id is not null").select("id").distinct().join(counted, "id", "left").join(classes.withColumnRenamed("node", "id"), "id", "left")
    ids = ids.unionByName(named.filter("id is null").select("id"), allowMissingColumns=True)
    component = F.coalesce("component", "id")
    return ids.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


@query("op10_near_vectors", """WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
c AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), m AS (SELECT a, min(b) AS m FROM c GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(m.m, e.vec_id) AS component_id, coalesce(m.m, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN m ON e.vec_id = m.a""")
def op10_near_vectors(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", 0.93)
