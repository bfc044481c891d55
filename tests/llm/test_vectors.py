import math

import numpy as np
import pytest

from partwise.llm import near, neighbours, vectors
from partwise.llm.near import near_duplicates, prune
from partwise.llm.neighbours import VantageTree, build_index, search_index

SCHEMA = "vec_id long, embedding array<float>, label int, v string, id string, shard string, score string, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None, None) for r in rows], SCHEMA)


def odd_rows():
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).astype(float).tolist(), i % 2) for i in range(60)]
    rows += [(100 + i, rows[i][1], rows[i][2]) for i in range(0, 20, 2)]                        # exact copies
    rows += [(200, None, 0), (201, [0.0] * 8, 0), (202, [None] + [1.0] * 7, 0), (203, [float("nan")] + [1.0] * 7, 1),
             (204, [float("inf")] + [1.0] * 7, 1), (None, rows[0][1], 0), (205, rows[1][1], None), (206, (np.array(rows[3][1]) * 1e-30).tolist(), 1)]
    rows += [rows[5], rows[5]]
    return rows


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    a, b = np.float64(np.float32(a)), np.float64(np.float32(b))
    return float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b))


def test_exact_search_of_odd_rows(spark):
    rows = odd_rows()
    df = frame(spark, rows).filter("vec_id is not null")
    index, shards = build_index(df, "vec_id", "embedding")
    got = {}
    for r in search_index(index, shards, df.filter("vec_id % 3 = 0"), "vec_id", "embedding", 4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = [(i, v) for i, v, _ in rows if i is not None and fine(v)]
    queries = {i: v for i, v in good if i % 3 == 0}
    assert set(got) == set(queries)
    for q, found in got.items():
        want = sorted((-round(cosine(queries[q], v), 9), i) for i, v in good if i != q)[:4]
        assert [(-round(s, 9), i) for _, i, s in sorted(found)] == want


def test_few_rows_and_none(spark):
    df = frame(spark, odd_rows()[:3])
    index, shards = build_index(df, "vec_id", "embedding")
    assert search_index(index, shards, df, "vec_id", "embedding", 5).count() == 6
    index, shards = build_index(df.limit(0), "vec_id", "embedding")
    assert search_index(index, shards, df, "vec_id", "embedding", 5).count() == 0


def test_many_copies_come_by_id():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((3000, 24))
    x[rng.choice(3000, 900, replace=False)] = x[17]
    same = np.flatnonzero((x == x[17]).all(axis=1))
    order = rng.permutation(3000)
    tree = VantageTree(order, x[order])
    for count in (1, 3, 50, 700):
        mine = rng.choice(same, count, replace=False)
        found = tree.ids[tree.search(mine, x[mine], 5, 1.0)]
        assert all(f.tolist() == same[same != i][:5].tolist() for i, f in zip(mine, found, strict=True))


def test_factor_trades_recall_for_work():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 6)) + 4 * rng.standard_normal((30, 6))[rng.integers(30, size=3000)]
    tree = VantageTree(np.arange(3000), x)
    q = x[:200] + 0.1 * rng.standard_normal((200, 6))
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    true = np.argsort(-(unit(q) @ unit(x).T), axis=1)[:, :5]
    calls = []
    whole = VantageTree.distances
    work = {}
    for factor in (1.0, 1.5, 4.0):
        calls.clear()
        tree.distances = lambda a, rows: (calls.append(len(a) * len(rows)), whole(tree, a, rows))[1]
        found = tree.search(np.full(200, -1), q, 5, factor)
        work[factor] = sum(calls), np.mean([len(set(a) & set(b)) / 5 for a, b in zip(found, true, strict=True)])
    assert work[1.0][1] == 1.0 and work[1.0][0] < 200 * 3000
    assert work[4.0][0] < work[1.5][0] < work[1.0][0] and work[1.5][1] >= 0.9


def links(rows, threshold):
    best = {}
    for i, v, label in rows:
        if i is not None and label is not None and fine(v):
            best.setdefault(i, (v, label))
    parent = {i: i for i, _, _ in rows}
    count = dict.fromkeys(parent, 0)

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(best)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if best[a][1] == best[b][1] and cosine(best[a][0], best[b][0]) >= threshold:
                count[a] += 1
                count[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (count[i], find(i) if i is not None else None) for i in parent}


@pytest.mark.parametrize("shard", [1500, 60])
def test_near_vectors(spark, shard, monkeypatch):
    monkeypatch.setattr(near, "SHARD_ROWS", shard)
    rng = np.random.default_rng(3)
    rows = odd_rows()
    for c in range(12):
        centre = rng.standard_normal(8)
        rows += [(1000 + 50 * c + i, (centre + 0.12 * rng.standard_normal(8)).tolist(), c % 2) for i in range(25)]
    ball = rng.standard_normal(8)
    rows += [(5000 + i, (ball + 0.02 * rng.standard_normal(8)).tolist(), 1) for i in range(150)]
    out = near_duplicates(frame(spark, rows), "vec_id", "embedding", "label", 0.93).collect()
    want = links(rows, 0.93)
    got = {r.vec_id: (r.n_links, r.component_id) for r in out}
    assert len(out) == len(set(want)) and got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.97 * len(want)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in out)


@pytest.mark.parametrize("pairs", [20, 120])
def test_wide_pairs_beside_many_copies(spark, pairs, monkeypatch):
    monkeypatch.setattr(near, "SHARD_ROWS", 60)
    rng = np.random.default_rng(11)
    unit = lambda a: a / np.linalg.norm(a, axis=-1, keepdims=True)
    one = unit(rng.standard_normal((pairs, 8)))
    side = rng.standard_normal((pairs, 8))
    side = unit(side - (side * one).sum(axis=1, keepdims=True) * one)
    turn = np.radians(rng.uniform(15, 21, (pairs, 1)))
    ends = np.concatenate([one, np.cos(turn) * one + np.sin(turn) * side, rng.standard_normal((150, 8))])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(ends)] + [(1000 + i, ends[-1].tolist(), 0) for i in range(len(ends) // 2)]
    want = links(rows, 0.93)
    got = {r.vec_id: r.n_links for r in near_duplicates(frame(spark, rows), "vec_id", "embedding", "label", 0.93).collect()}
    assert np.mean([got[i] == want[i][0] for i in range(2 * pairs)]) >= 0.97


def test_near_vectors_of_nothing(spark):
    assert near_duplicates(frame(spark, odd_rows()).limit(0), "vec_id", "embedding", "label", 0.93).count() == 0


def test_pruning_keeps_the_nearest_and_spreads():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((200, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = prune(x @ x.T)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    assert (graph[:, 0] == s.argmax(axis=1)).all()
    assert neighbours.LEAF_ROWS and all(len(set(g[g >= 0])) == (g >= 0).sum() for g in graph)


def test_a_tree_is_sent_once_for_a_turn_of_query_blocks(spark, monkeypatch):
    """Trees and blocks travel as rows of their own, so no row pairs a tree with a block, and no join holds them together."""
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 40)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 10)
    monkeypatch.setattr(neighbours, "TURN_BLOCKS", 2)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 6)).round(1)
    x[150:] = x[:50]
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    index, shards = build_index(rows, "vec_id", "embedding")
    found = search_index(index, shards, rows.filter("vec_id % 3 = 0"), "vec_id", "embedding", 4)
    assert shards > 3 and "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    cos = vectors.cosine(np.repeat(x, 200, 0), np.tile(x, (200, 1))).reshape(200, 200)
    for q in range(0, 200, 3):
        assert got[q] == [i for i in np.lexsort((np.arange(200), -cos[q])) if i != q][:4]
