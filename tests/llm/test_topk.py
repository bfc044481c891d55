"""Top products against brute force over all rows."""

import numpy as np
import pytest

from partwise.llm import topk

SCHEMA = "vec_id long, embedding array<float>, `query` string, `cell` string, `score` string"


def brute(rows, k, query=lambda i: i % 5 == 0, scale=256):
    good = [(i, [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v]) for i, v, *_ in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in {(i, tuple(v)) for i, v in good if query(i)}:
        near = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i and len(w) == len(v))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    return sorted(out)


def answer(spark, rows, k):
    vectors = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    found = topk.search_index(topk.build_index(vectors, "vec_id", "embedding"), vectors.filter("vec_id % 5 = 0"), "vec_id", "embedding", k)
    return sorted(map(tuple, found.collect()))


def some_rows(seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8)) * 3
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * rng.choice([0.1, 1.0])).tolist()) for i in range(900)]
    rows += [(i, rows[7][1]) for i in range(900, 1200)]                                             # a group of copies: ties
    rows += [(2000, None), (2005, [float("nan")] * 8), (2010, [None] * 8), (None, rows[3][1]), (2015, [0.0] * 8), (2020, [float("inf")] + [0.0] * 7)]
    rows += [(5, rows[5][1]), (5, rows[6][1]), (10, rows[10][1]), (2025, [0.5, -1.0]), (2030, [2.0, 1.0]), (2035, []), (2040, []), (2045, [1.0])]
    return rows


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 150)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "LEAF_ROWS", 16)
    rows = some_rows()
    assert answer(spark, rows, 5) == brute(rows, 5)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=4) * 2.0 ** 21).tolist()) for i in range(200)] + [(300, [2.0 ** 21 + 0.25] * 4), (301, [2.0 ** 21] * 4), (305, [2.0 ** 21 + 0.25] * 4)]
    assert answer(spark, rows, 3) == brute(rows, 3)


def test_a_score_beyond_a_long_is_an_error(spark):
    with pytest.raises(Exception, match="OverflowError|int too big|too large"):
        answer(spark, [(0, [1e30]), (1, [1e30])], 1)


def test_empty_table(spark):
    assert answer(spark, [], 5) == [] and answer(spark, [(0, [1.0])], 5) == []


def test_tree_prunes_and_keeps_ties():
    rng = np.random.default_rng(0)
    x = np.floor(rng.normal(size=(2000, 6)) * 100)
    x[500:600] = x[3]
    ids = rng.permutation(2000).astype(np.int64)
    tree = topk.BallTree(ids, x)
    opened = []
    plain = topk.product
    try:
        topk.product = lambda a, b, exact: opened.append(a.shape[0] * b.shape[0]) or plain(a, b, exact)
        q, row, score = tree.search(ids[:40], x[:40], 5, np.full(40, -np.inf), np.full(40, 1 << 62))
    finally:
        topk.product = plain
    got = sorted((int(i), -float(s), int(tree.ids[r])) for i, r, s in zip(q, row, score))
    want = sorted((i, -s, j) for i in range(40) for s, j in sorted(((float(x[i] @ x[r]), int(ids[r])) for r in range(2000) if r != i), key=lambda p: (-p[0], p[1]))[:5])
    assert got == want
    assert sum(opened) < 0.8 * 40 * 2000
