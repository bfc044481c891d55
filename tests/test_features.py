import numpy as np
import pytest
from pyspark.sql import functions as F

from frames import sparse_frame
from partwise.operators import construct as ct
from partwise.operators import entropy as en
from partwise.operators import independence as ind
from partwise.operators import mutual as mi
from partwise.operators import rows as rw


def mixed(n=240, seed=5):
    """Columns: normal, mostly zero informative, mostly zero noise, constant, all zero, ties."""
    rng = np.random.default_rng(seed)
    label = np.arange(n) % 2
    x = np.zeros((n, 6))
    x[:, 0] = rng.normal(size=n)
    x[:, 1] = np.where((rng.random(n) < 0.3) & (label == 1), 1 + rng.random(n), 0)
    x[:, 2] = np.where(rng.random(n) < 0.15, 1 + rng.random(n), 0)
    x[:, 3] = 2.5
    x[:, 5] = rng.integers(0, 4, n)
    return x, label


def dense(df, n, d):
    out = np.zeros((n, d))
    for r in df.collect():
        out[r["row_id"], list(r["idx"])] = r["val"]
    return out


def brute_mutual(x, label, u):
    """Direct counts of Ross's estimator with the same offsets."""
    psi = lambda n: -0.5772156649015329 + sum(1.0 / i for i in range(1, int(n)))
    scores = []
    for c in x.T:
        s = c.std() or 1.0
        v = c / s + 1e-10 * max(1.0, np.abs(c / s).mean()) * (2 * u - 1)
        total = []
        for i in range(len(v)):
            same = np.abs(np.delete(v[label == label[i]], np.flatnonzero(np.flatnonzero(label == label[i]) == i)) - v[i])
            k = min(3, len(same))
            r = np.sort(same)[k - 1]
            m = (np.abs(v - v[i]) < r * (1 - 1e-13)).sum()
            total.append(psi(k) - psi(len(same) + 1) - psi(m))
        scores.append(max(0.0, psi(len(v)) + float(np.mean(total))))
    return np.array(scores)


@pytest.mark.parametrize("per_bucket", [500_000, 40])
def test_mutual_information_equals_brute_force(spark, per_bucket):
    x, label = mixed()
    rows = sparse_frame(spark, x, label)
    shape = spark.createDataFrame([(0, 6)], "cluster_id int, d int")
    u = np.array([r["u"] for r in rows.withColumn("u", mi.hash_uniform(42, "row_id", "copy")).orderBy("row_id").collect()])
    got = {r["feature"]: r["score"] for r in mi.mutual_information(rows, shape, per_bucket=per_bucket).collect()}
    assert np.allclose([got[f] for f in range(6)], brute_mutual(x, label, u), atol=1e-8)
    assert got[1] > got[2] + 0.05      # an informative sparse column ranks above a noisy one


def test_mutual_information_of_rare_labels_and_several_clusters_moves_no_row_per_cell(spark):
    """Labels of two rows whose neighbours lie several ranges away, a label of one row, a null label, a NaN column; large and small clusters."""
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(300, 2)), 2)
    label = np.concatenate([np.arange(20) // 2 + 5, rng.integers(0, 2, 279), [99]]).astype(float)
    cluster = np.where(np.arange(300) % 10 == 3, 1, 0)
    wide = np.column_stack([x, np.where(np.arange(300) == 50, np.nan, 1.0)])
    rows = sparse_frame(spark, wide, label, cluster).unionByName(sparse_frame(spark, [[1.0]], [0.0]).withColumn("label", mi.F.lit(None).cast("double")))
    shape = spark.createDataFrame([(0, 3), (1, 3)], "cluster_id int, d int")
    u = np.array([r["u"] for r in rows.filter("label is not null").withColumn("u", mi.hash_uniform(42, "row_id", "copy")).orderBy("row_id").collect()])
    scores = mi.mutual_information(rows, shape, per_bucket=60)
    plan = scores._jdf.queryExecution().toString()
    assert "posexplode" not in plan and "lag(" not in plan
    got = {(r["cluster_id"], r["feature"]): r["score"] for r in scores.collect()}
    for c in (0, 1):
        many = [i for i in np.flatnonzero(cluster == c) if (label[cluster == c] == label[i]).sum() > 1]
        assert np.allclose([got[c, 0], got[c, 1]], brute_mutual(x[many], label[many], u[many]), atol=1e-8)
    assert got[0, 2] == 0.0 and len(got) == 6


@pytest.mark.parametrize("per_bucket", [1_000_000, 20])
def test_quantile_edges_equal_numpy(spark, per_bucket):
    x, label = mixed()
    rows = sparse_frame(spark, x, label)
    top = spark.createDataFrame([(0, f, len(x)) for f in range(6)], "cluster_id int, feature int, n bigint")
    got = {r["feature"]: r["edges"] for r in ct.quantile_edges(rw.cells_of(rows, "cluster_id", "row_id"), top, 5, per_bucket).collect()}
    for f in range(6):
        raw = np.quantile(x[:, f], np.linspace(0, 1, 6))
        assert np.allclose(got[f], raw[np.diff(raw, prepend=-np.inf) > 1e-8])


def test_construction_matches_numpy_and_replays(spark):
    x, label = mixed()
    rows = sparse_frame(spark, x, label)
    shape = spark.createDataFrame([(0, len(x), 6)], "cluster_id int, n bigint, d int")
    state = ct.fit_construction(rw.cells_of(rows, "cluster_id", "row_id"), shape, 0.3)
    width = ct.constructed_width(state).first()["d"]
    got = dense(ct.construct(rows, state), len(x), width)
    assert np.allclose(got[:, :6], x)
    std = np.where(x.std(0) == 0, 1, x.std(0))
    assert np.allclose(got[:, 6:12], (x - x.mean(0)) / std)
    hot = got[:, 12:width - 30]
    assert np.allclose(hot.sum(1), 2) and set(np.unique(hot)) <= {0.0, 1.0}
    pair = got[:, width - 30:]
    assert np.allclose(pair[:, 0], x[:, 0] * x[:, 1])
    assert np.allclose(pair[:, 1], np.divide(x[:, 0], x[:, 1], out=np.zeros(len(x)), where=x[:, 1] != 0))
    stranger = rows.withColumn("cluster_id", F.lit(9))
    assert np.allclose(dense(ct.construct(stranger, state), len(x), 6), x)


def test_entropy_handles_zero_and_constant_columns(spark):
    x, label = mixed()
    rows = sparse_frame(spark, x, label)
    got = {r["feature"]: r["entropy"] for r in en.feature_entropy(rw.cells_of(rows), F.lit(len(x)), F.lit(6)).collect()}
    for f in range(6):
        lo, hi = x[:, f].min(), x[:, f].max()
        bins = np.zeros(len(x), int) if lo == hi else np.minimum(19, np.floor((x[:, f] - lo) / (hi - lo) * 20)).astype(int)
        p = np.bincount(bins) / len(x)
        assert np.isclose(got[f], -(p * np.log2(p + 1e-9)).sum())
    assert [r["feature"] for r in en.entropy_select(spark.createDataFrame(list(got.items()), "feature int, entropy double"), 0.3).orderBy("rank").collect()] == [3, 4]
    with pytest.raises(ValueError):
        en.entropy_select(spark.createDataFrame([(0, 1.0)], "feature int, entropy double"), 0.3, "middle")


def test_subset_keeps_only_chosen_columns(spark):
    x, label = mixed(50)
    kept = en.keep_subset(sparse_frame(spark, x, label), spark.createDataFrame([(0,), (5,)], "feature int"))
    got = dense(kept, 50, 6)
    assert np.allclose(got[:, [0, 5]], x[:, [0, 5]]) and np.allclose(got[:, 1:5], 0)


def test_selection_rules(spark):
    scores = spark.createDataFrame([(0, f, s) for f, s in enumerate([0.5, 0.1, 0.4, 0.1, 0.1, 0.9])] + [(1, f, 0.0) for f in range(6)],
                                   "cluster_id int, feature int, score double")
    got = mi.select_features(scores, 50, 3).filter("selected").collect()
    assert sorted(r["feature"] for r in got if r["cluster_id"] == 0) == [0, 2, 5]
    assert sorted(r["feature"] for r in got if r["cluster_id"] == 1) == [0, 1, 2]      # all tied: column order
    few = mi.select_features(scores, 10, 4).filter("selected and cluster_id = 0").collect()
    assert len(few) == 4 and {r["method"] for r in few} == {"k_best"}


def test_independence_fallback_and_replay(spark):
    scores = spark.createDataFrame([(0, 0, 0.0), (0, 1, 0.9), (0, 2, 0.8), (1, 0, 0.0), (1, 1, 0.0)], "cluster_id int, feature int, score double")
    chosen = ind.independence_select(scores, 0.5)
    kept = {(r["cluster_id"], r["feature"]): r["out_feature"] for r in chosen.filter("selected").collect()}
    assert kept == {(0, 1): 0, (0, 2): 1, (1, 0): 0, (1, 1): 1}
    x = np.array([[1.0, 2, 3], [4, 5, 0], [7, 8, 9]])
    rows = sparse_frame(spark, x, [0, 0, 0], [0, 0, 7])
    moved = rw.apply_selection(rows, rw.selection_map(ind.as_selection(chosen)))
    assert np.allclose(dense(moved, 3, 3), [[2, 3, 0], [5, 0, 0], [7, 8, 9]])


def test_norms_leave_zero_rows(spark):
    x = np.array([[3.0, -4, 0], [0, 0, 0]])
    rows = sparse_frame(spark, x, [0, 1])
    for norm, want in (("l2", 5), ("l1", 7), ("max", 4)):
        assert np.allclose(dense(rw.normalize(rows, norm), 2, 3), x / want)
    with pytest.raises(ValueError):
        rw.normalize(rows, "l3")


def test_sparse_scores_equal_the_grid(spark):
    rng = np.random.default_rng(8)
    held = rng.random((60, 9)) < 0.4
    held[:, 7:] = False
    held[::3, 2] = False
    cluster = np.arange(60) % 3
    cells = spark.createDataFrame([(int(cluster[r]), int(f), 1.0) for r, f in np.argwhere(held)], "cluster_id int, feature int, value double")
    sizes = spark.createDataFrame([(c, 20) for c in range(3)], "cluster_id int, n bigint")
    found = ind.Independence(cells, sizes, 9)
    want = {}
    for c in range(3):
        for f in range(9):
            a = held[cluster == c, f].sum()
            b, cc, d = held[:, f].sum() - a, 20 - a, 40 - (held[:, f].sum() - a)
            want[c, f] = ((a + 1) * (d + 1) - (b + 1) * (cc + 1)) ** 2 / ((a + b + 1) * (a + cc + 1) * (cc + b + 1) * (cc + d + 1))
    got = {(r["cluster_id"], r["feature"]): r["score"] for r in found.scores().collect()}
    assert set(got) == set(want) and all(np.isclose(got[k], want[k]) for k in want)
    for threshold in (1e-4, 0.05, 0.2, 9.0):
        hit = sorted(k for k in want if want[k] >= threshold)
        chosen = sorted((r["cluster_id"], r["in_feature"], r["out_feature"]) for r in found.selection(threshold).collect())
        assert chosen == [(c, f, [x for d, x in hit if d == c].index(f)) for c, f in hit]
        full = found.select(threshold).collect()
        empty = {c for c in range(3) if not any(d == c for d, _ in hit)}
        assert len(full) == 27 and all(r["selected"] == ((r["cluster_id"], r["feature"]) in hit or r["cluster_id"] in empty) for r in full)


def test_entropy_subset_keeps_all_rows(spark):
    rows = sparse_frame(spark, [[1, 0, 2], [0, 0, 0], [0, 3, 4]], [0, 1, 0])
    got = {r["row_id"]: (list(r["idx"]), list(r["val"])) for r in en.keep_subset(rows, spark.createDataFrame([(2,), (1,)], "feature int")).collect()}
    assert got == {0: ([2], [2.0]), 1: ([], []), 2: ([1, 2], [3.0, 4.0])}
