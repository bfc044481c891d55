import numpy as np
import pytest

from frames import blobs, params, sparse_frame
from partwise.functions import kernels as kn
from partwise.operators import svm


def fit_and_predict(spark, rows, task, ps, **options):
    job = svm.SvmJob(rows, task, **options)
    models = job.train(ps).persist()
    out = svm.predict(rows, models, ps, svm.train_shape(job.blocks), task, job.marks).toPandas()
    got = models.toPandas()
    job.release()
    return got, out


@pytest.mark.parametrize("kernel", ["linear", "rbf", "poly"])
def test_separable_classes_are_learned(spark, kernel):
    x, label = blobs(150)
    rows = sparse_frame(spark, x + 1, label, np.arange(150) % 2)
    models, out = fit_and_predict(spark, rows, "clf", params(spark, [0, 1], [{"kernel": kernel, "c": 10.0}]))
    assert len(models) == 2 * 3 and models["error"].isna().all()
    assert (out["label"] == out["prediction"]).mean() > 0.97


@pytest.mark.parametrize("task,kernel", [("clf", "linear"), ("clf", "rbf"), ("reg", "linear"), ("reg", "rbf")])
def test_many_blocks_reach_the_same_minimum_as_one(spark, task, kernel):
    x, label = blobs(300, spread=2.0)
    y = label if task == "clf" else x @ [1.5, -2.0] + 0.3 + 0.1 * np.sin(9 * x[:, 0])
    rows = sparse_frame(spark, x, y)
    ps = params(spark, [0], [{"kernel": kernel, "c": 0.5, "gamma": 0.3}])
    one, _ = fit_and_predict(spark, rows, task, ps)
    many, _ = fit_and_predict(spark, rows, task, ps, block_rows=64)
    key = ["class_pos", "class_neg"]
    one, many = one.sort_values(key), many.sort_values(key)
    assert list(one["n_train"]) == list(many["n_train"])
    assert np.allclose(one["objective"], many["objective"], rtol=1e-7)
    for a, b in zip(one["weights"], many["weights"]):
        assert np.allclose(a, b, atol=1e-5)


def test_solution_has_zero_gradient():
    rng = np.random.default_rng(0)
    x = np.hstack([rng.standard_normal((200, 5)), np.ones((200, 1))])
    y = np.where(x @ rng.standard_normal(6) + rng.standard_normal(200) > 0, 1.0, -1.0)
    state = kn.solve_rows(x, y, 2.0, "clf", 0.1, 50)
    slack = np.maximum(0, 1 - y * (x @ state.w))
    gradient = np.append(state.w[:-1], 0) - 2 * 2.0 * x.T @ (slack * y)
    assert np.abs(gradient).max() < 1e-6


def test_linear_regression_is_recovered(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 3))
    y = x @ [1.0, 2.0, -1.0] + 0.5
    rows = sparse_frame(spark, x, y)
    _, out = fit_and_predict(spark, rows, "reg", params(spark, [0], [{"kernel": "linear", "c": 1000.0, "epsilon": 0.001}]))
    assert np.abs(out["label"] - out["prediction"]).max() < 0.01


def test_failures_are_recorded_and_unknown_clusters_named(spark):
    x, label = blobs(60, classes=2)
    cluster = np.where(label == 0, np.arange(60) % 3, 0)         # clusters 1 and 2 hold one class
    rows = sparse_frame(spark, x, label, cluster)
    ps = params(spark, [0, 1, 2], [{}])
    job = svm.SvmJob(rows, "clf")
    models = job.train(ps)
    report = {r["cluster_id"]: r["error"] for r in svm.train_report(models, "clf").collect()}
    assert report[0] is None and report[1] == "one class" and report[2] == "one class"
    with pytest.raises(ValueError, match=r"\[1, 2\]"):
        svm.predict(rows, models, ps, svm.train_shape(job.blocks), "clf", job.marks)


def test_missing_labels_are_rejected(spark):
    from pyspark.sql import functions as F
    x, label = blobs(20, classes=2)
    rows = sparse_frame(spark, x, label).withColumn("label", F.when(F.col("row_id") > 1, F.col("label")))
    with pytest.raises(ValueError, match="label"):
        svm.SvmJob(rows, "clf")


@pytest.mark.parametrize("block_rows", [8192, 64])
def test_cross_validation_counts_every_row_once_per_trial(spark, block_rows):
    x, label = blobs(160, classes=2, spread=1.5)
    rows = svm.assign_folds(sparse_frame(spark, x, label), 4, "clf")
    job = svm.SvmJob(rows, "clf", block_rows=block_rows)
    scores = job.cross_validate(params(spark, [0], [{"c": 1.0}, {"kernel": "rbf"}])).toPandas()
    assert list(scores.groupby("trial")["n"].sum()) == [160, 160]
    assert (scores.groupby("trial")["hits"].sum() > 130).all()


@pytest.mark.parametrize("d", [500, 520])
def test_wide_linear_fits_are_exact(spark, d):
    rng = np.random.default_rng(d)
    x = rng.standard_normal((1500, d))
    label = (x[:, 0] + x[:, 1] > 0).astype(float)
    rows = sparse_frame(spark, x, label)
    job = svm.SvmJob(rows, "clf")
    one = job.train(params(spark, [0], [{"c": 1.0}])).toPandas()
    assert len(one["weights"][0]) == d + 1
    guess = x @ np.asarray(one["weights"][0])[:-1] + one["weights"][0][-1] > 0
    first = float(one["class_pos"][0])
    assert ((guess == (first == 1.0)) == (label == 1.0)).mean() == 1.0


def test_matrix_free_and_gram_fits_agree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 12)) + 0.5
    label = (x[:, 0] + 0.5 * rng.standard_normal(300) > 0.5).astype(float)
    rows = sparse_frame(spark, x, label)
    for task in ("clf", "reg"):
        found = []
        for most in (2048, 4):
            monkeypatch.setattr(kn, "GRAM_COLUMNS", most)
            job = svm.SvmJob(rows, task, block_rows=64)
            found.append(job.train(params(spark, [0], [{"c": 0.5}])).toPandas())
        assert np.allclose(found[0]["weights"][0], found[1]["weights"][0], atol=1e-5)
        assert found[0]["objective"][0] == pytest.approx(found[1]["objective"][0], rel=1e-8)


def test_more_columns_than_rows(spark):
    rng = np.random.default_rng(5)
    phi = np.hstack([rng.standard_normal((40, 90)), np.ones((40, 1))])
    target = np.sign(rng.standard_normal(40))
    state = kn.solve_rows(phi, target, 0.1, "clf", 0.0, 50)
    slope = np.append(state.w[:-1], 0.0) + 0.2 * kn.slopes(phi, target, state.w, "clf", 0.0)[0]
    assert np.abs(slope).max() < 1e-6


@pytest.mark.parametrize("block_rows", [8192, 700])
def test_grown_landmarks_reach_the_exact_kernel(spark, block_rows):
    rng = np.random.default_rng(6)
    x = rng.uniform(0.0, 6.0, (2000, 2)) + 0.01
    label = ((np.floor(x[:, 0]) + np.floor(x[:, 1])) % 2).astype(float)           # a chequerboard
    train, test = x[:1600], x[1600:]
    gamma, c = 4.0, 1.0
    phi = kn.feature_map(x, "rbf", gamma, train)                                   # every row is a landmark: the kernel itself
    state = kn.solve_rows(phi[:1600], np.where(label[:1600] == 1, 1.0, -1.0), c, "clf", 0.0, 50)
    exact = ((phi[1600:] @ state.w > 0) == (label[1600:] == 1)).mean()
    ps = params(spark, [0], [{"kernel": "rbf", "c": c, "gamma": gamma}])
    job = svm.SvmJob(sparse_frame(spark, train, label[:1600]), "clf", block_rows=block_rows)
    job.grow(ps, 0.001)
    found = job.residuals.first()
    assert found["landmarks"] > 64 and found["kernel_residual"] <= 0.001
    models = job.train(ps).persist()
    held = sparse_frame(spark, test, label[1600:])
    out = svm.predict(held, models, ps, svm.train_shape(job.blocks), "clf", job.marks).toPandas()
    assert abs((out["label"] == out["prediction"]).mean() - exact) <= 0.01 and exact > 0.85


def test_points_travel_in_turns(spark, monkeypatch):
    x, label = blobs(300, classes=3, spread=2.0)
    rows = sparse_frame(spark, x, label)
    ps = params(spark, [0], [{"c": 0.1 * (i + 1)} for i in range(12)])
    once = svm.SvmJob(rows, "clf", block_rows=64).train(ps).toPandas()
    monkeypatch.setattr(svm, "TURN_BYTES", 300)
    monkeypatch.setattr(svm, "SUM_BYTES", 200)
    turns = svm.SvmJob(rows, "clf", block_rows=64).train(ps).toPandas()
    key = ["trial", "class_pos", "class_neg"]
    assert len(turns) == 36 and np.allclose(once.sort_values(key)["objective"], turns.sort_values(key)["objective"], rtol=1e-9)
