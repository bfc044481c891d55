import numpy as np
import pytest
from pyspark.sql import functions as F

from frames import blobs, sparse_frame
from partwise.operators import evaluate as ev
from partwise.operators import svm, tuning, wrapper
from partwise.plans import sweep
from partwise.plans.pipeline import Config, Pipeline, write_run_log
from partwise.sources import profile as pf, runlog


@pytest.fixture(scope="module")
def data(spark):
    x, label = blobs(240, classes=3)
    noise = np.random.default_rng(0).normal(scale=0.2, size=(240, 3))
    return pf.split(sparse_frame(spark, np.hstack([x + 1, noise]), label).drop("cluster_id", "copy").persist())


def overall(result, metric):
    return result.metrics.filter(f"scope = 'overall' and metric = '{metric}'").first()["value"]


def test_full_classification_run(spark, data, tmp_path):
    config = Config("clf", clustering=True, k=2, cascade=True, cap=100, entropy_ratio=0.8, balance=True, independence=True,
                    construction=True, mutual_info=True, min_features=4, tune=True, n_iter=3, cv_folds=3)
    pipeline = Pipeline(config)
    result = pipeline.run(*data)
    # Rows keep only their direction after the row norm, so the three blobs touch a little.
    assert overall(result, "accuracy") > 0.8
    replayed = pipeline.predict(data[0]).toPandas()
    assert len(replayed) == 192 and (replayed["label"] == replayed["prediction"]).mean() > 0.85
    assert result.predictions.count() == 48 and result.report.filter("error is not null").count() == 0
    assert {"independence_scores", "feature_stats", "trials"} <= set(result.tables)
    write_run_log(result, str(tmp_path / "log"))
    lines = spark.read.text(str(tmp_path / "log")).select(F.lit("log_blobs_1.log").alias("file"), F.lit(0).alias("line_no"), F.col("value").alias("text"))
    row = runlog.summarise(lines).first()
    assert float(row["Overall Accuracy"]) > 0.8 and row["Dataset"] == "blobs" and float(row["Total execution time"]) > 0


def test_regression_run(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0.5, 1, size=(200, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = 3 * x[:, 0] - x[:, 1]
    train, test = pf.split(sparse_frame(spark, x, y).drop("cluster_id", "copy"))
    result = Pipeline(Config("reg", clustering=True, method="random", k=2, mutual_info=True, mutual_percent=100,
                             defaults={"kernel": "linear", "c": 100.0, "epsilon": 0.01})).run(train, test)
    assert overall(result, "r2") > 0.95


def test_searched_k_and_sweep(spark, data):
    config = Config("clf", clustering=True, k_range=(2, 4), balance=True, defaults={"kernel": "linear"}, scan_options={"n_init": 2})
    result = Pipeline(config).run(*data)
    assert result.tables["k_scores"].count() == 3
    metrics = sweep.sweep({"blobs": data}, sweep.grid(Config("clf", clustering=True, method="fifo", k=2, defaults={"kernel": "linear"}), [None], [1, 3]))
    best = sweep.best_runs(metrics, "accuracy").first()
    assert best["dataset"] == "blobs" and best["run_id"] in (0, 1)


def test_invalid_options():
    for bad in ({"task": "rank"}, {"task": "clf", "method": "fifo", "clustering": True}, {"task": "clf", "optimizer": "hill"},
                {"task": "clf", "method": "random", "k": 2, "k_method": "gap"}):
        with pytest.raises(ValueError):
            Config(**bad)


@pytest.mark.parametrize("optimizer", ["random", "bayes", "tpe"])
def test_search_finds_good_parameters(spark, optimizer):
    x, label = blobs(120, classes=2, spread=0.8)
    rows = svm.assign_folds(sparse_frame(spark, x, label, np.arange(120) // 60), 3, "clf")
    job = svm.SvmJob(rows, "clf", landmarks=16)
    trials, best = tuning.tune(job, rows.select("cluster_id").distinct(), optimizer, n_iter=5, n_initial=3)
    assert trials.count() == 10 and all(r["best_score"] > 0.9 for r in best.collect())


def test_wrapper_keeps_the_useful_columns(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 6))
    label = (x[:, 2] > 0).astype(int)
    rows = svm.assign_folds(sparse_frame(spark, x, label), 3, "clf")
    job = svm.SvmJob(rows, "clf")
    shape = spark.createDataFrame([(0, 6)], "cluster_id int, d int")
    options = wrapper.SwarmOptions(bees=6, generations=2, elite=2, best=1, elite_bees=1, best_bees=1, elite_steps=1, best_steps=1, min_features=1)
    best = wrapper.select_features(job, shape, options).first()
    assert best["mask"][2] and best["fitness"] > 0.9


def test_q_update_follows_the_rule(spark):
    q = spark.createDataFrame([(0, "01", 1, 2.0), (0, "10", 0, 1.0)], "cluster_id int, state string, action int, value double")
    moves = spark.createDataFrame([(0, "10", 0, 0.5, "01"), (0, "10", 1, 0.2, "11")], "cluster_id int, state string, action int, reward double, next_state string")
    got = {(r["state"], r["action"]): r["value"] for r in wrapper.update_q(q, moves, 0.1, 0.9).collect()}
    assert np.isclose(got[("10", 0)], 1.0 + 0.1 * (0.5 + 0.9 * 2.0 - 1.0)) and np.isclose(got[("10", 1)], 0.02) and got[("01", 1)] == 2.0


def test_metric_edge_cases(spark):
    p = spark.createDataFrame([(0, 0, 1.0, 1.0), (1, 0, 1.0, 0.0), (2, 1, 2.0, 2.0)], "row_id bigint, cluster_id int, label double, prediction double")
    r2 = {r["cluster_id"]: r["r2"] for r in ev.r2(p).collect()}
    assert r2[0] == 0.0 and np.isnan(r2[1])
    with pytest.raises(ValueError):
        ev.merge_predictions(p.select("row_id", "prediction"), p.select("row_id", "label").filter("row_id < 2"))


@pytest.mark.parametrize("name", ["split_train_test", "balanced_clusters", "quantile_edges", "mutual_info_clf", "kmeans_fit", "r2", "route_linear_predict"])
def test_registered_queries_match_their_sql(spark, sf, name):
    import __spark_entry__ as entry
    from oracle import compare, connect

    ok, text = compare(connect(sf), spark, sf, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, text


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_cluster_without_frequent_features_is_dropped_and_own_clusterers_run(spark):
    class Halves:
        def place(self, samples):
            from partwise.operators.clusterers import Placed
            mark = lambda df: df.withColumn("cluster", (F.col("row_id") >= 40).cast("int"))
            return Placed(mark(samples), mark)

    rng = np.random.default_rng(2)
    x = rng.uniform(0.5, 1.0, (80, 4))
    x[40:] *= np.arange(4)[None, :] == np.arange(40)[:, None] % 4       # in the second half each feature stands at a quarter
    train = sparse_frame(spark, x, np.arange(80) % 2).drop("cluster_id", "copy")
    pipeline = Pipeline(Config("clf", clustering=True, method=Halves(), nonzero_ratio=0.5, defaults={"kernel": "linear"})).fit(train)
    assert [r["cluster_id"] for r in pipeline.tables["dropped_clusters"].collect()] == [1]
    assert [r["cluster_id"] for r in pipeline.models.select("cluster_id").distinct().collect()] == [0]
    with pytest.raises(ValueError, match="no model"):
        pipeline.predict(train)


def test_unreadable_dataset_and_failed_run_are_rows(spark, data):
    report = pf.profile_report({"good": data[0], "bad": spark.range(3)})
    assert report.filter("dataset = 'bad' and error is not null").count() == 1 and report.filter("dataset = 'good' and error is null").count() == 3
    one_class = tuple(part.withColumn("label", F.lit(1.0)) for part in data)
    configs = [Config("clf", clustering=True, method="fifo", k=2, defaults={"kernel": "linear"})]
    runs = sweep.sweep({"good": data, "bad": one_class}, configs)
    assert runs.filter("error is not null").select("dataset").distinct().collect()[0][0] == "bad"
    assert sweep.best_runs(runs, "accuracy").count() == 1
