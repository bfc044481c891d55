import pytest
from pyspark.sql import functions as F

from frames import blobs, sparse_frame
from partwise.functions import ranking
from partwise.operators import balance as bl
from partwise.operators import cascade as cs
from partwise.operators import kselect as ks
from partwise.operators.cascade import CascadeClusterer
from partwise.operators.clusterers import KMeans, Placed, RandomSlices, RoundRobin


@pytest.fixture(scope="module")
def points(spark):
    x, label = blobs(200, classes=4)
    return sparse_frame(spark, x + 1, label).drop("cluster_id", "copy").persist()


def test_random_sizes_differ_by_at_most_one(points):
    sizes = [r["count"] for r in RandomSlices(7).place(points).train.groupBy("cluster").count().orderBy("cluster").collect()]
    assert len(sizes) == 7 and sum(sizes) == 200 and sizes == sorted(sizes, reverse=True) and max(sizes) - min(sizes) <= 1


def test_fifo_goes_round(points):
    got = [r["cluster"] for r in RoundRobin(3).place(points).train.orderBy("row_id").collect()]
    assert got == [i % 3 for i in range(200)]


def test_kmeans_finds_the_blobs_and_predicts(points):
    model = KMeans(4).place(points)
    got = model.train.toPandas()
    assert got.groupby("label")["cluster"].nunique().max() == 1 and got["cluster"].nunique() == 4
    assert model.fit.table.count() == 4
    assert model.assign(points).toPandas()["cluster"].tolist() == got["cluster"].tolist()


def test_own_clusterer_plugs_in(points):
    class Sign:
        def place(self, samples):
            mark = lambda df: df.withColumn("cluster", (F.col("val")[0] > 3).cast("int"))
            return Placed(mark(samples), mark)

    cascade = CascadeClusterer(Sign(), cap=30)
    placed = cascade.fit_predict(points)
    assert placed.select("level0").distinct().count() == 2 and placed.select("cluster_id").distinct().count() > 2
    assert cascade.predict(points).filter("cluster_id < 0").count() == 0


def test_round_robin_takes_any_id(spark, points):
    named = points.withColumn("row_id", F.concat(F.lit("r"), F.lpad(F.col("row_id").cast("string"), 4, "0")))
    got = [r["cluster"] for r in RoundRobin(3).place(named).train.orderBy("row_id").collect()]
    assert got == [i % 3 for i in range(200)]
    spread = ranking.dense_index(points.withColumn("row_id", F.when(F.col("row_id") == 7, F.lit(1 << 60)).otherwise(F.col("row_id"))), "row_id", "p", per_bucket=40)
    assert sorted(r["p"] for r in spread.collect()) == list(range(200))


def test_centres_come_from_all_distinct_rows(spark):
    rows = [(i, [0], [float(i % 6 if i % 100 == 0 else 1)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "row_id bigint, idx array<int>, val array<double>")
    assert KMeans(3).place(df).fit.table.count() == 3


def test_scan_prefers_the_true_number(points):
    scores, _ = ks.silhouette_scan(points, [2, 3, 4, 5, 6])
    values = {r["k"]: r["score"] for r in scores.collect()}
    assert set(values) == {2, 3, 4, 5, 6} and all(-1 <= v <= 1 for v in values.values())
    assert ks.best_k(scores).first()["k"] == 4


def test_single_label_scores_minus_one_and_ties_take_the_smallest_k(spark, points):
    one = ks.silhouette(points.withColumn("labels", F.array(F.lit(0), (F.col("row_id") % 2).cast("int"))), ["a", "b"])
    assert {r["name"]: r["score"] for r in one.collect()}["a"] == -1.0
    table = spark.createDataFrame([(5, 0.5), (3, 0.5), (2, -1.0)], "k int, score double")
    assert ks.best_k(table).first()["k"] == 3


def test_gap_has_spread_and_its_rule_has_a_fallback(spark, points):
    table = ks.gap_scan(points, [2, 3, 4], n_refs=3).collect()
    assert len(table) == 3 and all(r["sk"] > 0 for r in table)
    rising = spark.createDataFrame([(2, 0.1, 0.0), (3, 0.5, 0.0), (4, 0.9, 0.0)], "k int, gap double, sk double")
    assert ks.best_k_by_gap(rising).first()["k"] == 2
    knee = spark.createDataFrame([(2, 0.1, 0.0), (3, 0.5, 0.0), (4, 0.4, 0.0)], "k int, gap double, sk double")
    assert ks.best_k_by_gap(knee).first()["k"] == 3


def test_cascade_splits_only_large_clusters(points):
    cascade = cs.CascadeClusterer(k=2, cap=60)
    got = cascade.fit_predict(points).toPandas()
    sizes = got.groupby("level0").size()
    for level0, n in sizes.items():
        parts = got[got["level0"] == level0]["level1"].unique()
        assert (set(parts) == {-1}) == (n <= 60)
    assert sorted(got["cluster_id"].unique()) == list(range(got["cluster_id"].nunique()))
    again = cascade.predict(points).toPandas().sort_values("row_id")
    assert list(again["cluster_id"]) == list(got.sort_values("row_id")["cluster_id"])


def test_cascade_checks_its_options(points):
    for bad in ({"method": "fifo"}, {"method": "random", "k": 3, "k_method": "gap"}):
        with pytest.raises(ValueError):
            cs.CascadeClusterer(**bad)
    with pytest.raises(ValueError, match="clusters"):
        cs.CascadeClusterer(k=4, cap=50).fit_predict(points.filter("row_id < 3"))


def balanced(spark, rows, **options):
    members = spark.createDataFrame(rows, "cluster_id int, row_id bigint, label double")
    return members, bl.balance(members, members.select("row_id", "label"), **options).toPandas()


def test_repair_repeats_rows_when_the_label_runs_out(spark):
    rows = [(0, i, 0.0) for i in range(55)] + [(0, 100 + i, 1.0) for i in range(5)] + [(1, 200 + i, 1.0) for i in range(10)]
    members, got = balanced(spark, rows, min_ratio=0.1)
    added = got[(got["cluster_id"] == 0) & (got["copy"] > 0)]
    # target equals the count, so half of the majority is added, from the ten rows available
    assert len(added) == 27 and set(added["row_id"]) == {200 + i for i in range(10)} and added["copy"].max() == 3


def test_repair_gives_a_single_class_cluster_a_second_class(spark):
    rows = [(0, i, float(i % 2)) for i in range(40)] + [(1, 100 + i, 0.0) for i in range(30)]
    members, got = balanced(spark, rows)
    one = got[got["cluster_id"] == 1]
    assert set(one["label"]) == {0.0, 1.0} and (one["copy"] > 0).sum() == 5
    assert not one["row_id"].duplicated().any()


def test_one_label_in_all_leaves_everything(spark):
    members, got = balanced(spark, [(0, i, 1.0) for i in range(8)] + [(1, 20 + i, 1.0) for i in range(3)])
    assert len(got) == 11


def test_long_runs_of_a_label_are_read_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(bl, "RUN", 4)
    test_repair_repeats_rows_when_the_label_runs_out(spark)


def test_centres_in_turns_give_the_same_fits(spark, monkeypatch):
    from partwise.operators import lloyd as ll

    x, label = blobs(300, classes=4, spread=1.5)
    rows = sparse_frame(spark, x + 1, label).drop("copy").withColumn("group", (F.col("row_id") % 2).cast("string")).repartition(3).persist()
    fits = ll.fit_table(spark, [ll.Fit("a", "0", 12), ll.Fit("b", "1", 3), ll.Fit("c", "1", 5)])

    def fitted():
        done = ll.run_lloyd(rows, fits, 2, n_init=2, max_rounds=5)
        table = {(r["fit_id"], r["centre"]): (list(r["c"]), r["n"], r["error"]) for r in done.table.collect()}
        labels = {r["row_id"]: r["cluster"] for r in ll.assign(rows, done.only(["a", "b"]), F.col("group")).collect()}
        both = {r["row_id"]: tuple(r["labels"]) for r in ll.assign(rows.filter("group = '1'"), done, F.col("group"), "labels", ["b", "c"]).collect()}
        return done, table, labels, both

    done, table, labels, both = fitted()
    assert done.turns == 1 and done.whole and len(table) == 20 and sum(n for _, n, _ in table.values()) == 450
    monkeypatch.setattr(ll, "PARCEL_BYTES", 64)         # four centres of two columns
    monkeypatch.setattr(ll, "TURN_BYTES", 128)
    monkeypatch.setattr(ll, "SUM_BYTES", 64)
    again, other, other_labels, other_both = fitted()
    assert again.turns > 1 and not again.whole
    assert set(table) == set(other) and all(table[k][1] == other[k][1] and abs(table[k][2] - other[k][2]) < 1e-9 for k in table)
    assert labels == other_labels and both == other_both


def test_pivots_skip_distances_and_find_the_nearest():
    import numpy as np
    from partwise.operators import lloyd as ll

    rng = np.random.default_rng(1)
    centres = np.concatenate([rng.normal(size=(40, 3)) * 0.2 + c for c in rng.normal(size=(12, 3)) * 10])
    rows = np.concatenate([centres[rng.integers(0, 480, 500)] + rng.normal(size=(500, 3)) * 0.05, centres[:20]])
    search = ll.Points(centres)
    assert (search.nearest(rows) == ll.squared_distances(rows, centres).argmin(1)).all()
    assert search.measured < 0.5 * len(rows) * len(centres)


def test_silhouette_of_many_blocks_equals_brute_force(spark, points, monkeypatch):
    import numpy as np

    monkeypatch.setattr(ks, "BLOCK_ROWS", 23)
    monkeypatch.setattr(ks, "COLUMN_CHUNK", 1)
    rows = points.withColumn("labels", F.array((F.col("row_id") % 3).cast("int"), F.when(F.col("row_id") == 5, 9).otherwise(F.col("label")).cast("int")))
    got = {r["name"]: r["score"] for r in ks.silhouette(rows, ["a", "b"]).collect()}
    local = rows.orderBy("row_id").collect()
    x = np.zeros((200, 2))
    for i, r in enumerate(local):
        x[i, list(r["idx"])] = r["val"]
    away = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for f, name in enumerate("ab"):
        label = np.array([r["labels"][f] for r in local])
        s = []
        for i in range(200):
            own = (label == label[i]) & (np.arange(200) != i)
            if not own.any():
                s.append(0.0)
                continue
            a, b = away[i, own].mean(), min(away[i, label == other].mean() for other in set(label) - {label[i]})
            s.append((b - a) / max(a, b))
        assert abs(got[name] - np.mean(s)) < 1e-9


def test_own_clusterer_predicts_from_the_features_it_was_fitted_on(points):
    seen = []

    class Widths:
        def place(self, samples):
            def mark(df):
                seen.append(df.agg(F.max(F.size("idx"))).first()[0])
                return df.withColumn("cluster", (F.col("row_id") % 2).cast("int"))
            return Placed(mark(samples), mark)

    cascade = CascadeClusterer(Widths(), entropy_ratio=0.5)
    cascade.fit_predict(points)
    assert cascade.predict(points).filter("cluster_id < 0").count() == 0
    assert len(seen) == 2 and seen[0] == seen[1] == 1


def test_silhouette_shuffles_no_pair_of_blocks(spark, monkeypatch):
    """Blocks are written once and read past each other; only rows, sums and labels go through shuffles."""
    import numpy as np

    monkeypatch.setattr(ks, "BLOCK_ROWS", 16)
    monkeypatch.setattr(ks, "PARTS", 5)
    x, label = blobs(150)
    rows = sparse_frame(spark, x, label).withColumn("labels", F.array(F.col("label").cast("int"), (F.col("row_id") % 7).cast("int")))
    scores = ks.silhouette(rows, ["a", "b"])
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "hashpartitioning(a" not in plan
    got = {r["name"]: r["score"] for r in scores.collect()}
    away = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for name, labels in (("a", label), ("b", np.arange(150) % 7)):
        own = np.array([away[i, labels == labels[i]].sum() / ((labels == labels[i]).sum() - 1) for i in range(150)])
        other = np.array([min(away[i, labels == c].mean() for c in set(labels) - {labels[i]}) for i in range(150)])
        assert np.isclose(got[name], ((other - own) / np.maximum(own, other)).mean())
