import numpy as np
import pytest

from frames import blobs, sparse_frame
from partwise.operators import rows as rw
from partwise.sources import libsvm, profile as pf, runlog


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_one_and_zero_based_files(spark, tmp_path):
    one = write(tmp_path, "one.txt", "1 1:0.5 3:2 # note\n-1 2:1e-1 4:0\n\n")
    zero = write(tmp_path, "zero.txt", "1 qid:3 0:0.5 2:2\n-1 qid:3 1:0.1\n")
    for path in (one, zero):
        got = sorted((r["row_id"], r["label"], list(r["idx"]), list(r["val"])) for r in libsvm.read_libsvm(spark, path).collect())
        assert got == [(0, 1.0, [0, 2], [0.5, 2.0]), (1, -1.0, [1], [0.1])]


def test_base_is_shared_by_the_parts_of_a_dataset(spark, tmp_path):
    train = write(tmp_path, "train.txt", "1 0:1 2:1\n")
    test = write(tmp_path, "test.txt", "1 1:1 2:1\n")              # feature 0 never occurs here
    alone = libsvm.read_libsvm(spark, test).first()["idx"]
    together = libsvm.read_libsvm(spark, test, with_files=(train,)).first()["idx"]
    assert list(alone) == [0, 1] and list(together) == [1, 2]


def test_round_trip_and_builtin_reader(spark, tmp_path):
    x, label = blobs(30)
    rows = sparse_frame(spark, x, label)
    out = str(tmp_path / "out")
    libsvm.write_libsvm(rows.select("row_id", "label", "idx", "val"), out)
    back = libsvm.read_libsvm(spark, out, base=1)
    key = lambda r: (r["label"], list(r["idx"]), list(r["val"]))
    assert sorted(map(key, back.collect())) == sorted(map(key, rows.collect()))
    assert spark.read.format("libsvm").load(out).count() == 30


def test_missing_file_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="does not exist|PATH_NOT_FOUND"):
        libsvm.read_libsvm(spark, str(tmp_path / "none.txt"), base=1).count()


def test_profile_counts_empty_rows(spark):
    rows = sparse_frame(spark, [[1, 0, 2], [0, 0, 0]], [1, 0])
    got = pf.profile(rows).collect()
    assert {r["label"]: r["label_count"] for r in got} == {0.0: 1, 1.0: 1}
    assert got[0]["n_features"] == 3 and np.isclose(got[0]["avg_sparsity"], 1 - (2 / 3) / 2)
    stats = pf.dataset_stats(rows, "here").first()
    assert (stats["filepath"], stats["n_features"], stats["n_samples"]) == ("here", 3, 2)


def test_shared_and_frequent_features(spark):
    train = rw.cells_of(sparse_frame(spark, np.ones((2, 7)), [0, 1]))
    test = rw.cells_of(sparse_frame(spark, np.ones((2, 5)), [0, 1]))
    a, b = rw.shared_features(train, test)
    assert a.agg({"feature": "max"}).first()[0] == b.agg({"feature": "max"}).first()[0] == 4
    x = np.zeros((100, 3))
    x[:2, 0], x[:3, 1], x[:, 2] = 1, 1, 1          # 2 % is dropped, 3 % stays
    rows = sparse_frame(spark, x, np.zeros(100))
    from pyspark.sql import functions as F
    kept = rw.frequent_features(rw.cells_of(rows), F.lit(100))
    assert {r["feature"]: r["new_feature"] for r in kept.collect()} == {1: 0, 2: 1}
    moved = rw.renumber(rows, kept).orderBy("row_id").collect()
    assert list(moved[0]["idx"]) == [0, 1] and list(moved[50]["idx"]) == [1]


def test_log_summary_last_match_wins(spark, tmp_path):
    write(tmp_path, "log_aloi_2.log", "x - Task type: clf\nx - Overall Accuracy: 0.5\nx - Overall Accuracy: 0.75\nx - Clustering: 3.20 seconds\n")
    write(tmp_path, "log_news_1.log", "Task type: reg\nTraining time left open\n  Training time: 1.00 seconds\nClustering enabled: True\n")
    write(tmp_path, "other.log", "Task type: clf\n")
    got = runlog.summarise(runlog.read_logs(spark, str(tmp_path))).collect()
    assert [r["Dataset"] for r in got] == ["aloi", "news"]
    assert got[0]["Overall Accuracy"] == "0.75" and got[0]["Clustering"] == "3.20" and got[0]["Overall F1 Score"] is None
    # a line is claimed by the first listed key it contains, in each section
    assert got[1]["Training time"] == "1.00" and got[1]["Clustering enabled"] == "True" and got[1]["Clustering"] is None


def test_lines_are_read_in_ranges_in_file_order(spark, tmp_path):
    from partwise.sources.textfiles import register
    folder = tmp_path / "many"
    folder.mkdir()
    lines = [[f"{i} {i % 7 + 1}:{i / 3!r}" for i in range(k, k + 200)] for k in (0, 200, 400)]
    for k, part in enumerate(lines):
        (folder / f"part-{k}.txt").write_text(("\r\n" if k == 1 else "\n").join(part) + ("" if k == 2 else "\n"))
    (folder / "_SUCCESS").write_text("")
    for size in (307, 1 << 20):
        read = register(spark).read.format("partwise_libsvm").option("rangeBytes", size).load(str(folder))
        rows = sorted((r["file"], r["line"], r["label"], r["val"][0]) for r in read.collect())
        assert [r[2] for r in rows] == list(range(600)) and [r[3] for r in rows] == [i / 3 for i in range(600)]
    assert [r["label"] for r in libsvm.read_libsvm(spark, str(folder), base=1).orderBy("row_id").collect()] == list(range(600))


def test_logs_are_written_and_read(spark, tmp_path):
    out = str(tmp_path / "logs")
    runlog.write_logs(spark.createDataFrame([("log_a_1.log", "one\ntwo"), ("log_b_1.log", "x\n"), ("other.log", "no")], "file string, text string"), out)
    got = sorted(map(tuple, runlog.read_logs(spark, out).collect()))
    assert got == [("log_a_1.log", 0, "one"), ("log_a_1.log", 1, "two"), ("log_b_1.log", 0, "x")]


def test_profile_of_bags_equals_that_of_rows(spark):
    rows = sparse_frame(spark, [[1, 0, 2], [0, 0, 0], [3, 0, 0]], [1, 0, 0])
    bags = rw.cells_of(rows).select("row_id", rw.F.concat(rw.F.lit("t"), "feature").alias("token"))
    key = lambda df: sorted((r["label"], r["label_count"], r["n_samples"]) for r in df.collect())
    assert key(pf.profile_bags(rows, bags)) == key(pf.profile(rows)) and pf.profile_bags(rows, bags).first()["n_features"] == 2


def test_tokens_are_counted_where_their_document_is_and_once(spark, tmp_path, monkeypatch):
    """Repeated and null ids add up; the query reads the documents a single time, and no cluster's cells meet in one task."""
    from partwise.plans import feature_queries as fq
    from partwise.sources import tables as tb

    texts = [(1, "a b  a"), (1, "B c"), (2, ""), (None, "a"), (None, "a d"), (3, None)]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    counts = tb.token_counts(spark, str(tmp_path), False)
    assert sorted(map(tuple, counts.collect()), key=str) == sorted([(1, "a", 2), (1, "b", 2), (1, "c", 1), (None, "a", 2), (None, "d", 1)], key=str)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and "token" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)
    made = []
    cells = tb.token_cells
    monkeypatch.setattr(tb, "token_cells", lambda *a: made.append(1) or cells(*a))
    replayed = fq.independence_replay(spark, str(tmp_path))
    assert len(made) == 1 and "hashpartitioning(cluster_id, 4)" not in replayed._jdf.queryExecution().toString()
    replayed.collect()
