import numpy as np
import pytest
from pyspark.sql import functions as F

from partwise.functions import ranking as rk
from partwise.functions.hashing import hash_key
from partwise.sources import profile as pf
from frames import blobs, sparse_frame


@pytest.mark.parametrize("parts", [1, 7])
def test_hash_rank_matches_one_big_sort_for_any_partitioning(spark, parts):
    df = spark.range(500).repartition(parts).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise("b"))
    got = rk.hash_rank(df, ["g"], ["id"], 42, prefix=1).collect()
    keyed = df.withColumn("h", hash_key(42, "id")).collect()
    for g in ("hot", "b"):
        want = [r["id"] for r in sorted((r for r in keyed if r["g"] == g), key=lambda r: r["h"])]
        assert [r["id"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])] == want


def test_first_by_hash_is_the_head_of_the_rank(spark):
    df = spark.range(300).withColumn("g", F.col("id") % 2)
    head = {(r["g"], r["id"], r["rank"]) for r in rk.first_by_hash(df, ["g"], ["id"], 7, 42).collect()}
    full = {(r["g"], r["id"], r["rank"]) for r in rk.hash_rank(df, ["g"], ["id"], 42).collect() if r["rank"] <= 7}
    assert head == full and len(head) == 14


def test_dense_index_over_gaps(spark):
    df = spark.createDataFrame([(int(v),) for v in [5, 900, 7, 100000, 6, -3]], "k bigint")
    got = rk.dense_index(df, "k", "p", per_bucket=2).collect()
    assert [r["k"] for r in sorted(got, key=lambda r: r["p"])] == [-3, 5, 6, 7, 900, 100000]
    assert sorted(r["p"] for r in got) == list(range(6))


@pytest.mark.parametrize("size", [0, 1, 37, 400])
def test_sample_has_exactly_the_wanted_size(spark, size):
    df = spark.range(400)
    limit = rk.sample_threshold(df, ["id"], size, 42)
    assert df.filter(rk.sort_key(["id"], 42) <= limit).count() == size


def test_split_is_disjoint_complete_and_exact(spark):
    x, label = blobs(101)
    train, test = pf.split(sparse_frame(spark, x, label))
    a, b = {r["row_id"] for r in train.collect()}, {r["row_id"] for r in test.collect()}
    assert len(b) == 21 and not a & b and len(a | b) == 101


@pytest.mark.parametrize("per_bucket", [5, 40, 10_000])
def test_cumulative_weight_is_the_same_with_and_without_ranges(spark, per_bucket):
    rng = np.random.default_rng(3)
    rows = [(g, float(v), int(w)) for g in (0, 1) for v, w in zip(np.unique(rng.normal(size=200)), rng.integers(1, 9, 200))]
    df = spark.createDataFrame(rows, "g int, v double, w bigint")
    got = {(r["g"], r["v"]): (r["below"], r["total"]) for r in rk.cumulative_weight(df, ["g"], "v", "w", "below", "total", per_bucket).collect()}
    for g in (0, 1):
        running, mine = 0, sorted((v, w) for h, v, w in rows if h == g)
        for v, w in mine:
            assert got[(g, v)] == (running, sum(w for _, w in mine))
            running += w


def test_bucket_of_is_a_right_sided_search(spark):
    bounds = [float(v) for v in range(0, 300, 3)]
    values = [-1.0, 0.0, 0.5, 3.0, 149.9, 150.0, 297.0, 400.0]
    df = spark.createDataFrame([(v, bounds) for v in values], "v double, b array<double>")
    got = {r["v"]: r["k"] for r in df.select("v", rk.bucket_of(F.col("v"), F.col("b")).alias("k")).collect()}
    assert [got[v] for v in values] == list(np.searchsorted(bounds, values, side="right"))


def test_broadcast_measure_counts_nested_values(spark):
    flat = spark.range(10).select("id", F.array_repeat(F.lit(1.0), 100).alias("w"))
    deep = flat.groupBy((F.col("id") % 2).alias("c")).agg(F.collect_list(F.struct("id", "w")).alias("models"))
    from partwise.session import small
    assert "hint" in small(deep)._jdf.queryExecution().logical().toString().lower()
    assert "hint" not in small(deep, limit=6000)._jdf.queryExecution().logical().toString().lower()


def test_threshold_beyond_the_rows_keeps_all(spark):
    from partwise.functions.ranking import sample_threshold, sort_key
    rows = spark.range(5).withColumnRenamed("id", "row_id")
    for size, kept in ((0, 0), (3, 3), (5, 5), (9, 5)):
        assert rows.filter(sort_key(["row_id"], 1) <= sample_threshold(rows, ["row_id"], size, 1)).count() == kept
