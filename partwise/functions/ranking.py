"""Ranks, samples and quantile positions that never put one whole group in one task.

A plain ``row_number`` over a group sorts the group in a single task. Here a group is first
cut into ordered buckets, the bucket sizes (small, combined map-side) give every bucket its
offset, and only the inside of a bucket is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut
from .hashing import hash_key

PREFIX = 4           # hex digits: 65,536 buckets per group
MAX_BOUNDS = 511     # boundaries per group of a value bucketing


def bucket_rank(df: DataFrame, groups: list[str], bucket: str, order: list[Column], out: str,
                 size_out: str | None = None) -> DataFrame:
    """1-based rank inside ``groups`` when ``bucket`` is monotone in ``order``."""
    counts = df.groupBy(*groups, bucket).agg(F.count("*").alias("__n"))
    before = W.partitionBy(*groups).orderBy(bucket)
    cols = [F.col(g) for g in groups] + [
        F.col(bucket),
        (F.sum("__n").over(before) - F.col("__n")).alias("__before"),
    ]
    if size_out:
        cols.append(F.sum("__n").over(W.partitionBy(*groups)).alias(size_out))
    offsets = counts.select(*cols)
    keys = groups + [bucket]
    inner = W.partitionBy(*keys).orderBy(*order)
    return df.join(offsets, keys).withColumn(out, F.row_number().over(inner) + F.col("__before")).drop("__before", bucket)


def hash_rank(df: DataFrame, groups: list[str], keys: list, seed, out: str = "rank",
              size_out: str | None = None, prefix: int = PREFIX) -> DataFrame:
    """Random but repeatable rank 1..n inside each group, ordered by md5(seed|keys)."""
    hashed = df.withColumn("__h", hash_key(seed, *keys)).withColumn("__b", F.substring("__h", 1, prefix))
    tie = [F.col(k) if isinstance(k, str) else k for k in keys]
    return bucket_rank(hashed, groups, "__b", [F.col("__h"), *tie], out, size_out).drop("__h")


def text_rank(df: DataFrame, column: str, out: str, prefix: int = PREFIX) -> DataFrame:
    """Dense 0-based id of distinct strings in md5 order."""
    hashed = df.withColumn("__h", F.md5(F.col(column))).withColumn("__b", F.substring("__h", 1, prefix))
    ranked = bucket_rank(hashed, [], "__b", [F.col("__h"), F.col(column)], out)
    return ranked.withColumn(out, F.col(out).cast("bigint") - 1).drop("__h")


def dense_index(df: DataFrame, key: str, out: str = "position", per_bucket: int = 1_000_000) -> DataFrame:
    """0-based position in ascending order of a key of any orderable type.

    Large tables are dealt by ranges that Spark draws from the keys themselves, so an outlying key changes
    nothing; the dealing is checkpointed, as its bounds come from a sample.
    """
    buckets = -(-df.count() // per_bucket)
    if buckets > 1:
        bucketed = cut(df.repartitionByRange(buckets, key).withColumn("__b", F.spark_partition_id()))
    else:
        bucketed = df.withColumn("__b", F.lit(0))
    ranked = bucket_rank(bucketed, [], "__b", [F.col(key)], out)
    return ranked.withColumn(out, F.col(out).cast("bigint") - 1)


def sample_threshold(df: DataFrame, keys: list, size: int, seed, prefix: int = PREFIX) -> Column:
    """Largest sort key of the exact ``size`` first rows in hash order.

    Only bucket counts and the rows of one bucket are looked at, so choosing n of N rows
    costs two narrow scans and no shuffle of the rows. The key itself is one short string.
    """
    keyed = df.select(sort_key(keys, seed).alias("k")).withColumn("b", F.substring("k", 1, prefix))
    counts = keyed.groupBy("b").agg(F.count("*").alias("n"))
    running = counts.select("b", "n", F.sum("n").over(W.orderBy("b")).alias("upto"))
    edge = running.filter((F.col("upto") - F.col("n") < size) & (F.col("upto") >= size))
    inside = keyed.join(edge.select("b", (size - (F.col("upto") - F.col("n"))).alias("need")), "b")
    ranked = inside.withColumn("r", F.row_number().over(W.partitionBy("b").orderBy("k")))
    found = ranked.filter(F.col("r") == F.col("need")).agg(F.max("k")).first()[0]
    if found is None:       # no edge: nothing is wanted, or all rows are (every key is below "g", as keys start in hex)
        found = "g" if size > 0 else ""
    return F.lit(found)


def first_by_hash(df: DataFrame, groups: list[str], keys: list, k: int, seed, out: str = "rank",
                  prefix: int = PREFIX) -> DataFrame:
    """The first ``k`` rows of every group in hash order, with their 1-based rank.

    Bucket counts name the few buckets that can hold them; only those rows are ranked.
    """
    keyed = df.withColumn("__h", hash_key(seed, *keys)).withColumn("__b", F.substring("__h", 1, prefix))
    counts = keyed.groupBy(*groups, "__b").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*groups).orderBy("__b")) - F.col("__n")
    near = counts.withColumn("__before", before).filter(F.col("__before") < k).select(*groups, "__b")
    tie = [F.col(c) if isinstance(c, str) else c for c in keys]
    order = W.partitionBy(*groups).orderBy(F.col("__h"), *tie)
    candidates = keyed.join(near, [*groups, "__b"], "left_semi")
    return candidates.withColumn(out, F.row_number().over(order)).filter(F.col(out) <= k).drop("__h", "__b")


def sort_key(keys: list, seed) -> Column:
    parts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.concat_ws("|", hash_key(seed, *keys), *parts)


def with_bounds(df: DataFrame, groups: list[str], value: str, per_bucket: int) -> DataFrame:
    """Repeatable range boundaries per group, drawn from the group's own values.

    Groups up to ``per_bucket`` rows get none. The draw is a hash of the value, so it is the
    same however often the plan is evaluated. At most about 512 are kept per group.
    """
    sizes = df.groupBy(*groups).agg(F.count("*").alias("__n"))
    wanted = F.least(F.col("__n") / F.lit(float(per_bucket)), F.lit(MAX_BOUNDS * 0.8))
    large = sizes.filter(F.col("__n") > per_bucket).select(*groups, (wanted / F.col("__n")).alias("__share"))
    uniform = F.pmod(F.xxhash64(*groups, value), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = df.join(large, groups).filter(uniform < F.col("__share"))
    return drawn.groupBy(*groups).agg(F.sort_array(F.collect_set(value)).alias("bounds"))


def bucket_of(value: Column, bounds: Column) -> Column:
    """Number of boundaries <= value, by binary search over a sorted array (NULL = none)."""
    steps = F.array(*[F.lit(2 ** p) for p in range(MAX_BOUNDS.bit_length(), -1, -1)])
    found = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= F.size(bounds)) & (F.get(bounds, at + step - 1) <= value), at + step
        ).otherwise(at),
    )
    return F.when(bounds.isNull(), F.lit(0)).otherwise(found)


def cumulative_weight(df: DataFrame, groups: list[str], value: str, weight: str, below: str, total: str,
                      per_bucket: int = 1_000_000) -> DataFrame:
    """Weight of strictly smaller values, for rows that hold each (group, value) once."""
    df = cut(df)        # read four times below
    bounds = with_bounds(df, groups, value, per_bucket)
    bucketed = df.join(bounds, groups, "left").withColumn("__b", bucket_of(F.col(value), F.col("bounds")))
    bucketed = bucketed.drop("bounds")
    sums = bucketed.groupBy(*groups, "__b").agg(F.sum(weight).alias("__w"))
    before = W.partitionBy(*groups).orderBy("__b")
    offsets = sums.select(
        *groups, "__b",
        (F.sum("__w").over(before) - F.col("__w")).alias("__before"),
        F.sum("__w").over(W.partitionBy(*groups)).alias(total),
    )
    inner = W.partitionBy(*groups, "__b").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        bucketed.join(offsets, [*groups, "__b"])
        .withColumn(below, F.col("__before") + F.sum(weight).over(inner) - F.col(weight))
        .drop("__b", "__before")
    )
