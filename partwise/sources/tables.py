"""Turn ordinary tables into learning samples.

``samples``: row_id, label DOUBLE, idx ARRAY<INT>, val ARRAY<DOUBLE> (sparse row, ascending idx).
``cells``:   row_id, feature, value (one row per non-zero entry).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import text_rank
from ..operators.rows import pack
from ..session import cut, small, spread_scan, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows get heavy per-row work next."""
    return spread_scan(table(spark, sf_dir, name))


def dense_samples(df: DataFrame, row_id, label, features, **extra) -> DataFrame:
    """Samples from a dense ARRAY column; zero entries are left out. ``extra`` columns are kept."""
    more = [c.alias(name) for name, c in extra.items()]
    wide = df.select(row_id.alias("row_id"), label.cast("double").alias("label"), *more,
                     F.transform(features, lambda v: v.cast("double")).alias("all_val"))
    kept = F.filter(F.transform(F.col("all_val"), lambda v, i: F.struct(i.alias("i"), v.alias("v"))),
                    lambda c: c["v"] != 0)
    packed = wide.select("row_id", "label", *extra, kept.alias("c"))
    return packed.select("row_id", "label", *extra, F.col("c.i").alias("idx"), F.col("c.v").alias("val"))


def embedding_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_samples(spread_table(spark, sf_dir, "embeddings"), F.col("vec_id"), F.col("label"), F.col("embedding"))


def lineitem_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_samples_with(spread_table(spark, sf_dir, "lineitem"))


def lineitem_samples_with(items: DataFrame, **extra) -> DataFrame:
    """Regression rows: price from quantity, discount, tax and line number.

    The table has no unique key, but whole rows differ, so the id is a digest of the row.
    """
    money = "decimal(18,2)"
    parts = [
        F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"),
        F.col("l_quantity").cast(money), F.col("l_extendedprice").cast(money),
        F.col("l_discount").cast(money), F.col("l_tax").cast(money),
        F.col("l_returnflag"), F.col("l_linestatus"), F.date_format("l_shipdate", "yyyy-MM-dd"),
    ]
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    features = F.array(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"),
                       F.col("l_linenumber").cast("double"))
    return dense_samples(items, digest, F.col("l_extendedprice"), features, **extra)


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-class rows: event type from value, hour, the k property and a user bucket."""
    events = spread_table(spark, sf_dir, "events")
    kinds = table(spark, sf_dir, "events").select("event_type").distinct().agg(F.sort_array(F.collect_set("event_type"))).scalar()
    features = F.array(
        F.col("value"), F.hour("ts").cast("double"),
        F.get_json_object("props", "$.k").cast("double"), (F.col("user_id") % 16).cast("double"),
    )
    return dense_samples(events, F.col("event_id"), F.array_position(kinds, F.col("event_type")) - 1, features)


def token_cells(spark: SparkSession, sf_dir: str, labelled: bool = False) -> DataFrame:
    """Token counts of all documents (or the labelled ones); the feature is the token's dense id in md5 order.
    Stored, as most callers read it several times."""
    counts = stored(token_counts(spark, sf_dir, labelled))
    ids = text_rank(counts.select("token").distinct(), "token", "feature")
    return stored(counts.join(ids, "token").select("row_id", "feature", F.col("n").cast("double").alias("value")))


def frequent_token_cells(spark: SparkSession, sf_dir: str, n_rows: Column, max_zero_share: float = 0.98) -> DataFrame:
    """Cells of the tokens whose share of zeros is below the limit, numbered in md5 order.

    Rare tokens go before any number is given and before cells meet numbers. A frequent token stands in more than
    2 % of the rows, so there are at most 50 times as many as a mean row holds, and they are broadcast.
    """
    counts = cut(token_counts(spark, sf_dir, False))
    held = counts.groupBy("token").agg(F.count("*").alias("nonzero")).filter(1 - F.col("nonzero") / n_rows < max_zero_share)
    ids = small(text_rank(cut(held.select("token")), "token", "feature"))
    return counts.join(ids, "token").select("row_id", "feature", F.col("n").cast("double").alias("value"))


def token_counts(spark: SparkSession, sf_dir: str, labelled: bool) -> DataFrame:
    """Texts are dealt by document, so that no token of them moves until it is counted."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    if labelled:
        documents = documents.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    tokens = documents.select(F.col("doc_id").alias("row_id"),
                             F.explode(F.split(F.lower("text"), r"\s+")).alias("token"))
    return tokens.filter(F.col("token") != "").groupBy("row_id", "token").agg(F.count("*").alias("n"))


def token_rows(spark: SparkSession, sf_dir: str, labelled: bool = False) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id")
    return documents.join(table(spark, sf_dir, "labels"), "doc_id", "inner" if labelled else "left").select(
        F.col("doc_id").alias("row_id"), F.col("quality").cast("double").alias("label"))


def token_samples(spark: SparkSession, sf_dir: str, labelled: bool = False) -> DataFrame:
    packed = pack(token_cells(spark, sf_dir, labelled), ["row_id"])
    return token_rows(spark, sf_dir, labelled).join(packed, "row_id", "left").select(
        "row_id", "label",
        F.coalesce("idx", F.array().cast("array<int>")).alias("idx"),
        F.coalesce("val", F.array().cast("array<double>")).alias("val"))
