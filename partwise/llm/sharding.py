"""Rendezvous hashing of record keys over weighted shards, with gapless slots inside each shard."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import query, table

SLOT_BUCKETS = 1024     # hash buckets of a shard; only the inside of one is sorted


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard that wins the key: the largest weight / -ln(u), with u drawn by hash from (key, shard).

    Every shard's bid depends on the key and that shard alone. A shard more takes only the keys it wins;
    all others keep their shard. A null key bids like any other key.
    """
    if not weights or not all(w > 0 and math.isfinite(w) for w in weights):
        raise ValueError("weights must be positive and finite")

    def bid(s: int, w: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(s)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.struct((F.lit(w) / -F.log(u)).alias("bid"), F.lit(-s).alias("s"))

    best = F.array_max(F.array(*[bid(s, float(w)) for s, w in enumerate(weights)]))
    return (-best["s"]).cast("int")


def shard_records(records: DataFrame, key: str, weights: list[float], grown: list[float] | None = None,
                  order: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``shard``, ``slot`` (0, 1, ... without gaps in each shard) and, with ``grown`` weights, ``grown_shard``.

    Rows that agree in key and ``order`` columns are counted together first, so a key that holds a third of
    all rows is one row while ranking; it is spread out again at the end. Slots follow a hash of the row:
    bucket sizes give offsets (at most shards x SLOT_BUCKETS rows, broadcast), and windows sort one bucket each.
    Null keys, repeated rows and an empty table are ordinary input. Returns key, ``order`` and the new columns.
    """
    cols = [key, *order]
    rows = records.groupBy(*cols).agg(F.count("*").alias("__n"))
    rows = rows.withColumn("shard", rendezvous(F.col(key), weights)).withColumn("__h", F.xxhash64(*cols))
    rows = rows.withColumn("__b", F.pmod("__h", F.lit(SLOT_BUCKETS)).cast("int"))
    sizes = rows.groupBy("shard", "__b").agg(F.sum("__n").alias("__m"))
    before = F.sum("__m").over(W.partitionBy("shard").orderBy("__b")) - F.col("__m")
    offsets = sizes.select("shard", "__b", before.alias("__before"))
    inner = W.partitionBy("shard", "__b").orderBy("__h", *cols).rowsBetween(W.unboundedPreceding, W.currentRow)
    first = F.col("__before") + F.sum("__n").over(inner) - F.col("__n")
    placed = rows.join(F.broadcast(offsets), ["shard", "__b"]).withColumn("__first", first)
    grown_shard = rendezvous(F.col(key), grown) if grown else F.lit(None).cast("int")
    slots = F.explode(F.sequence(F.col("__first"), F.col("__first") + F.col("__n") - 1))
    return placed.select(*cols, "shard", slots.alias("slot"), grown_shard.alias("grown_shard"))


def with_measures(documents: DataFrame) -> DataFrame:
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return documents.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


@query("op6_sharding")
def op6_sharding(spark, sf_dir):
    """All documents over 40 equal shards by doc_id, and where they go with 41."""
    placed = shard_records(with_measures(table(spark, sf_dir, "documents")), "doc_id", [1.0] * 40, [1.0] * 41,
                           ("size", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                         F.col("slot").cast("long").alias("slot"), "grown_shard")
