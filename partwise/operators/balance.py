"""Class repair inside clusters: add rows of under-represented classes from the whole train set.

``members``: cluster_id, row_id, label. Result: the same plus ``copy`` (0 = original member).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.hashing import SEED, hash_int
from ..functions.ranking import bucket_rank, hash_rank

RUN = 100_000


def class_counts(members: DataFrame, min_ratio: float = 0.1) -> DataFrame:
    """Counts per (cluster, label), the cluster's majority and whether the class is too small."""
    counts = members.groupBy("cluster_id", "label").agg(F.count("*").alias("n"))
    per_cluster = W.partitionBy("cluster_id")
    return counts.withColumn("majority", F.max("n").over(per_cluster)).withColumn(
        "classes", F.count("*").over(per_cluster)).withColumn(
        "small", (F.col("n") / F.col("majority") < min_ratio) | (F.col("n") < 2))


def donor_classes(counts: DataFrame, train: DataFrame, seed: int = SEED) -> DataFrame:
    """For every single-class cluster one random other label, entering with count 0.

    A data set with one label has no donor; its clusters stay as they are.
    """
    labels = train.select("label").distinct().agg(F.sort_array(F.collect_set("label"))).scalar()
    single = counts.filter("classes = 1").select("cluster_id", "label", "majority").withColumn("all_labels", labels)
    others = single.withColumn("others", F.array_remove("all_labels", F.col("label"))).filter(F.size("others") > 0)
    pick = (hash_int(seed, F.lit("donor"), "cluster_id") % F.size("others")).cast("int")
    return others.select("cluster_id", F.get("others", pick).alias("label"), F.lit(0).cast("bigint").alias("n"), "majority")


def shortages(members: DataFrame, train: DataFrame, min_ratio: float = 0.1, max_samples: int = 100,
              seed: int = SEED) -> DataFrame:
    """(cluster_id, label, n, majority, available, additional) for classes that need rows."""
    counts = class_counts(members, min_ratio)
    needy = counts.filter("small").select("cluster_id", "label", "n", "majority").unionByName(
        donor_classes(counts, train, seed))
    supply = train.groupBy("label").agg(F.count("*").alias("supply"))
    known = needy.join(supply, "label").withColumn("available", F.col("supply") - F.col("n"))
    target = F.greatest(F.lit(5), F.floor(F.col("majority") * F.lit(min_ratio)))
    capped = F.least(target - F.col("n"), F.lit(max_samples), F.col("available"))
    fallback = F.greatest(F.lit(2), F.floor(F.col("majority") * 0.5))
    return known.filter("available > 0").withColumn(
        "additional", F.when(capped <= 0, fallback).otherwise(capped).cast("bigint"))


def supplements(members: DataFrame, train: DataFrame, short: DataFrame, seed: int = SEED) -> DataFrame:
    """Rows to add per (cluster, label): cluster_id, row_id, label, copy >= 1.

    All rows of a label stand in one hash order. A cluster starts at its own random position
    and reads on (wrapping round), skipping its members, until it has enough. It never has to
    look at more than additional + own rows, so a label holding most rows is not repeated for
    every cluster. If the label runs out the rows are used again (draw with replacement).
    """
    ordered = hash_rank(train.select("row_id", "label"), ["label"], ["row_id"], seed, out="place", size_out="supply")
    ordered = ordered.withColumn("place", F.col("place") - 1).drop("supply")
    reach = F.least(F.col("supply"), F.col("additional") + F.col("n"))
    start = hash_int(seed, F.lit("start"), "cluster_id", "label") % F.col("supply")
    # Two levels of sequences keep the arrays short when a class needs very many rows.
    opened = short.withColumn("supply", F.col("available") + F.col("n")).withColumn("start", start).withColumn("reach", reach).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("reach") - 1) / RUN))))
    stops = opened.withColumn("step", F.explode(F.sequence(
        F.col("block") * RUN, F.least(F.col("reach"), (F.col("block") + 1) * RUN) - 1)))
    stops = stops.withColumn("place", (F.col("start") + F.col("step")) % F.col("supply"))
    met = stops.join(ordered, ["label", "place"])
    fresh = met.join(members.select("cluster_id", "row_id"), ["cluster_id", "row_id"], "left_anti")
    numbered = bucket_rank(fresh, ["cluster_id", "label"], "block", [F.col("step")], "turn")
    numbered = numbered.withColumn("turn", F.col("turn") - 1).filter(F.col("turn") < F.col("additional"))
    pool = F.least("available", "additional")
    repeats = F.floor((F.col("additional") - 1 - F.col("turn")) / pool) + 1
    copies = numbered.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), repeats.cast("bigint"))))
    return copies.select("cluster_id", "row_id", "label", F.col("copy").cast("int").alias("copy"))


def balance(members: DataFrame, train: DataFrame, min_ratio: float = 0.1, max_samples: int = 100,
            seed: int = SEED) -> DataFrame:
    """Members plus supplements (a bag: a row may now be in two clusters)."""
    short = shortages(members, train, min_ratio, max_samples, seed)
    own = members.select("cluster_id", "row_id", "label", F.lit(0).alias("copy"))
    return own.unionByName(supplements(members, train, short, seed))
