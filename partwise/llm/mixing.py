"""Mixing sources to target weights by Efraimidis-Spirakis keys, whole epochs first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.hashing import hash_uniform
from ..session import small
from .common import query, stored, table, word_count

BUCKETS = 16384         # key ranges of a source; only the one that holds the cut is sorted
SOURCE_WEIGHTS = (1, 2, 3)
CAP = 3                 # most epochs
SEED = "mix"


def draw_key(doc_id: Column, quality: Column) -> Column:
    """Exponential key of a document: -ln(u) / quality weight. Smaller keys are drawn first."""
    return -F.log(hash_uniform(SEED, doc_id) + F.lit(2.0 ** -53)) / quality


def targets(sources: DataFrame) -> DataFrame:
    """Words each source has to give: the total shared by weight, no source above CAP times its size.

    ``sources`` holds one row per source: source, source_size. Weights 1, 2, 3 repeat in code point order,
    null last. A source is at its cap if even with the share of all sources that reach theirs later it gets
    more; in order of size / weight those come first, so one running sum finds them (same as sharing the
    excess again until none is above). Sources without words get 0.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in SOURCE_WEIGHTS]), (rank % len(SOURCE_WEIGHTS) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("cap", CAP * F.col("source_size"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    rest = F.sum("source_size").over(everything) - (F.sum("cap").over(by_ratio) - F.col("cap"))
    weights = F.sum("weight").over(everything) - (F.sum("weight").over(by_ratio) - F.col("weight"))
    rows = rows.withColumn("level", rest / weights).withColumn("full", F.col("cap") < F.col("level") * F.col("weight"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * level)
    return rows.select("source", "source_size", F.when(F.col("source_size") == 0, 0.0).otherwise(target).alias("target"))


def plan_mix(sized: DataFrame) -> DataFrame:
    """One row per source: source, source_size, target, epochs, and the cut of the fractional draw.

    ``sized`` holds source, size, draw, doc_id. Key ranges are summed map-side; the range in which the words
    that remain after the whole epochs run out is the only one sorted. Rows that tie in (draw, size) are one.
    """
    worded = sized.filter("size > 0")
    bucketed = worded.withColumn("b", F.floor((1 - F.exp(-F.col("draw"))) * BUCKETS).cast("int"))
    per_bucket = stored(bucketed.groupBy("source", "b").agg(F.sum("size").alias("words")))
    all_sources = sized.select("source").distinct()
    totals = per_bucket.groupBy("source").agg(F.sum("words").alias("source_size"))
    sources = all_sources.join(totals, all_sources["source"].eqNullSafe(totals["source"]), "left").select(
        all_sources["source"], F.coalesce("source_size", F.lit(0)).alias("source_size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets(sources).withColumn("epochs", epochs)
    plan = small(plan.withColumn("rest", (F.floor("target") - F.col("epochs") * F.col("source_size")).cast("long")))

    running = F.sum("words").over(W.partitionBy("source").orderBy("b"))
    edges = per_bucket.withColumn("upto", running)
    edge = edges.join(plan.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
    edge = small(edge.filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
                 .select("s", F.col("b").alias("cut_b"), (F.col("rest") - F.col("upto") + F.col("words")).alias("left")))
    inside = bucketed.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("cut_b")))
    inside = inside.groupBy("s", "left", "draw", "size").agg(F.count("*").alias("n"))
    upto = F.sum(F.col("n") * F.col("size")).over(W.partitionBy("s").orderBy("draw", "size"))
    inside = inside.withColumn("upto", upto).filter((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("n") * F.col("size") <= F.col("left")))
    cut = inside.select("s", F.col("draw").alias("cut_draw"), F.col("size").alias("cut_size"),
                        F.floor((F.col("left") - F.col("upto") + F.col("n") * F.col("size")) / F.col("n")).cast("long").alias("cut_words"))
    cut = small(cut)
    return plan.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("mix_source"), "source_size", "target", "epochs", "cut_draw", "cut_size", "cut_words")


def apply_mix(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``sized`` (any columns with source, size, draw) plus source_size, target and taken."""
    at = F.struct("draw", "size")
    cut = F.struct(F.col("cut_draw").alias("draw"), F.col("cut_size").alias("size"))
    drawn = F.when(F.col("cut_draw").isNull() | (at > cut), 0).when(at < cut, F.col("size")).otherwise(F.col("cut_words"))
    taken = F.col("epochs") * F.col("size") + F.when(F.col("size") > 0, drawn).otherwise(0)
    joined = sized.join(small(plan), sized["source"].eqNullSafe(F.col("mix_source")))
    return joined.withColumn("taken", taken.cast("long")).drop("mix_source", "epochs", "cut_draw", "cut_size", "cut_words")


def with_draws(documents: DataFrame, labels: DataFrame, *keep: str) -> DataFrame:
    """doc_id, source, size, draw (+ ``keep``). Documents labelled good weigh 2, bad 0.5, others 1; two
    labels of one document count as the better one. A null doc_id has no label and draws by its null."""
    quality = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").alias("label_quality"))
    weight = F.when(F.col("label_quality") == 1, 2.0).when(F.col("label_quality") == 0, 0.5).otherwise(1.0)
    sized = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), *keep)
    return sized.join(quality, F.col("doc_id") == F.col("label_id"), "left").withColumn("draw", draw_key(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), weight)).drop("label_id", "label_quality")


def mix_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The mixed corpus itself: each document ``taken // size`` times, and the one in which a source's words
    run out cut after its last word taken. Documents without words stay once (they weigh nothing).
    Same columns as the input, whatever further columns it has.
    """
    slim = stored(with_draws(documents, labels))
    plan = plan_mix(slim)
    names = documents.columns
    # the decision depends on id, source and size alone; labels and plan meet these, and texts only meet the decision,
    # by the same join at every size
    taken = apply_mix(slim, plan).groupBy(*[F.col(c).alias(f"__{c}") for c in ("doc_id", "source", "size")]).agg(F.first("taken").alias("taken"))
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"))
    packed = packed.withColumn("size", word_count(F.col("__row.text")))
    same = F.col("__row.doc_id").eqNullSafe(F.col("__doc_id")) & F.col("__row.source").eqNullSafe(F.col("__source")) & (F.col("size") == F.col("__size"))
    mixed = packed.join(taken.hint("shuffle_hash"), same).select("__row", "size", "taken")
    whole = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.greatest("size", F.lit(1)))).cast("int")
    part = F.when(F.col("size") > 0, F.col("taken") % F.greatest("size", F.lit(1))).otherwise(0).cast("int")
    copies = F.concat(F.array_repeat(F.lit(0), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    out = mixed.select("__row", F.explode(copies).alias("copy"))
    ends = F.split(F.col("__row.text"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")       # each piece ends with a word
    text = F.when(F.col("copy") > 0, F.array_join(F.slice(ends, 1, F.greatest("copy", F.lit(1))), "")).otherwise(F.col("__row.text"))
    return out.select(*[text.alias("text") if c == "text" else F.col(f"__row.`{c}`") for c in names])


#: The same mix in SQL: sources ranked and weighted, the level found over the ratio order, draws summed in key order.
MIX_SQL = r"""
q AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
sized AS (
  SELECT d.*, len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         -ln(('0x' || substr(md5('mix|' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE + pow(2.0::DOUBLE, -53))
           / (CASE q.quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS draw
  FROM {documents} d LEFT JOIN q ON d.doc_id = q.doc_id),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, 3 * source_size AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM src),
levels AS (
  SELECT *, (sum(source_size) OVER () - (sum(cap) OVER o - cap))::DOUBLE / (sum(weight) OVER () - (sum(weight) OVER o - weight))::DOUBLE AS level
  FROM weighted WINDOW o AS (ORDER BY cap::DOUBLE / weight::DOUBLE, source NULLS LAST)),
capped AS (SELECT *, cap < level * weight AS is_full FROM levels),
tgt AS (
  SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE WHEN is_full THEN cap::DOUBLE
         ELSE weight * (SELECT arg_min(level, cap::DOUBLE / weight::DOUBLE) FROM capped WHERE NOT is_full) END AS target FROM capped),
plan AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS epochs FROM tgt),
run AS (
  SELECT s.*, p.source_size, p.target, p.epochs, floor(p.target)::BIGINT - p.epochs * p.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw, s.size RANGE UNBOUNDED PRECEDING) AS upto,
         count(*) OVER (PARTITION BY s.source, s.draw, s.size) AS ties
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
mixed AS (
  SELECT *, (epochs * size + CASE WHEN size = 0 THEN 0 WHEN upto <= rest THEN size
            ELSE greatest(0, least(size, floor((rest - upto + ties * size) / ties))) END)::BIGINT AS taken FROM run)
"""


@query("op4_mixing", "WITH " + MIX_SQL.replace("{documents}", "documents") + "SELECT doc_id, size, source_size, target, taken FROM mixed")
def op4_mixing(spark, sf_dir):
    slim = stored(with_draws(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return apply_mix(slim, plan_mix(slim)).select("doc_id", "size", "source_size", "target", "taken")
