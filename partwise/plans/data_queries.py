"""Sources, profiling, sampling, row and column shaping, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import rows as rw
from ..session import shared_folder
from ..sources import libsvm as lv
from ..sources import profile as pf
from ..sources import tables as tb
from .registry import query
from .sqlparts import EMB, EV, LABELLED_TOK, LINE, TOK, h, rnd


@query(f"""WITH {EMB} SELECT 'embeddings' AS filepath, (SELECT max(feature) + 1 FROM emb_cells)::BIGINT AS n_features,
(SELECT count(*) FROM emb) AS n_samples""")
def dataset_stats(spark, sf):
    return pf.dataset_stats(tb.embedding_samples(spark, sf), "embeddings")


PROFILE = """SELECT n_samples, n_features, {avg} AS avg_sparsity, label, count(*) AS label_count
FROM {rows}, (SELECT count(*) AS n_samples FROM {rows}), (SELECT max(feature) + 1 AS n_features, count(*) AS nnz FROM {cells})
GROUP BY ALL"""
SPARSITY = rnd("1 - nnz / n_samples / n_features")


@query(f"WITH {LABELLED_TOK} " + PROFILE.format(avg=SPARSITY, rows="tok_rows", cells="tok_cells"))
def dataset_profile(spark, sf):
    found = pf.profile_bags(tb.token_rows(spark, sf, labelled=True), tb.token_counts(spark, sf, True))
    return found.drop("dataset").withColumn("avg_sparsity", F.round("avg_sparsity", 6))


@query(f"WITH {EMB}, {LABELLED_TOK}, {EV} SELECT 'clf/embeddings' AS dataset, * FROM (" + PROFILE.format(avg=SPARSITY, rows="emb", cells="emb_cells")
       + ") UNION ALL SELECT 'clf/documents', * FROM (" + PROFILE.format(avg=SPARSITY, rows="tok_rows", cells="tok_cells")
       + ") UNION ALL SELECT 'clf/events', * FROM (" + PROFILE.format(avg=SPARSITY, rows="ev", cells="ev_cells") + ")")
def profile_report(spark, sf):
    report = pf.profile_report({
        "clf/embeddings": tb.embedding_samples(spark, sf),
        "clf/documents": tb.token_samples(spark, sf, labelled=True),
        "clf/events": tb.event_samples(spark, sf)}).drop("error")
    return report.withColumn("avg_sparsity", F.round("avg_sparsity", 6))


ORDER = h("row_id") + " || '|' || row_id::VARCHAR"


@query(f"""WITH {EMB} SELECT row_id, row_number() OVER (ORDER BY {ORDER}) <= ceil(0.2 * count(*) OVER ()) AS is_test FROM emb""")
def split_train_test(spark, sf):
    return pf.with_test_flag(tb.embedding_samples(spark, sf)).select("row_id", "is_test")


@query(f"""WITH {LINE}, r AS (SELECT row_id, row_number() OVER (ORDER BY {ORDER}) AS r, count(*) OVER () AS n FROM line)
SELECT row_id FROM r WHERE r <= CASE WHEN n > 10000 THEN floor(n * 0.1) ELSE n END""")
def fit_sample(spark, sf):
    return pf.fit_sample(tb.lineitem_samples(spark, sf)).select("row_id")


@query(f"""WITH {TOK}, f AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY {ORDER}) <= ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS part FROM tok_rows),
c AS (SELECT c.row_id, c.feature, c.value, f.part FROM tok_cells c JOIN f USING (row_id)),
w AS (SELECT least(max(feature) FILTER (part = 'train'), max(feature) FILTER (part = 'test')) AS top FROM c)
SELECT part, row_id, feature, value FROM c, w WHERE feature <= top""")
def align_features(spark, sf):
    flagged = pf.with_test_flag(tb.token_rows(spark, sf)).select("row_id", "is_test")
    cells = tb.token_cells(spark, sf).join(flagged, "row_id")
    train, test = rw.shared_features(cells.filter(~F.col("is_test")), cells.filter("is_test"))
    both = train.select(F.lit("train").alias("part"), "row_id", "feature", "value").unionByName(
        test.select(F.lit("test").alias("part"), "row_id", "feature", "value"))
    return both


@query(f"""WITH {TOK}, k AS (SELECT feature, count(*) AS nonzero FROM tok_cells GROUP BY feature
HAVING 1 - count(*) / (SELECT count(*) FROM tok_rows) < 0.98),
m AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS new_feature FROM k)
SELECT row_id, new_feature::INT AS feature, value FROM tok_cells JOIN m USING (feature)""")
def drop_sparse_features(spark, sf):
    n = tb.token_rows(spark, sf).agg(F.count("*")).scalar()
    return tb.frequent_token_cells(spark, sf, n).select("row_id", F.col("feature").cast("int").alias("feature"), "value")


@query(f"""WITH {TOK}, s AS (SELECT cluster_id, count(*) AS n FROM tok_rows GROUP BY 1)
SELECT cluster_id, feature, count(*) AS nonzero, {rnd('count(*) / any_value(n)')} AS nonzero_ratio
FROM tok_cells JOIN s USING (cluster_id) GROUP BY 1, 2 HAVING count(*) / any_value(n) >= 0.05""")
def cluster_nonzero_filter(spark, sf):
    rows = tb.token_rows(spark, sf).withColumn("cluster_id", (F.col("row_id") % 4).cast("int"))
    cells = tb.token_cells(spark, sf).withColumn("cluster_id", (F.col("row_id") % 4).cast("int"))
    kept = rw.cluster_frequent_features(cells, rows.groupBy("cluster_id").agg(F.count("*").alias("n")), 0.05)
    return kept.withColumn("nonzero_ratio", F.round("nonzero_ratio", 6))


def _norm_sql(expr):
    return (f"WITH {TOK}, s AS (SELECT row_id, {expr} AS s FROM tok_cells GROUP BY row_id) "
            f"SELECT row_id, feature::INT AS feature, {rnd('value / s')} AS value FROM tok_cells JOIN s USING (row_id)")


def _norm(spark, sf, norm):
    scaled = rw.normalize(tb.token_samples(spark, sf), norm)
    return rw.cells_of(scaled).select("row_id", "feature", F.round("value", 6).alias("value"))


@query(_norm_sql("sqrt(sum(value * value))"))
def row_norm_l2(spark, sf):
    return _norm(spark, sf, "l2")


@query(_norm_sql("sum(abs(value))"))
def row_norm_l1(spark, sf):
    return _norm(spark, sf, "l1")


@query(_norm_sql("max(abs(value))"))
def row_norm_max(spark, sf):
    return _norm(spark, sf, "max")


@query(f"""WITH {EMB}, s AS (SELECT cluster_id, feature, avg(value) AS m FROM emb_cells WHERE cluster_id < 3 GROUP BY ALL),
c AS (SELECT cluster_id, feature, row_number() OVER (PARTITION BY cluster_id ORDER BY feature) - 1 AS out_feature FROM s WHERE m > 0)
SELECT e.cluster_id, row_id, coalesce(out_feature, feature)::INT AS feature, {rnd('value')} AS value
FROM emb_cells e LEFT JOIN c USING (cluster_id, feature) WHERE cluster_id = 3 OR out_feature IS NOT NULL""")
def project_selected(spark, sf):
    cells = _emb_cells(spark, sf)
    from pyspark.sql.window import Window as W
    means = cells.filter("cluster_id < 3").groupBy("cluster_id", "feature").agg(F.avg("value").alias("m")).filter("m > 0")
    number = F.row_number().over(W.partitionBy("cluster_id").orderBy("feature")) - 1
    chosen = means.select("cluster_id", F.col("feature").alias("in_feature"), number.alias("out_feature"))
    return rw.project_selected(cells, chosen).select("cluster_id", "row_id", "feature", F.round("value", 6).alias("value"))


def _emb_cells(spark, sf):
    return rw.cells_of(tb.embedding_samples(spark, sf), "row_id", "label").withColumn("cluster_id", (F.col("row_id") % 4).cast("int"))


# --- evaluation: a fixed rule stands for the model -----------------------------------------

EMB_PRED = f"""{EMB}, p AS (SELECT row_id, cluster_id, label, CASE WHEN x[1] > 0 THEN label ELSE (label + 1) % 10 END AS prediction FROM emb)"""
LINE_PRED = """p AS (SELECT l_returnflag AS cluster_id, l_extendedprice AS label, l_quantity * 1500.0 AS prediction FROM lineitem)"""
TOK_PRED = """p AS (SELECT doc_id AS row_id, quality::DOUBLE AS label, toxic::DOUBLE AS prediction FROM labels)"""


def _emb_predictions(spark, sf):
    e = tb.table(spark, sf, "embeddings")
    label = F.col("label").cast("double")
    return e.select(F.col("vec_id").alias("row_id"), (F.col("vec_id") % 4).cast("int").alias("cluster_id"), label.alias("label"),
                    F.when(F.col("embedding")[0] > 0, label).otherwise((label + 1) % 10).alias("prediction"))


def _line_predictions(spark, sf):
    return tb.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("cluster_id"), F.col("l_extendedprice").alias("label"),
        (F.col("l_quantity") * 1500.0).alias("prediction"))


def _rounded(df, *names):
    for name in names:
        df = df.withColumn(name, F.round(name, 6))
    return df


@query(f"""WITH {EMB_PRED} SELECT CASE WHEN grouping(cluster_id) = 1 THEN 'overall' ELSE 'cluster' END AS scope, cluster_id,
count(*) AS n, {rnd('avg((label = prediction)::DOUBLE)')} AS accuracy FROM p GROUP BY ROLLUP (cluster_id)""")
def accuracy(spark, sf):
    return _rounded(ev.accuracy(_emb_predictions(spark, sf)), "accuracy")


@query(f"""WITH {EMB_PRED}, q AS (SELECT 'cluster' AS scope, * FROM p UNION ALL SELECT 'overall', row_id, NULL, label, prediction FROM p),
c AS (SELECT DISTINCT scope, cluster_id, label AS c FROM q UNION SELECT DISTINCT scope, cluster_id, prediction FROM q),
s AS (SELECT c.scope, c.cluster_id, c.c, count(*) FILTER (q.label = c.c) AS t, count(*) FILTER (q.prediction = c.c) AS g,
  count(*) FILTER (q.label = c.c AND q.prediction = c.c) AS tp
  FROM c JOIN q ON c.scope = q.scope AND c.cluster_id IS NOT DISTINCT FROM q.cluster_id GROUP BY ALL)
SELECT scope, cluster_id, sum(t)::BIGINT AS n, {rnd('sum(2.0 * tp / (t + g) * t) / sum(t)')} AS f1 FROM s GROUP BY ALL""")
def f1_weighted(spark, sf):
    return _rounded(ev.f1_weighted(_emb_predictions(spark, sf)), "f1")


@query(f"""WITH {TOK_PRED} SELECT count(*) AS n, {rnd('2.0 * count(*) FILTER (label = 1 AND prediction = 1) / (count(*) FILTER (label = 1) + count(*) FILTER (prediction = 1))')} AS f1 FROM p""")
def f1_binary(spark, sf):
    labels = tb.table(spark, sf, "labels")
    return _rounded(ev.f1_binary(labels.select(F.col("quality").cast("double").alias("label"), F.col("toxic").cast("double").alias("prediction"))), "f1")


@query(f"""WITH {LINE_PRED} SELECT CASE WHEN grouping(cluster_id) = 1 THEN 'overall' ELSE 'cluster' END AS scope, cluster_id,
count(*) AS n, {rnd('avg((label - prediction) ** 2)', 2)} AS mse, {rnd('sqrt(avg((label - prediction) ** 2))', 4)} AS rmse FROM p GROUP BY ROLLUP (cluster_id)""")
def mse_rmse(spark, sf):
    return ev.mse_rmse(_line_predictions(spark, sf)).withColumn("mse", F.round("mse", 2)).withColumn("rmse", F.round("rmse", 4))


@query(f"""WITH {LINE_PRED} SELECT CASE WHEN grouping(cluster_id) = 1 THEN 'overall' ELSE 'cluster' END AS scope, cluster_id,
count(*) AS n, {rnd('1 - sum((label - prediction) ** 2) / (var_pop(label) * count(*))')} AS r2 FROM p GROUP BY ROLLUP (cluster_id)""")
def r2(spark, sf):
    return _rounded(ev.r2(_line_predictions(spark, sf)), "r2")


@query(f"WITH {LINE_PRED} SELECT max(label) AS y_max, min(label) AS y_min FROM p")
def target_range(spark, sf):
    return ev.target_range(_line_predictions(spark, sf))


@query(f"WITH {EMB_PRED} SELECT row_id, cluster_id, prediction, label FROM p")
def prediction_merge(spark, sf):
    p = _emb_predictions(spark, sf)
    return ev.merge_predictions(p.select("row_id", "cluster_id", "prediction"), p.select("row_id", "label"))


@query(f"""WITH {EMB} SELECT label, feature, count(*) AS n, min(value) AS lo, max(value) AS hi, {rnd('sum(value)')} AS total FROM emb_cells GROUP BY ALL""")
def libsvm_round_trip(spark, sf):
    """All embeddings written as LIBSVM files and read back, summed up per label and feature."""
    folder = shared_folder(spark)
    lv.write_libsvm(tb.embedding_samples(spark, sf), folder)
    cells = rw.cells_of(lv.read_libsvm(spark, folder, base=1), "label")
    return cells.groupBy("label", "feature").agg(
        F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.sum("value"), 6).alias("total"))
