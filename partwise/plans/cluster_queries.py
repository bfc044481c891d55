"""Clustering, choice of k, cascade and entropy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cascade as cs
from ..operators import entropy as en
from ..operators import kselect as ks
from ..operators import lloyd as ll
from ..operators.clusterers import KMeans, RandomSlices, RoundRobin, single_cluster
from ..operators.rows import cells_of
from ..sources import profile as pf
from ..sources import tables as tb
from .registry import query
from .sqlparts import EMB, EV, LINE, TOK, bits, h, rnd, uniform

ROUNDS = 6


def lloyd_sql(tag: str, points: str, fits: str, rounds: int = ROUNDS) -> str:
    """CTEs for the same k-means as tables: {tag}_c(fit, grp, j, c) and {tag}_a(fit, grp, row_id, j, d2)."""
    parts = [f"""{tag}_r AS (SELECT grp, row_id, x, row_number() OVER (PARTITION BY grp ORDER BY {h('row_id')}, row_id) AS r FROM {points}),
{tag}_c0 AS (SELECT f.fit, f.grp, r - 1 AS j, x AS c FROM {tag}_r p JOIN {fits} f ON p.grp = f.grp AND r <= f.k)"""]

    def near(i):
        return f"""{tag}_a{i} AS (SELECT c.fit, c.grp, p.row_id, arg_min(c.j, list_distance(p.x, c.c)) AS j,
  min(list_distance(p.x, c.c)) ** 2 AS d2, any_value(p.x) AS x
  FROM {points} p JOIN {tag}_c{i} c ON p.grp = c.grp GROUP BY c.fit, c.grp, p.row_id)"""

    for i in range(rounds):
        parts.append(near(i))
        parts.append(f"""{tag}_m{i} AS (SELECT fit, grp, j, list(v ORDER BY f) AS c FROM (
  SELECT fit, grp, j, f, avg(v) AS v FROM (SELECT fit, grp, j, unnest(range(len(x))) AS f, unnest(x) AS v FROM {tag}_a{i}) GROUP BY ALL) GROUP BY ALL),
{tag}_c{i + 1} AS (SELECT o.fit, o.grp, o.j, coalesce(m.c, o.c) AS c FROM {tag}_c{i} o LEFT JOIN {tag}_m{i} m
  ON o.fit = m.fit AND o.grp = m.grp AND o.j = m.j)""")
    parts.append(near(rounds))
    parts.append(f"{tag}_c AS (SELECT * FROM {tag}_c{rounds}), {tag}_a AS (SELECT * FROM {tag}_a{rounds})")
    return ",\n".join(parts)


def silhouette_sql(points: str, labels: str) -> str:
    """Score per fit from {labels}(fit, row_id, j)."""
    return f"""sil_d AS (SELECT a.row_id AS i, b.row_id AS o, list_distance(a.x, b.x) AS d FROM {points} a JOIN {points} b ON a.row_id <> b.row_id),
sil_n AS (SELECT fit, j, count(*) AS n FROM {labels} GROUP BY ALL),
sil_s AS (SELECT l.fit, d.i, l.j, sum(d.d) AS s FROM sil_d d JOIN {labels} l ON l.row_id = d.o GROUP BY ALL),
sil_ab AS (SELECT l.fit, l.row_id, any_value(own.n) AS n,
   max(s.s) FILTER (s.j = l.j) / any_value(own.n - 1) AS a, min(s.s / sn.n) FILTER (s.j <> l.j) AS b
  FROM {labels} l JOIN sil_n own ON own.fit = l.fit AND own.j = l.j
  LEFT JOIN sil_s s ON s.fit = l.fit AND s.i = l.row_id LEFT JOIN sil_n sn ON sn.fit = s.fit AND sn.j = s.j GROUP BY l.fit, l.row_id),
sil AS (SELECT fit, avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END) AS score FROM sil_ab GROUP BY fit)"""


PTS = f"{EMB}, pts AS (SELECT 'all' AS grp, row_id, x FROM emb)"


@query(f"WITH {EV}, r AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS p FROM ev) SELECT row_id, (p % 7)::INT AS cluster FROM r")
def fifo_clusters(spark, sf):
    return RoundRobin(7).place(tb.event_samples(spark, sf)).train.select("row_id", "cluster")


@query(f"""WITH {EV}, r AS (SELECT row_id, row_number() OVER (ORDER BY {h('row_id')}, row_id) - 1 AS p, count(*) OVER () AS n FROM ev),
s AS (SELECT i, sum(size) OVER (ORDER BY i) - size AS lo, sum(size) OVER (ORDER BY i) AS hi FROM (
  SELECT i, n // 7 + CASE WHEN i < n % 7 THEN 1 ELSE 0 END AS size FROM range(7) t(i), (SELECT max(n) AS n FROM r)))
SELECT row_id, i::INT AS cluster FROM r JOIN s ON p >= lo AND p < hi""")
def random_clusters(spark, sf):
    return RandomSlices(7).place(tb.event_samples(spark, sf)).train.select("row_id", "cluster")


@query(f"WITH {EV} SELECT row_id, ({bits('row_id')} % 7)::INT AS cluster FROM ev")
def random_clusters_predict(spark, sf):
    return RandomSlices(7).anywhere(tb.event_samples(spark, sf)).select("row_id", "cluster")


@query("SELECT event_id AS row_id, 0 AS cluster FROM events")
def single_cluster_all(spark, sf):
    return single_cluster(tb.event_samples(spark, sf)).select("row_id", "cluster")


LABEL_CENTRES = """cen AS (SELECT label, list(v ORDER BY feature) AS c FROM (SELECT label, feature, avg(value) AS v FROM emb_cells GROUP BY ALL) GROUP BY label)"""


def _label_centres(spark, sf):
    cells = cells_of(tb.embedding_samples(spark, sf), "row_id", "label")
    return cells.groupBy("label", "feature").agg(F.avg("value").alias("value"))


@query(f"WITH {EMB}, {LABEL_CENTRES} SELECT row_id, arg_min(cen.label::INT, list_distance(x, c)) AS cluster FROM emb, cen GROUP BY row_id")
def nearest_centre(spark, sf):
    samples = tb.embedding_samples(spark, sf)
    width = int(samples.agg(F.max(F.array_max("idx"))).first()[0] or 0) + 1
    entries = _label_centres(spark, sf).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("feature", "value"))).alias("e"))
    state = entries.select(F.lit("all").alias("fit_id"), F.lit("all").alias("group"), F.lit("0").alias("part"), F.lit(0).alias("turn"),
                           F.col("label").cast("int").alias("centre"), F.col("e.value").alias("c"))
    return ll.assign(samples, ll.Centres(state, width, 1, True), F.lit("all")).select("row_id", "cluster")


@query(f"WITH {PTS}, fits AS (SELECT 'all' AS fit, 'all' AS grp, 5 AS k), {lloyd_sql('km', 'pts', 'fits')} SELECT row_id, j::INT AS cluster FROM km_a")
def kmeans_fit(spark, sf):
    return KMeans(5, n_init=1, max_rounds=ROUNDS, tol=0).place(tb.embedding_samples(spark, sf)).train.select("row_id", "cluster")


def _flag_groups():
    return F.concat(F.col("l_returnflag"), F.lit("/"), F.col("l_linestatus"))


@query("""SELECT l_returnflag || '/' || l_linestatus AS cluster, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent
FROM lineitem GROUP BY 1""")
def cluster_sizes(spark, sf):
    return cs.cluster_sizes(tb.table(spark, sf, "lineitem").select(_flag_groups().alias("cluster"))).withColumn("percent", F.round("percent", 6))


@query("""SELECT l_returnflag || '/' || l_linestatus AS cluster, count(*) AS n, ceil(count(*) / 10000)::INT AS k1
FROM lineitem GROUP BY 1 HAVING count(*) > 10000""")
def oversize_split_k(spark, sf):
    return cs.oversize(cs.cluster_sizes(tb.table(spark, sf, "lineitem").select(_flag_groups().alias("cluster"))))


@query(f"""WITH {EMB}, {LABEL_CENTRES} SELECT emb.label::INT AS cluster, count(*) AS n, {rnd('sum(list_distance(x, c) ** 2)')} AS dispersion
FROM emb JOIN cen USING (label) GROUP BY 1 HAVING count(*) > 1""")
def dispersion(spark, sf):
    labelled = tb.embedding_samples(spark, sf).withColumn("cluster", F.col("label").cast("int"))
    centres = _label_centres(spark, sf).select(F.col("label").cast("int").alias("cluster"), "feature", "value")
    return ks.dispersion(labelled, centres).withColumn("dispersion", F.round("dispersion", 6))


FIXED = "fixed AS (SELECT k AS fit, row_id, row_id % k AS j FROM emb, range(2, 6) t(k))"


def _fixed_silhouette(spark, sf):
    samples = tb.embedding_samples(spark, sf)
    labels = F.array(*[(F.col("row_id") % k).cast("int") for k in range(2, 6)])
    scores = ks.silhouette(samples.withColumn("labels", labels), [str(k) for k in range(2, 6)])
    return scores.select(F.col("name").cast("int").alias("k"), "score")


@query(f"WITH {EMB}, {FIXED}, {silhouette_sql('emb', 'fixed')} SELECT fit::INT AS k, {rnd('score')} AS score FROM sil")
def silhouette_fixed_labels(spark, sf):
    return _fixed_silhouette(spark, sf).withColumn("score", F.round("score", 6))


SCAN = f"{PTS}, fits AS (SELECT k AS fit, 'all' AS grp, k FROM range(2, 6) t(k)), {lloyd_sql('km', 'pts', 'fits')}, {silhouette_sql('emb', 'km_a')}"


@query(f"WITH {SCAN} SELECT fit::INT AS k, {rnd('score')} AS score FROM sil")
def silhouette_scan(spark, sf):
    scores, _ = ks.silhouette_scan(tb.embedding_samples(spark, sf), [2, 3, 4, 5], n_init=1, max_rounds=ROUNDS)
    return scores.withColumn("score", F.round("score", 6))


@query(f"WITH {EMB}, {FIXED}, {silhouette_sql('emb', 'fixed')} SELECT fit::INT AS k, {rnd('score')} AS score FROM sil ORDER BY score DESC, k LIMIT 1")
def best_k(spark, sf):
    return ks.best_k(_fixed_silhouette(spark, sf).withColumn("score", F.round("score", 6)))


GAP = f"""{EMB}, pts AS (SELECT 'data' AS grp, row_id, x FROM emb UNION ALL
  SELECT 'ref' || b, i, list_transform(range(64), lambda j: {uniform("'value', b, i, j")}) FROM range(3) r(b), (SELECT row_number() OVER () - 1 AS i FROM emb)),
fits AS (SELECT DISTINCT grp || '/' || k AS fit, grp, k FROM pts, range(2, 5) t(k)), {lloyd_sql('km', 'pts', 'fits')},
sizes AS (SELECT fit, j FROM km_a GROUP BY ALL HAVING count(*) > 1),
w AS (SELECT a.grp, f.k, ln(sum(a.d2)) AS l FROM km_a a JOIN sizes s ON a.fit = s.fit AND a.j = s.j JOIN fits f ON f.fit = a.fit GROUP BY ALL),
gap AS (SELECT k, avg(l) FILTER (grp <> 'data') - max(l) FILTER (grp = 'data') AS gap,
  stddev_pop(l) FILTER (grp <> 'data') * sqrt(1 + 1 / 3) AS sk FROM w GROUP BY k)"""


@query(f"WITH {GAP} SELECT k::INT AS k, {rnd('gap')} AS gap, {rnd('sk')} AS sk FROM gap")
def gap_scan(spark, sf):
    table = ks.gap_scan(tb.embedding_samples(spark, sf), [2, 3, 4], n_refs=3, n_init=1, max_rounds=ROUNDS)
    return table.withColumn("gap", F.round("gap", 6)).withColumn("sk", F.round("sk", 6))


RULE = """rule AS (SELECT k, gap, lead(gap) OVER (ORDER BY k) AS g, lead(sk) OVER (ORDER BY k) AS s FROM gap)
SELECT coalesce(min(k) FILTER (gap >= g - s), min(k))::INT AS k FROM rule"""


@query(f"WITH {GAP}, {RULE}")
def gap_rule(spark, sf):
    return ks.best_k_by_gap(ks.gap_scan(tb.embedding_samples(spark, sf), [2, 3, 4], n_refs=3, n_init=1, max_rounds=ROUNDS))


@query("""WITH p AS (SELECT event_id AS row_id, (user_id % 3)::INT AS level0, CASE WHEN user_id % 3 = 1 THEN -1 ELSE (event_id % 2)::INT END AS level1 FROM events),
m AS (SELECT level0, level1, row_number() OVER (ORDER BY level0, level1) - 1 AS c FROM (SELECT DISTINCT level0, level1 FROM p))
SELECT row_id, level0, level1, c::INT AS cluster_id FROM p JOIN m USING (level0, level1)""")
def cascade_labels(spark, sf):
    user = F.col("user_id") % 3
    pairs = tb.table(spark, sf, "events").select(
        F.col("event_id").alias("row_id"), user.cast("int").alias("level0"),
        F.when(user == 1, -1).otherwise((F.col("event_id") % 2).cast("int")).alias("level1"))
    return cs.apply_flat_labels(pairs, cs.flat_labels(pairs)).select("row_id", "level0", "level1", "cluster_id")


def cascade_sql(train: str, score: str, cap: int) -> str:
    """Level 0 with k = 3, level 1 inside clusters above the cap; {score} rows are labelled."""
    return f"""l0_pts AS (SELECT 'all' AS grp, row_id, x FROM {train}), l0_fits AS (SELECT 'all' AS fit, 'all' AS grp, 3 AS k),
{lloyd_sql('l0', 'l0_pts', 'l0_fits')},
big AS (SELECT j, count(*) AS n FROM l0_a GROUP BY j HAVING count(*) > {cap}),
l1_pts AS (SELECT j::VARCHAR AS grp, row_id, x FROM l0_a WHERE j IN (SELECT j FROM big)),
l1_fits AS (SELECT j::VARCHAR AS fit, j::VARCHAR AS grp, ceil(n / {cap}) AS k FROM big),
{lloyd_sql('l1', 'l1_pts', 'l1_fits')},
pairs AS (SELECT DISTINCT a.j AS level0, coalesce(b.j, -1) AS level1 FROM l0_a a LEFT JOIN l1_a b USING (row_id)),
flat AS (SELECT level0, level1, row_number() OVER (ORDER BY level0, level1) - 1 AS c FROM pairs),
s0 AS (SELECT row_id, any_value(x) AS x, arg_min(c.j, list_distance(x, c.c)) AS level0 FROM {score}, l0_c c GROUP BY row_id),
s1 AS (SELECT s0.row_id, any_value(level0) AS level0, coalesce(arg_min(c.j, list_distance(x, c.c)), -1) AS level1
  FROM s0 LEFT JOIN l1_c c ON c.grp = s0.level0::VARCHAR GROUP BY s0.row_id)
SELECT row_id, s1.level0::INT AS level0, s1.level1::INT AS level1, coalesce(c, -1)::INT AS cluster_id
FROM s1 LEFT JOIN flat USING (level0, level1)"""


@query(f"WITH {EMB}, {cascade_sql('emb', 'emb', 120)}")
def cascade_fit(spark, sf):
    cascade = cs.CascadeClusterer(k=3, cap=120, n_init=1, max_rounds=ROUNDS)
    return cascade.fit_predict(tb.embedding_samples(spark, sf)).select("row_id", "level0", "level1", "cluster_id")


SPLIT = f"sp AS (SELECT *, row_number() OVER (ORDER BY {h('row_id')} || '|' || row_id::VARCHAR) <= ceil(0.2 * count(*) OVER ()) AS t FROM emb), tr AS (SELECT * FROM sp WHERE NOT t), te AS (SELECT * FROM sp WHERE t)"


@query(f"WITH {EMB}, {SPLIT}, {cascade_sql('tr', 'te', 120)}")
def cascade_predict(spark, sf):
    train, test = pf.split(tb.embedding_samples(spark, sf))
    cascade = cs.CascadeClusterer(k=3, cap=120, n_init=1, max_rounds=ROUNDS)
    cascade.fit_predict(train)
    return cascade.predict(test).select("row_id", "level0", "level1", "cluster_id")


def entropy_sql(rows: str, cells: str) -> str:
    return f"""nn AS (SELECT count(*) AS n FROM {rows}),
sp0 AS (SELECT feature, count(*) AS nnz, min(value) AS lo, max(value) AS hi FROM {cells} GROUP BY 1),
span AS (SELECT feature, nnz, CASE WHEN nnz < n THEN least(lo, 0.0) ELSE lo END AS lo, CASE WHEN nnz < n THEN greatest(hi, 0.0) ELSE hi END AS hi FROM sp0, nn),
filled AS (SELECT feature, value, 1 AS w FROM {cells} UNION ALL SELECT feature, 0.0, n - nnz FROM span, nn WHERE nnz < n),
binned AS (SELECT f.feature, CASE WHEN hi = lo THEN 0 ELSE least(19, floor((value - lo) / (hi - lo) * 20)) END AS b, sum(w) AS c
  FROM filled f JOIN span s ON f.feature = s.feature GROUP BY ALL),
ent AS (SELECT feature::INT AS feature, -sum(c / n * log2(c / n + 1e-9)) AS entropy FROM binned, nn GROUP BY 1)"""


@query(f"WITH {TOK}, {entropy_sql('tok_rows', 'tok_cells')} SELECT feature, {rnd('entropy')} AS entropy FROM ent")
def feature_entropy(spark, sf):
    cells = tb.token_cells(spark, sf)
    n = tb.token_rows(spark, sf).agg(F.count("*")).scalar()
    return en.feature_entropy(cells, n, cells.agg(F.max("feature") + 1).scalar()).select(
        F.col("feature").cast("int").alias("feature"), F.round("entropy", 6).alias("entropy"))


def _entropy_select(spark, sf, strategy):
    samples = tb.embedding_samples(spark, sf)
    cells = cells_of(samples)
    n = samples.agg(F.count("*")).scalar()
    table = en.feature_entropy(cells, n, cells.agg(F.max("feature") + 1).scalar())
    return en.entropy_select(table, 0.3, strategy).select("feature", F.round("entropy", 6).alias("entropy"), F.col("rank").cast("int").alias("rank"))


def _entropy_select_sql(way):
    return f"""WITH {EMB}, {entropy_sql('emb', 'emb_cells')}, r AS (
SELECT feature, entropy, row_number() OVER (ORDER BY round(entropy, 10) {way}, feature) AS r, count(*) OVER () AS d FROM ent)
SELECT feature, {rnd('entropy')} AS entropy, r::INT AS rank FROM r WHERE r <= ceil(d * 0.3)"""


@query(_entropy_select_sql("ASC"))
def entropy_select(spark, sf):
    return _entropy_select(spark, sf, "bottom")


@query(_entropy_select_sql("DESC"))
def entropy_select_top(spark, sf):
    return _entropy_select(spark, sf, "top")


@query(f"""WITH {LINE}, n AS (SELECT count(*) AS n FROM line)
SELECT feature, {rnd('(count(DISTINCT value) + CASE WHEN count(*) < any_value(n) THEN 1 ELSE 0 END) / any_value(n)')} AS distinct_ratio,
(count(DISTINCT value) + CASE WHEN count(*) < any_value(n) THEN 1 ELSE 0 END) / any_value(n) > 0.1 AS continuous FROM line_cells, n GROUP BY 1""")
def continuous_test(spark, sf):
    samples = tb.lineitem_samples(spark, sf)
    n = samples.agg(F.count("*")).scalar()
    return en.continuous_features(cells_of(samples), n).withColumn("distinct_ratio", F.round("distinct_ratio", 6))
