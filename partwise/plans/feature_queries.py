"""Class repair, independence, construction and mutual information queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import balance as bl
from ..operators import construct as ct
from ..operators import independence as ind
from ..operators import mutual as mi
from ..operators.rows import apply_selection, cells_of, selection_map
from ..session import small, stored
from ..sources import profile as pf
from ..sources import tables as tb
from .registry import query
from .sqlparts import EMB, LINE, TOK, bits, h, rnd

# --- class repair: clusters that mostly hold one third of the classes -----------------------

SKEWED = """CASE WHEN label = 9 AND vec_id % 5 = 1 THEN 3 WHEN vec_id % 7 = 0 THEN vec_id % 3 ELSE label % 3 END"""
MEMBERS = f"mem AS (SELECT ({SKEWED})::INT AS cluster_id, vec_id AS row_id, label::DOUBLE AS label FROM embeddings)"
SHORT = f"""cnt AS (SELECT cluster_id, label, count(*) AS n FROM mem GROUP BY ALL),
cls AS (SELECT *, max(n) OVER (PARTITION BY cluster_id) AS majority, count(*) OVER (PARTITION BY cluster_id) AS classes FROM cnt),
labs AS (SELECT list(DISTINCT label ORDER BY label) AS labs FROM mem),
donor AS (SELECT cluster_id, o[1 + {bits("'donor', cluster_id")} % len(o)] AS label, 0::BIGINT AS n, majority
  FROM (SELECT cluster_id, majority, list_filter(labs, lambda l: l <> label) AS o FROM cls, labs WHERE classes = 1) WHERE len(o) > 0),
need AS (SELECT cluster_id, label, n, majority FROM cls WHERE n / majority < 0.1 OR n < 2 UNION ALL SELECT * FROM donor),
avail AS (SELECT need.*, s.supply, s.supply - n AS available FROM need JOIN (SELECT label, count(*) AS supply FROM mem GROUP BY 1) s USING (label) WHERE s.supply > n),
short AS (SELECT *, CASE WHEN least(greatest(5, floor(majority * 0.1)) - n, 100, available) <= 0 THEN greatest(2, floor(majority * 0.5))
  ELSE least(greatest(5, floor(majority * 0.1)) - n, 100, available) END::BIGINT AS additional FROM avail)"""
SUPPLEMENT = f"""ord AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY {h('row_id')}, row_id) - 1 AS place FROM mem),
cand AS (SELECT s.cluster_id, s.label, o.row_id, s.available, s.additional,
  ((o.place - {bits("'start', s.cluster_id, s.label")} % s.supply) + s.supply) % s.supply AS step FROM short s JOIN ord o USING (label)
  WHERE NOT EXISTS (SELECT 1 FROM mem m WHERE m.cluster_id = s.cluster_id AND m.row_id = o.row_id)),
turn AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, label ORDER BY step) - 1 AS turn FROM cand),
sup AS (SELECT cluster_id, row_id, label, unnest(range(1, ((additional - 1 - turn) // least(available, additional))::BIGINT + 2))::INT AS copy
  FROM turn WHERE turn < additional)"""


def _members(spark, sf):
    e = tb.table(spark, sf, "embeddings")
    cluster = (F.when((F.col("label") == 9) & (F.col("vec_id") % 5 == 1), 3)
               .when(F.col("vec_id") % 7 == 0, F.col("vec_id") % 3).otherwise(F.col("label") % 3))
    return e.select(cluster.cast("int").alias("cluster_id"), F.col("vec_id").alias("row_id"), F.col("label").cast("double").alias("label"))


@query(f"WITH {MEMBERS}, {SHORT} SELECT cluster_id, label, n, majority, n / majority < 0.1 OR n < 2 AS small FROM cls")
def class_counts(spark, sf):
    return bl.class_counts(_members(spark, sf)).drop("classes")


@query(f"WITH {MEMBERS}, {SHORT} SELECT * FROM donor")
def donor_class(spark, sf):
    members = _members(spark, sf)
    return bl.donor_classes(bl.class_counts(members), members.select("row_id", "label"))


@query(f"WITH {MEMBERS}, {SHORT} SELECT cluster_id, label, n, majority, available, additional FROM short")
def class_shortage(spark, sf):
    members = _members(spark, sf)
    return bl.shortages(members, members.select("row_id", "label")).select("cluster_id", "label", "n", "majority", "available", "additional")


@query(f"WITH {MEMBERS}, {SHORT}, {SUPPLEMENT} SELECT cluster_id, row_id, label, copy FROM sup")
def class_supplements(spark, sf):
    members = _members(spark, sf)
    train = members.select("row_id", "label")
    return bl.supplements(members, train, bl.shortages(members, train))


@query(f"WITH {MEMBERS}, {SHORT}, {SUPPLEMENT} SELECT cluster_id, row_id, label, 0 AS copy FROM mem UNION ALL SELECT cluster_id, row_id, label, copy FROM sup")
def balanced_clusters(spark, sf):
    members = _members(spark, sf)
    return bl.balance(members, members.select("row_id", "label"))


# --- independence ----------------------------------------------------------------------------

COUNTS = """siz AS (SELECT cluster_id, count(*) AS n FROM tok_rows GROUP BY 1),
grid AS (SELECT cluster_id, n, unnest(range((SELECT max(feature) + 1 FROM tok_cells))) AS feature FROM siz),
cnt AS (SELECT g.cluster_id, g.feature, coalesce(c.nonzero, 0) AS nonzero, g.n - coalesce(c.nonzero, 0) AS zero
  FROM grid g LEFT JOIN (SELECT cluster_id, feature, count(*) AS nonzero FROM tok_cells GROUP BY ALL) c USING (cluster_id, feature))"""
SCORES = """abcd AS (SELECT cluster_id, feature, nonzero::DOUBLE AS a, (sum(nonzero) OVER f - nonzero)::DOUBLE AS b, zero::DOUBLE AS c, (sum(zero) OVER f - zero)::DOUBLE AS d
  FROM cnt WINDOW f AS (PARTITION BY feature)),
sc AS (SELECT cluster_id, feature, ((a+1)*(d+1) - (b+1)*(c+1)) ** 2 / ((a+b+1)*(a+c+1)*(c+b+1)*(c+d+1)) AS score FROM abcd)"""


def _token_clusters(spark, sf):
    cluster = (F.col("row_id") % 4).cast("int").alias("cluster_id")
    rows = tb.token_rows(spark, sf).select("row_id", cluster)
    return rows, tb.token_cells(spark, sf).select("row_id", "feature", "value", cluster)


def _independence(spark, sf, tokens=None):
    rows, cells = tokens or _token_clusters(spark, sf)
    return ind.Independence(cells, rows.groupBy("cluster_id").agg(F.count("*").alias("n")), cells.agg(F.max("feature") + 1).first()[0] or 0)


@query(f"WITH {TOK}, {COUNTS} SELECT cluster_id, feature::INT AS feature, nonzero, zero FROM cnt")
def independence_counts(spark, sf):
    return _independence(spark, sf).counts().select("cluster_id", F.col("feature").cast("int").alias("feature"), "nonzero", (F.col("n") - F.col("nonzero")).alias("zero"))


@query(f"WITH {TOK}, {COUNTS}, {SCORES} SELECT cluster_id, feature::INT AS feature, {rnd('score', 9)} AS score FROM sc")
def independence_scores(spark, sf):
    return _independence(spark, sf).scores().select("cluster_id", F.col("feature").cast("int").alias("feature"), F.round("score", 9).alias("score"))


@query(f"""WITH {TOK}, {COUNTS}, {SCORES}, hit AS (SELECT *, score >= 0.01 AS hit FROM sc),
sel AS (SELECT *, hit OR NOT bool_or(hit) OVER (PARTITION BY cluster_id) AS selected FROM hit)
SELECT cluster_id, feature::INT AS feature, {rnd('score', 9)} AS score, selected,
CASE WHEN selected THEN sum(selected::INT) OVER (PARTITION BY cluster_id ORDER BY feature) - 1 END::INT AS out_feature FROM sel""")
def independence_select(spark, sf):
    chosen = _independence(spark, sf).select(0.01)
    return chosen.select("cluster_id", F.col("feature").cast("int").alias("feature"), F.round("score", 9).alias("score"), "selected", "out_feature")


@query(f"""WITH {TOK}, {COUNTS}, {SCORES}, hit AS (SELECT *, score >= 0.01 AS hit FROM sc),
sel AS (SELECT *, hit OR NOT bool_or(hit) OVER (PARTITION BY cluster_id) AS selected FROM hit),
num AS (SELECT *, sum(selected::INT) OVER (PARTITION BY cluster_id ORDER BY feature) - 1 AS o FROM sel)
SELECT c.cluster_id, c.row_id, num.o::INT AS feature, c.value FROM tok_cells c JOIN num USING (cluster_id, feature) WHERE selected""")
def independence_replay(spark, sf):
    from ..operators.rows import project_selected
    rows, cells = _token_clusters(spark, sf)
    return project_selected(cells, stored(_independence(spark, sf, (rows, cells)).selection(0.01))).select("cluster_id", "row_id", F.col("feature").cast("int").alias("feature"), "value")


# --- construction ----------------------------------------------------------------------------

FLAGS = "(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END)::INT"


def _emb_rows(spark, sf):
    samples = tb.embedding_samples(spark, sf)
    return samples.withColumn("cluster_id", (F.col("row_id") % 4).cast("int")).withColumn("copy", F.lit(0))


def _line_rows(spark, sf):
    """lineitem rows in three clusters; the flags travel with the digest id."""
    flag = F.col("l_returnflag")
    items = tb.spread_table(spark, sf, "lineitem")
    samples = tb.lineitem_samples_with(items, cluster_id=F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2),
                                       status=F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0))
    return samples.withColumn("copy", F.lit(0))


LINE_C = LINE + f""", lc AS (SELECT row_id, label, {FLAGS} AS cluster_id, (l_linestatus = 'O')::INT::DOUBLE AS status, x FROM line),
dense AS (SELECT cluster_id, row_id, label, status, unnest(range(4))::INT AS feature, unnest(x) AS value FROM lc)"""
EMB_C = EMB + """, dense AS (SELECT cluster_id, row_id, label, label AS status, unnest(range(64))::INT AS feature, unnest(x) AS value FROM emb)"""
STATS = """st AS (SELECT cluster_id, feature, count(*) AS n, avg(value) AS m, stddev_pop(value) AS s, max(value) - min(value) AS range FROM dense GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY range DESC, feature) AS rank, count(*) OVER (PARTITION BY cluster_id) AS d FROM st),
top AS (SELECT * FROM rk WHERE rank <= ceil(d * {ratio}))"""
EDGES = """raw AS (SELECT cluster_id, feature, quantile_cont(value, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM dense JOIN top USING (cluster_id, feature) GROUP BY ALL),
edges AS (SELECT cluster_id, feature, list_filter(e, lambda v, i: i = 1 OR v - e[i - 1] > 1e-8) AS edges FROM raw)"""
BINS = """inn AS (SELECT cluster_id, feature, CASE WHEN len(edges) > 2 THEN edges[2:len(edges) - 1] ELSE [] END AS inn, t.rank,
  FROM edges JOIN top t USING (cluster_id, feature)),
base AS (SELECT *, sum(len(inn) + 1) OVER (PARTITION BY cluster_id ORDER BY rank) - len(inn) - 1 AS start FROM inn),
hot AS (SELECT dense.cluster_id, row_id, base.feature, start + len(list_filter(inn, lambda e: e <= value)) AS col,
  len(list_filter(inn, lambda e: e <= value)) AS bin FROM dense JOIN base USING (cluster_id, feature))"""
PAIRS = """prs AS (SELECT i, j, row_number() OVER (ORDER BY i, j) - 1 AS p FROM range(5) a(i), range(6) b(j) WHERE i < j),
pv AS (SELECT cluster_id, row_id, p, x[i + 1] * x[j + 1] AS prod, CASE WHEN x[j + 1] <> 0 THEN x[i + 1] / x[j + 1] ELSE 0 END AS ratio
  FROM {rows}, prs WHERE j < len(x))"""


@query(f"WITH {LINE_C}, {STATS.format(ratio=0.5)} SELECT cluster_id, row_id, feature, {rnd('(value - m) / CASE WHEN s = 0 THEN 1 ELSE s END')} AS value FROM dense JOIN st USING (cluster_id, feature)")
def standardise(spark, sf):
    rows = _line_rows(spark, sf)
    state = _state(rows, 0.5)
    wide = rows.join(state, "cluster_id").withColumn("x", ct._dense(F.col("d")))
    return wide.select("cluster_id", "row_id", F.posexplode(ct.standardise()).alias("feature", "value")).withColumn(
        "value", F.round("value", 6))


def _state(rows, ratio):
    return ct.fit_construction(cells_of(rows, "cluster_id", "row_id"), ct.shapes(rows), ratio)


@query(f"WITH {EMB_C}, {STATS.format(ratio=0.1)} SELECT cluster_id, feature, n, {rnd('range')} AS range, rank::INT AS rank FROM top")
def range_rank(spark, sf):
    rows = _emb_rows(spark, sf)
    top = ct.range_rank(ct.column_stats(cells_of(rows, "cluster_id", "row_id"), ct.shapes(rows)), 0.1)
    return top.withColumn("range", F.round("range", 6))


@query(f"""WITH {LINE_C}, {STATS.format(ratio=1.0)}, {EDGES}
SELECT cluster_id, feature, unnest(range(len(edges)))::INT AS q, round(unnest(edges), 6) AS edge FROM edges""")
def quantile_edges(spark, sf):
    rows = _line_rows(spark, sf)
    cells = cells_of(rows, "cluster_id", "row_id")
    top = ct.range_rank(ct.column_stats(cells, ct.shapes(rows)), 1.0)
    return ct.quantile_edges(cells, top).select("cluster_id", "feature", F.posexplode("edges").alias("q", "edge")).withColumn("edge", F.round("edge", 6))


@query(f"WITH {LINE_C}, {STATS.format(ratio=0.5)}, {EDGES}, {BINS} SELECT cluster_id, row_id, col::INT AS feature FROM hot")
def quantile_onehot(spark, sf):
    rows = _line_rows(spark, sf)
    wide = rows.join(_state(rows, 0.5), "cluster_id").withColumn("x", ct._dense(F.col("d")))
    hot = wide.select("cluster_id", "row_id", F.posexplode(ct.one_hot()).alias("feature", "value"))
    return hot.filter("value <> 0").drop("value")


def _pairs(spark, sf, offset, rows):
    wide = rows.withColumn("d", F.lit(4)).withColumn("x", ct._dense(F.col("d")))
    all_pairs = wide.select("cluster_id", "row_id", F.posexplode(ct.pair_columns()).alias("c", "value"))
    return all_pairs.filter(F.col("c") % 2 == offset).select(
        "cluster_id", "row_id", F.floor(F.col("c") / 2).cast("int").alias("pair"), F.round("value", 6).alias("value"))


@query(f"WITH {LINE_C}, {PAIRS.format(rows='lc')}, q AS (SELECT *, dense_rank() OVER (ORDER BY p) - 1 AS pair FROM pv) SELECT cluster_id, row_id, pair::INT AS pair, {rnd('prod')} AS value FROM q")
def pair_product(spark, sf):
    return _pairs(spark, sf, 0, _line_rows(spark, sf))


@query(f"WITH {LINE_C}, {PAIRS.format(rows='lc')}, q AS (SELECT *, dense_rank() OVER (ORDER BY p) - 1 AS pair FROM pv) SELECT cluster_id, row_id, pair::INT AS pair, {rnd('ratio')} AS value FROM q")
def pair_ratio(spark, sf):
    return _pairs(spark, sf, 1, _line_rows(spark, sf))


CONSTRUCT = f"""WITH {EMB_C}, {STATS.format(ratio=0.1)}, {EDGES}, {BINS}, {PAIRS.format(rows='emb')},
wid AS (SELECT cluster_id, sum(len(inn) + 1) AS w FROM base GROUP BY 1),
allc AS (SELECT cluster_id, row_id, feature, value FROM dense
 UNION ALL SELECT cluster_id, row_id, 64 + feature, (value - m) / CASE WHEN s = 0 THEN 1 ELSE s END FROM dense JOIN st USING (cluster_id, feature)
 UNION ALL SELECT cluster_id, row_id, 128 + col, 1.0 FROM hot
 UNION ALL SELECT cluster_id, row_id, 128 + w + 2 * p, prod FROM pv JOIN wid USING (cluster_id)
 UNION ALL SELECT cluster_id, row_id, 129 + w + 2 * p, ratio FROM pv JOIN wid USING (cluster_id))
SELECT cluster_id, row_id, feature::INT AS feature, {rnd('value')} AS value FROM allc WHERE value <> 0"""


@query(CONSTRUCT)
def construct_all(spark, sf):
    rows = _emb_rows(spark, sf)
    built = ct.construct(rows, _state(rows, 0.1))
    return cells_of(built, "cluster_id", "row_id").withColumn("value", F.round("value", 6))


# --- mutual information ------------------------------------------------------------------------


def mutual_sql(points: str) -> str:
    """{points}(cluster_id, feature, row_id, label, value)."""
    psi = ("CASE WHEN {n} < 10 THEN list_sum(list_transform(range(1, {n}), lambda i: 1.0 / i)) ELSE "
           "ln({n}) - 1 / (2.0 * {n}) - 1 / (12.0 * {n} * {n}) + 1 / (120.0 * {n} ** 4) - 1 / (252.0 * {n} ** 6) + 0.5772156649015329 END - 0.5772156649015329")

    def digamma(n):
        return "(" + psi.format(n=f"({n})::BIGINT").replace("list_sum(list_transform", "coalesce(list_sum(list_transform").replace("1.0 / i))", "1.0 / i)), 0)") + ")"

    return f"""ls AS (SELECT cluster_id, label, count(*) AS nl FROM (SELECT DISTINCT cluster_id, row_id, label FROM {points}) GROUP BY ALL HAVING count(*) > 1),
up AS (SELECT p.*, nl FROM {points} p JOIN ls USING (cluster_id, label)),
scl AS (SELECT cluster_id, feature, CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS s, avg(abs(value)) AS a FROM up GROUP BY ALL),
jit AS (SELECT up.cluster_id, up.feature, row_id, label, nl,
  value / s + 1e-10 * greatest(1.0, a / s) * (2 * ({bits("row_id, 0")} / 4503599627370496.0) - 1) AS v FROM up JOIN scl USING (cluster_id, feature)),
rk2 AS (SELECT *, rank() OVER w - 1 AS lt, count(*) OVER (PARTITION BY cluster_id, feature ORDER BY v) AS le FROM jit WINDOW w AS (PARTITION BY cluster_id, feature ORDER BY v)),
nb AS (SELECT *, list_filter([
    {', '.join(f"{{'gap': abs(v - {fn}(v, {i}) OVER l), 'side': {side}, 'vv': {fn}(v, {i}) OVER l, 'lt': {fn}(lt, {i}) OVER l, 'le': {fn}(le, {i}) OVER l}}" for i in (1, 2, 3) for fn, side in (('lag', -1), ('lead', 1)))}
  ], lambda g: g.gap IS NOT NULL) AS gs FROM rk2 WINDOW l AS (PARTITION BY cluster_id, feature, label ORDER BY v, row_id)),
kk AS (SELECT *, least(3, nl - 1) AS k, list_sort(gs)[least(3, nl - 1)] AS g FROM nb),
evs AS (SELECT cluster_id, feature, row_id, 2 * v - g.vv AS pt, CASE WHEN g.side = -1 THEN 0 ELSE 2 END AS kind FROM kk
  UNION ALL SELECT cluster_id, feature, row_id, v, 1 FROM jit),
far AS (SELECT *, sum((kind = 1)::INT) OVER (PARTITION BY cluster_id, feature ORDER BY pt, kind ROWS UNBOUNDED PRECEDING) AS far FROM evs),
mm AS (SELECT kk.cluster_id, kk.feature, k, nl, CASE WHEN g.gap = 0 THEN kk.le - kk.lt WHEN g.side = -1 THEN far - g.le ELSE g.lt - far END AS m
  FROM kk JOIN far f ON f.cluster_id = kk.cluster_id AND f.feature = kk.feature AND f.row_id = kk.row_id AND f.kind <> 1),
cnts AS (SELECT cluster_id, feature, count(*) AS n, avg({digamma('k')}) AS pk, avg({digamma('nl')}) AS pl, avg({digamma('m')}) AS pm FROM mm GROUP BY ALL),
mi AS (SELECT cluster_id, feature, greatest(0.0, {digamma('n')} + pk - pl - pm) AS score FROM cnts)"""


EMB_POINTS = EMB_C + ", pts AS (SELECT cluster_id, feature, row_id, label, value FROM dense)"
LINE_POINTS = LINE_C + ", pts AS (SELECT cluster_id, feature, row_id, status AS label, value FROM dense)"
REG_POINTS = LINE_C + """, tq AS (SELECT cluster_id, quantile_cont(label, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) AS e FROM lc GROUP BY 1),
ti AS (SELECT cluster_id, list_filter(e, lambda v, i: i = 1 OR v - e[i - 1] > 1e-8) AS e FROM tq),
pts AS (SELECT cluster_id, feature, row_id, len(list_filter(e[2:len(e) - 1], lambda q: q <= label))::DOUBLE AS label, value FROM dense JOIN ti USING (cluster_id))"""


def _mutual(rows):
    return mi.mutual_information(rows, ct.shapes(rows))


@query(f"WITH {EMB_POINTS}, {mutual_sql('pts')} SELECT cluster_id, feature, {rnd('score')} AS score FROM mi")
def mutual_info_clf(spark, sf):
    return _mutual(_emb_rows(spark, sf)).withColumn("score", F.round("score", 6))


@query(f"WITH {LINE_POINTS}, {mutual_sql('pts')} SELECT cluster_id, feature, {rnd('score')} AS score FROM mi")
def mutual_info_sparse(spark, sf):
    return _mutual(_line_rows(spark, sf).withColumn("label", F.col("status"))).withColumn("score", F.round("score", 6))


@query(f"WITH {REG_POINTS}, {mutual_sql('pts')} SELECT cluster_id, feature, {rnd('score')} AS score FROM mi")
def mutual_info_reg(spark, sf):
    return _mutual(mi.quantile_label(_line_rows(spark, sf))).withColumn("score", F.round("score", 6))


def selection_sql(percent, least):
    return f"""rs AS (SELECT *, round(score, 10) AS s FROM mi),
cu AS (SELECT cluster_id, count(*) AS d, quantile_cont(s, 1 - {percent} / 100) AS cut FROM rs GROUP BY 1),
ab AS (SELECT rs.*, d, s > cut AS above, s = cut AS tie, row_number() OVER (PARTITION BY cluster_id ORDER BY s DESC, feature) AS rank FROM rs JOIN cu USING (cluster_id)),
tp AS (SELECT *, floor(d * {percent} / 100) - sum(above::INT) OVER (PARTITION BY cluster_id) AS room,
  sum((tie AND NOT above)::INT) OVER (PARTITION BY cluster_id ORDER BY feature) AS place FROM ab),
ht AS (SELECT *, above OR (tie AND place <= room) AS hit FROM tp),
en AS (SELECT *, sum(hit::INT) OVER (PARTITION BY cluster_id) >= {least} AS enough FROM ht),
se AS (SELECT *, CASE WHEN enough THEN hit ELSE rank <= {least} END AS selected FROM en)
SELECT cluster_id, feature, {rnd('score')} AS score, selected, CASE WHEN enough THEN 'percentile' ELSE 'k_best' END AS method,
CASE WHEN selected THEN sum(selected::INT) OVER (PARTITION BY cluster_id ORDER BY feature) - 1 END::INT AS out_feature FROM se"""


@query(f"WITH {EMB_POINTS}, {mutual_sql('pts')}, {selection_sql(50, 5)}")
def top_percentile(spark, sf):
    return mi.select_features(_mutual(_emb_rows(spark, sf)), 50, 5).withColumn("score", F.round("score", 6))


@query(f"WITH {EMB_POINTS}, {mutual_sql('pts')}, {selection_sql(5, 10)}")
def k_best(spark, sf):
    return mi.select_features(_mutual(_emb_rows(spark, sf)), 5, 10).withColumn("score", F.round("score", 6))


@query(f"SELECT * FROM (WITH {EMB_POINTS}, {mutual_sql('pts')}, {selection_sql(50, 5)}) WHERE cluster_id = 1 AND selected")
def feature_stats(spark, sf):
    chosen = mi.select_features(_mutual(_emb_rows(spark, sf)), 50, 5).withColumn("score", F.round("score", 6))
    return mi.feature_stats(chosen, 1)


@query(f"""SELECT c.cluster_id, c.row_id, s.out_feature AS feature, c.value FROM (
SELECT vec_id AS row_id, (vec_id % 4)::INT AS cluster_id, unnest(range(64))::INT AS feature, unnest(embedding)::DOUBLE AS value FROM embeddings) c
JOIN (WITH {EMB_POINTS}, {mutual_sql('pts')}, {selection_sql(50, 5)}) s USING (cluster_id, feature) WHERE s.selected AND c.value <> 0""")
def mutual_replay(spark, sf):
    """Scores, choice and projection of every cluster, as a run applies them."""
    rows = _emb_rows(spark, sf)
    chosen = mi.select_features(_mutual(rows), 50, 5)
    return cells_of(apply_selection(rows, small(selection_map(ind.as_selection(chosen)))), "cluster_id", "row_id")


SPLIT_ROWS = f"""sp AS (SELECT *, row_number() OVER (ORDER BY {h('row_id')} || '|' || row_id::VARCHAR) <= ceil(0.2 * count(*) OVER ()) AS t FROM emb),
tr AS (SELECT * FROM sp WHERE NOT t), te AS (SELECT * FROM sp WHERE t),
dense AS (SELECT cluster_id, row_id, label, unnest(range(64))::INT AS feature, unnest(x) AS value FROM tr),
tdense AS (SELECT cluster_id, row_id, label, unnest(range(64))::INT AS feature, unnest(x) AS value FROM te)"""
REPLAY = f"""WITH {EMB}, {SPLIT_ROWS}, {STATS.format(ratio=0.1)}, {EDGES}, {BINS.replace('FROM dense JOIN base', 'FROM tdense dense JOIN base')}, {PAIRS.format(rows='te')},
wid AS (SELECT cluster_id, sum(len(inn) + 1) AS w FROM base GROUP BY 1),
allc AS (SELECT cluster_id, row_id, feature, value FROM tdense
 UNION ALL SELECT cluster_id, row_id, 64 + feature, (value - m) / CASE WHEN s = 0 THEN 1 ELSE s END FROM tdense JOIN st USING (cluster_id, feature)
 UNION ALL SELECT cluster_id, row_id, 128 + col, 1.0 FROM hot
 UNION ALL SELECT cluster_id, row_id, 128 + w + 2 * p, prod FROM pv JOIN wid USING (cluster_id)
 UNION ALL SELECT cluster_id, row_id, 129 + w + 2 * p, ratio FROM pv JOIN wid USING (cluster_id))
SELECT cluster_id, row_id, feature::INT AS feature, {rnd('value')} AS value FROM allc WHERE value <> 0"""


@query(REPLAY)
def construct_replay(spark, sf):
    """Construction fitted on the train part, replayed on the test part."""
    train, test = pf.split(tb.embedding_samples(spark, sf))
    place = lambda df: df.withColumn("cluster_id", (F.col("row_id") % 4).cast("int")).withColumn("copy", F.lit(0))
    built = ct.construct(place(test), _state(place(train), 0.1))
    return cells_of(built, "cluster_id", "row_id").withColumn("value", F.round("value", 6))
