"""Training, tuning, wrapper selection, prediction, whole runs, logs and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import svm, tuning, wrapper
from ..operators.clusterers import RoundRobin
from ..operators.rows import cells_of, normalize
from ..operators import evaluate as ev
from ..session import cut, shared_folder
from ..sources import profile as pf
from ..sources import runlog
from ..sources import tables as tb
from .pipeline import Config, Pipeline, run_lines
from .registry import query
from .sqlparts import EMB, EV, LINE, bits, h, newton_sql, rnd, uniform
from . import sweep as sw


def _emb_rows(spark, sf):
    return tb.embedding_samples(spark, sf).withColumn("cluster_id", (F.col("row_id") % 4).cast("int")).withColumn("copy", F.lit(0))


def _clusters(spark, sf):
    return tb.table(spark, sf, "embeddings").select((F.col("vec_id") % 4).cast("int").alias("cluster_id")).distinct()


def _event_rows(spark, sf):
    return tb.event_samples(spark, sf).withColumn("cluster_id", (F.col("row_id") % 4).cast("int")).withColumn("copy", F.lit(0))


def _line_rows(spark, sf):
    flag = F.col("l_returnflag")
    return tb.lineitem_samples_with(tb.spread_table(spark, sf, "lineitem"), cluster_id=F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2)).withColumn("copy", F.lit(0))


@query()
def flagship(spark, sf):
    """Embeddings, L2, four first-in-first-out clusters, one linear model each, test metrics."""
    samples = normalize(tb.embedding_samples(spark, sf))
    train, test = pf.split(samples)
    place = lambda df: RoundRobin(4).place(df).train.withColumnRenamed("cluster", "cluster_id")
    rows = cut(place(train).withColumn("copy", F.lit(0)))
    params = svm.params_by_cluster(rows.select("cluster_id").distinct()).withColumn("kernel", F.lit("linear"))
    job = svm.SvmJob(rows, "clf")
    models = cut(job.train(params))
    predictions = svm.predict(place(test), models, params, svm.train_shape(job.blocks), "clf", job.marks)
    return ev.metrics(cut(predictions), "clf")


# --- folds, parameters, trials -------------------------------------------------------------------

FOLDS = """cl AS (SELECT cluster_id, label, count(*) AS n FROM {rows} GROUP BY ALL),
nf AS (SELECT cluster_id, greatest(2, least(5, {few})) AS n_folds FROM cl GROUP BY 1),
fo AS (SELECT r.row_id, r.cluster_id, n_folds, ((row_number() OVER (PARTITION BY {part} ORDER BY {hash}, r.row_id) - 1) % n_folds) AS fold
  FROM {rows} r JOIN nf USING (cluster_id))"""
STRATIFIED = FOLDS.format(rows="emb", few="min(n)", part="r.cluster_id, r.label", hash=h("r.row_id, 0"))
PLAIN = FOLDS.format(rows="ev", few="sum(n) // 2", part="r.cluster_id", hash=h("r.row_id, 0"))


@query(f"WITH {EMB}, {STRATIFIED} SELECT row_id, cluster_id, n_folds::INT AS n_folds, fold::INT AS fold FROM fo")
def fold_assign_stratified(spark, sf):
    return svm.assign_folds(_emb_rows(spark, sf), 5, "clf").select("row_id", "cluster_id", "n_folds", "fold")


@query(f"WITH {EV}, {PLAIN} SELECT row_id, cluster_id, n_folds::INT AS n_folds, fold::INT AS fold FROM fo")
def fold_assign_plain(spark, sf):
    return svm.assign_folds(_event_rows(spark, sf), 5, "reg").select("row_id", "cluster_id", "n_folds", "fold")


@query(f"""WITH c AS (SELECT DISTINCT (vec_id % 4)::INT AS cluster_id FROM embeddings), k AS (SELECT unnest(range(4)) AS k, unnest(['rbf', 'linear', 'poly', 'sigmoid']) AS kernel)
SELECT cluster_id, ((i * 6 + j) * 4 + k)::INT AS trial, kernel, {rnd('10 ** (i - 3)')} AS c, {rnd('10 ** (-5 + 7.0 * j / 5)')} AS gamma, 0.1::DOUBLE AS epsilon
FROM c, range(7) a(i), range(6) b(j), k""")
def param_grid(spark, sf):
    grid = tuning.grid_params(_clusters(spark, sf), "clf")
    return grid.withColumn("c", F.round("c", 6)).withColumn("gamma", F.round("gamma", 6))


def _log_uniform(name, lo, hi):
    return rnd(f"exp(ln({lo}) + {uniform(f'{chr(39)}{name}{chr(39)}, cluster_id, trial')} * (ln({hi}) - ln({lo})))")


@query(f"""WITH t AS (SELECT DISTINCT (vec_id % 4)::INT AS cluster_id, trial::INT AS trial FROM embeddings, range(10) r(trial))
SELECT cluster_id, trial, ['rbf', 'linear', 'poly', 'sigmoid'][1 + {bits("'kernel', cluster_id, trial")} % 4] AS kernel,
{_log_uniform('c', '1e-3', '1e3')} AS c, {_log_uniform('gamma', '1e-4', '1e1')} AS gamma, {rnd(uniform("'epsilon', cluster_id, trial"))} AS epsilon FROM t""")
def param_random(spark, sf):
    drawn = tuning.random_params(_clusters(spark, sf), 10, "reg")
    for name in ("c", "gamma", "epsilon"):
        drawn = drawn.withColumn(name, F.round(name, 6))
    return drawn


@query("""WITH c AS (SELECT (vec_id % 4)::INT AS cluster_id, avg(embedding[1]::DOUBLE) AS m FROM embeddings GROUP BY 1)
SELECT cluster_id, 0 AS trial, CASE WHEN m > 0 THEN 'linear' ELSE 'rbf' END AS kernel, CASE WHEN m > 0 THEN 10.0 ELSE 1.0 END::DOUBLE AS c,
CASE WHEN m > 0 THEN 0.5 END::DOUBLE AS gamma, CASE WHEN m > 0 THEN 0.2 ELSE 0.1 END::DOUBLE AS epsilon FROM c""")
def params_by_cluster(spark, sf):
    means = tb.table(spark, sf, "embeddings").groupBy((F.col("vec_id") % 4).cast("int").alias("cluster_id")).agg(F.avg(F.col("embedding")[0].cast("double")).alias("m"))
    tuned = means.filter("m > 0").select("cluster_id", F.lit("linear").alias("kernel"), F.lit(10.0).alias("c"), F.lit(0.5).alias("gamma"), F.lit(0.2).alias("epsilon"))
    return svm.params_by_cluster(means.select("cluster_id"), tuned)


# A rule per trial stands for the model: the label if component `trial` is positive.
RULE_SUMS = f"""{EMB}, {STRATIFIED}, tr AS (SELECT e.cluster_id, e.row_id, e.label, fo.fold, t.trial, CASE WHEN x[trial + 1] > 0 THEN label ELSE (label + 1) % 10 END AS guess
  FROM emb e JOIN fo USING (row_id, cluster_id), range(4) t(trial)),
sums AS (SELECT cluster_id, trial, fold, count(*) AS n, count(*) FILTER (label = guess) AS hits, sum((label - guess) ** 2) AS sse, var_pop(label) * count(*) AS sst
  FROM tr GROUP BY ALL)"""


def _rule_sums(spark, sf):
    folds = svm.assign_folds(_emb_rows(spark, sf), 5, "clf")
    trials = folds.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(3))))
    guess = F.when(F.get("val", F.col("trial")) > 0, F.col("label")).otherwise((F.col("label") + 1) % 10)
    error = F.col("label") - F.col("guess")
    return trials.withColumn("guess", guess).groupBy("cluster_id", "trial", "fold").agg(
        F.count("*").alias("n"), F.sum((F.col("label") == F.col("guess")).cast("bigint")).alias("hits"),
        F.sum(error * error).alias("sse"), F.sum("label").alias("sum_y"), F.sum(F.col("label") * F.col("label")).alias("sum_yy"))


@query(f"WITH {RULE_SUMS} SELECT cluster_id, trial::INT AS trial, fold::INT AS fold, {rnd('hits / n')} AS score FROM sums")
def cv_score_clf(spark, sf):
    return tuning.fold_scores(_rule_sums(spark, sf), "clf").withColumn("score", F.round("score", 6))


@query(f"WITH {RULE_SUMS} SELECT cluster_id, trial::INT AS trial, fold::INT AS fold, {rnd('1 - sse / sst')} AS score FROM sums")
def cv_score_reg(spark, sf):
    return tuning.fold_scores(_rule_sums(spark, sf), "reg").withColumn("score", F.round("score", 6))


TRIALS = RULE_SUMS + ", ts AS (SELECT cluster_id, trial, avg(hits / n) AS score FROM sums GROUP BY ALL)"


@query(f"""WITH {TRIALS}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(score, 9) DESC, trial) AS r FROM ts)
SELECT cluster_id, trial::INT AS trial, {rnd('score')} AS best_score FROM r WHERE r = 1""")
def trial_best(spark, sf):
    scores = tuning.trial_scores(tuning.fold_scores(_rule_sums(spark, sf), "clf")).withColumn("score", F.round("score", 9))
    return tuning.best_trials(scores).withColumn("best_score", F.round("best_score", 6))


@query(f"""WITH {TRIALS} SELECT cluster_id, trial::INT AS trial, {rnd('score')} AS score,
row_number() OVER (PARTITION BY cluster_id ORDER BY round(score, 9) DESC, trial) <= ceil(0.25 * count(*) OVER (PARTITION BY cluster_id)) AS good FROM ts""")
def tpe_split(spark, sf):
    scores = tuning.trial_scores(tuning.fold_scores(_rule_sums(spark, sf), "clf")).withColumn("score", F.round("score", 9))
    return tuning.good_trials(scores).withColumn("score", F.round("score", 6))


# --- wrapper pieces -----------------------------------------------------------------------------

MASKS = f"""sh AS (SELECT cluster_id, max(feature) + 1 AS d FROM emb_cells GROUP BY 1),
dr AS (SELECT cluster_id, bee, f, {uniform("'mask', cluster_id, bee, f")} AS u FROM (SELECT cluster_id, bee, unnest(range(d)) AS f FROM sh, range({{bees}}) b(bee))),
mk AS (SELECT cluster_id, bee, f, u < 0.5 OR row_number() OVER (PARTITION BY cluster_id, bee ORDER BY u, f) <= {{least}} AS m FROM dr)"""


@query(f"WITH {EMB}, {MASKS.format(bees=20, least=34)} SELECT cluster_id, bee::INT AS bee, string_agg(m::INT::VARCHAR, '' ORDER BY f) AS state FROM mk GROUP BY 1, 2")
def wrapper_candidates(spark, sf):
    shape = _emb_rows(spark, sf).groupBy("cluster_id").agg((F.max(F.array_max("idx")) + 1).alias("d"))
    return wrapper.candidate_masks(shape, 20, 34).select("cluster_id", "bee", wrapper.mask_key().alias("state"))


@query(f"""WITH {EMB}, {MASKS.format(bees=20, least=5)}, fit AS (SELECT m.cluster_id, m.bee, round(avg(e.value) FILTER (m.m), 9) AS fitness
  FROM mk m JOIN emb_cells e ON e.cluster_id = m.cluster_id AND e.feature = m.f GROUP BY ALL)
SELECT cluster_id, bee::INT AS bee, {rnd('fitness')} AS fitness, row_number() OVER w ::INT AS rank,
CASE WHEN row_number() OVER w <= 5 THEN 'elite' WHEN row_number() OVER w <= 15 THEN 'best' ELSE 'other' END AS site
FROM fit WINDOW w AS (PARTITION BY cluster_id ORDER BY fitness DESC, bee)""")
def wrapper_rank(spark, sf):
    """Ranking and sites, with the mean of the chosen columns standing for the fitness."""
    rows = _emb_rows(spark, sf)
    shape = rows.groupBy("cluster_id").agg((F.max(F.array_max("idx")) + 1).alias("d"))
    sums = cells_of(rows, "cluster_id", "row_id").groupBy("cluster_id", "feature").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    on = wrapper.candidate_masks(shape, 20, 5).select("cluster_id", "bee", F.posexplode("mask").alias("feature", "on")).filter("on")
    fitness = on.join(sums, ["cluster_id", "feature"]).groupBy("cluster_id", "bee").agg(F.round(F.sum("s") / F.sum("n"), 9).alias("fitness"))
    return wrapper.rank_bees(fitness).withColumn("fitness", F.round("fitness", 6))


FLIPS = f"""st AS (SELECT cluster_id, bee, string_agg(m::INT::VARCHAR, '' ORDER BY f) AS state, any_value(d) AS d FROM mk JOIN sh USING (cluster_id) GROUP BY 1, 2),
q AS (SELECT cluster_id, state, (bee % 7)::INT AS action, (bee % 3)::DOUBLE AS value FROM st WHERE bee < 10),
known AS (SELECT cluster_id, state, arg_max(action, value * 100 - action) AS a FROM q GROUP BY 1, 2),
fl AS (SELECT st.*, CASE WHEN {uniform("'0/1', 'explore', cluster_id, bee")} < 0.1 OR a IS NULL THEN ({bits("'0/1', 'action', cluster_id, bee")} % d)::INT ELSE a END AS action
  FROM st LEFT JOIN known USING (cluster_id, state))"""


@query(f"""WITH {EMB}, {MASKS.format(bees=20, least=5)}, {FLIPS}
SELECT cluster_id, bee::INT AS bee, state, action, substr(state, 1, action) || CASE WHEN substr(state, action + 1, 1) = '1' THEN '0' ELSE '1' END || substr(state, action + 2) AS next_state FROM fl""")
def wrapper_flips(spark, sf):
    """The next flip of 20 bees of every cluster, some with known actions."""
    shape = _emb_rows(spark, sf).groupBy("cluster_id").agg((F.max(F.array_max("idx")) + 1).alias("d"))
    bees = wrapper.candidate_masks(shape, 20, 5).withColumn("state", wrapper.mask_key())
    q = bees.filter("bee < 10").select("cluster_id", "state", (F.col("bee") % 7).cast("int").alias("action"), (F.col("bee") % 3).cast("double").alias("value"))
    flips = wrapper.propose_flips(bees, q, "0/1", 0.1)
    return flips.select("cluster_id", "bee", "state", "action", wrapper.mask_key("next_mask").alias("next_state"))


MOVES = """q AS (SELECT (event_id % 4)::INT AS cluster_id, event_type AS state, (user_id % 5)::INT AS action, avg(value) AS value FROM events GROUP BY ALL),
mv AS (SELECT (event_id % 4)::INT AS cluster_id, event_type AS state, (user_id % 7)::INT AS action, avg(value) / 10 AS reward, lower(max(event_type || '')) AS next_state FROM events GROUP BY ALL)"""


@query(f"""WITH {MOVES}, ahead AS (SELECT cluster_id, state AS next_state, max(value) AS ahead FROM q GROUP BY ALL),
new AS (SELECT mv.cluster_id, mv.state, mv.action, coalesce(q.value, 0) + 0.1 * (reward + 0.9 * coalesce(ahead, 0) - coalesce(q.value, 0)) AS value
  FROM mv LEFT JOIN ahead USING (cluster_id, next_state) LEFT JOIN q USING (cluster_id, state, action))
SELECT cluster_id, state, action, {rnd('value')} AS value FROM (SELECT * FROM new UNION ALL SELECT * FROM q ANTI JOIN new USING (cluster_id, state, action))""")
def q_update(spark, sf):
    """One round of Q-learning, with event types as states and means of values as Q values and rewards."""
    events = tb.table(spark, sf, "events").select((F.col("event_id") % 4).cast("int").alias("cluster_id"), F.col("event_type").alias("state"), "user_id", "value")
    q = events.groupBy("cluster_id", "state", (F.col("user_id") % 5).cast("int").alias("action")).agg(F.avg("value").alias("value"))
    moves = events.groupBy("cluster_id", "state", (F.col("user_id") % 7).cast("int").alias("action")).agg(
        (F.avg("value") / 10).alias("reward"), F.lower(F.max("state")).alias("next_state"))
    return wrapper.update_q(q, moves, 0.1, 0.9).withColumn("value", F.round("value", 6))


# --- routed prediction with given linear weights --------------------------------------------------

CENTROIDS = """cc AS (SELECT cluster_id, label, list(v ORDER BY feature) AS c FROM (SELECT cluster_id, label, feature, sum(value) AS v0, avg(value) AS v FROM emb_cells GROUP BY ALL) GROUP BY ALL),
prs AS (SELECT a.cluster_id, a.label AS p, b.label AS n, list_transform(range(1, 65), lambda i: a.c[i] - b.c[i]) AS w,
  -0.5 * (list_dot_product(a.c, a.c) - list_dot_product(b.c, b.c)) AS b FROM cc a JOIN cc b ON a.cluster_id = b.cluster_id AND a.label < b.label),
vt AS (SELECT e.row_id, e.cluster_id, e.label, CASE WHEN list_dot_product(e.x, w) + b > 0 THEN p ELSE n END AS v FROM emb e JOIN prs USING (cluster_id)),
vc AS (SELECT row_id, cluster_id, label, v, count(*) AS votes FROM vt GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY votes DESC, v) AS r FROM vc)"""


@query(f"WITH {EMB}, {CENTROIDS} SELECT row_id, cluster_id, label, v AS prediction FROM rk WHERE r = 1")
def route_linear_predict(spark, sf):
    """Every row goes to its cluster's class-pair models; the weights are differences of class means."""
    rows = _emb_rows(spark, sf)
    means = cells_of(rows, "cluster_id", "label").groupBy("cluster_id", "label", "feature").agg(F.avg("value").alias("v"))
    packed = means.groupBy("cluster_id", "label").agg(F.sort_array(F.collect_list(F.struct("feature", "v")))["v"].alias("c"))
    a, b = packed.alias("a"), packed.alias("b")
    pairs = a.join(b, (F.col("a.cluster_id") == F.col("b.cluster_id")) & (F.col("a.label") < F.col("b.label")))
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v)
    weights = F.concat(F.zip_with("a.c", "b.c", lambda x, y: x - y), F.array(-0.5 * (square("a.c") - square("b.c"))))
    models = pairs.select(F.col("a.cluster_id").alias("cluster_id"), F.lit(0).alias("trial"), F.lit(-1).alias("fold"),
                          F.col("a.label").alias("class_pos"), F.col("b.label").alias("class_neg"), weights.alias("weights"))
    params = svm.params_by_cluster(models.select("cluster_id").distinct()).withColumn("kernel", F.lit("linear"))
    shape = models.groupBy("cluster_id").agg(F.max(F.size("weights") - 1).alias("d"), F.lit(1.0).alias("variance"))
    return svm.predict(rows, models, params, shape, "clf").drop("trial")


@query(f"""WITH {EMB}, {CENTROIDS} SELECT 'Fixed k: ' || count(DISTINCT cluster_id) AS value FROM rk UNION ALL
SELECT 'Overall Accuracy: ' || printf('%.4f', count(*) FILTER (label = v) / count(*)) FROM rk WHERE r = 1""")
def run_report(spark, sf):
    """The lines of a run's report, for the routed predictions above."""
    predictions = cut(route_linear_predict(spark, sf))
    info = predictions.agg(F.count_distinct("cluster_id").cast("string").alias("value")).select(F.lit("configuration").alias("section"), F.lit("Fixed k").alias("key"), "value")
    return run_lines(info, ev.metrics(predictions, "clf").filter("metric = 'accuracy'"))


# --- training, tuning, search (no SQL form) -------------------------------------------------------


def _train(rows, task, **override):
    params = svm.params_by_cluster(rows.select("cluster_id").distinct())
    for name, value in override.items():
        params = params.withColumn(name, F.lit(value))
    return svm.SvmJob(rows, task).train(params)


MODEL_COLUMNS = ["cluster_id", "class_pos", "class_neg", "objective", "residual", "rounds", "n_train", "n_support"]


EVENT_FITS = f"""{EV}, kk AS (SELECT DISTINCT cluster_id, label FROM ev),
prs AS (SELECT a.cluster_id, a.label AS p, b.label AS q FROM kk a JOIN kk b ON a.cluster_id = b.cluster_id AND a.label < b.label),
fits AS (SELECT [ev.cluster_id::DOUBLE, p, q] AS fit, list_append(x, 1.0) AS x, CASE WHEN label = p THEN 1.0 ELSE -1.0 END AS y
  FROM ev JOIN prs ON prs.cluster_id = ev.cluster_id AND label IN (p, q))"""


def _objective(models):
    """The minimum itself: its logarithm keeps six digits at any size."""
    return models.withColumn("log_objective", F.round(F.log("objective"), 6)).drop("objective")


@query(f"""WITH {EVENT_FITS}, {newton_sql('fits', 5, 'clf')}
SELECT fit[1]::INT AS cluster_id, fit[2] AS class_pos, fit[3] AS class_neg, {rnd('ln(objective)')} AS log_objective, n_train, n_support FROM fin""")
def svm_train_linear(spark, sf):
    models = _train(_event_rows(spark, sf), "clf", kernel="linear")
    return _objective(models.select("cluster_id", "class_pos", "class_neg", "objective", "n_train", "n_support"))


@query()
def svm_train_rbf(spark, sf):
    return _train(_emb_rows(spark, sf), "clf").select(*MODEL_COLUMNS)


@query()
def svm_train_poly(spark, sf):
    return _train(_emb_rows(spark, sf), "clf", kernel="poly").select(*MODEL_COLUMNS)


@query()
def svm_train_sigmoid(spark, sf):
    return _train(_emb_rows(spark, sf), "clf", kernel="sigmoid").select(*MODEL_COLUMNS)


LINE_FITS = f"""{LINE}, fits AS (SELECT (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END)::INT AS fit, list_append(x, 1.0) AS x, label AS y FROM line)"""


@query(f"WITH {LINE_FITS}, {newton_sql('fits', 5, 'reg')} SELECT fit AS cluster_id, {rnd('ln(objective)')} AS log_objective, n_train, n_support FROM fin")
def svr_train(spark, sf):
    models = _train(_line_rows(spark, sf), "reg", kernel="linear")
    return _objective(models.select("cluster_id", "objective", "n_train", "n_support"))


@query(f"""WITH {EVENT_FITS}, {newton_sql('fits', 5, 'clf')}, votes AS (
  SELECT row_id, ev.cluster_id, label, CASE WHEN list_dot_product(list_append(x, 1.0), w) > 0 THEN fit[2] ELSE fit[3] END AS v FROM ev JOIN sol ON fit[1] = ev.cluster_id),
tally AS (SELECT row_id, cluster_id, label, v, count(*) AS votes FROM votes GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY votes DESC, v) AS r FROM tally)
SELECT cluster_id, count(*) AS n, count(*) FILTER (label = v) AS hits FROM best WHERE r = 1 GROUP BY 1""")
def svm_train_predict(spark, sf):
    """Models trained on all events, votes of their class pairs for every event, right votes per cluster."""
    rows = _event_rows(spark, sf)
    params = svm.params_by_cluster(rows.select("cluster_id").distinct()).withColumn("kernel", F.lit("linear"))
    job = svm.SvmJob(rows, "clf")
    models = cut(job.train(params))
    out = svm.predict(rows, models, params, svm.train_shape(job.blocks), "clf", job.marks)
    return out.groupBy("cluster_id").agg(F.count("*").alias("n"), F.sum((F.col("label") == F.col("prediction")).cast("bigint")).alias("hits"))


@query(f"""WITH {EVENT_FITS}, {newton_sql('fits', 5, 'clf')}
SELECT fit[2] AS class_pos, fit[3] AS class_neg, {rnd('ln(objective)')} AS log_objective, n_train, n_support FROM fin WHERE fit[1] = 1""")
def model_lookup(spark, sf):
    models = svm.get_model(_train(_event_rows(spark, sf), "clf", kernel="linear"), 1)
    return _objective(models.select("class_pos", "class_neg", "objective", "n_train", "n_support"))


@query(f"""WITH {EVENT_FITS}, {newton_sql('fits', 5, 'clf')}
SELECT fit[1]::INT AS cluster_id, sum(n_support)::BIGINT AS n_support_vectors, count(*) AS n_fits, NULL::VARCHAR AS error, 'clf' AS task_type FROM fin GROUP BY 1""")
def svm_report(spark, sf):
    report = svm.train_report(_train(_event_rows(spark, sf), "clf", kernel="linear"), "clf")
    return report.select("cluster_id", "n_support_vectors", "n_fits", "error", "task_type")


@query()
def svm_train_grown(spark, sf):
    """rbf models whose landmarks grow until the kernel misses 2 % at most."""
    rows = _event_rows(spark, sf)
    params = svm.params_by_cluster(rows.select("cluster_id").distinct())
    job = svm.SvmJob(rows, "clf")
    job.grow(params, 0.02)
    return svm.train_report(job.train(params), "clf", job.residuals).drop("training_time")


def _tune(spark, sf, optimizer, **options):
    rows = svm.assign_folds(_event_rows(spark, sf), 5, "clf")
    job = svm.SvmJob(rows, "clf")
    _, best = tuning.tune(job, rows.select("cluster_id").distinct(), optimizer, **options)
    return best


@query()
def tune_random(spark, sf):
    return _tune(spark, sf, "random", n_iter=10)


@query()
def tune_bayes(spark, sf):
    return _tune(spark, sf, "bayes", n_iter=10)


@query()
def tune_tpe(spark, sf):
    return _tune(spark, sf, "tpe", n_iter=10)


@query()
def tune_grid(spark, sf):
    rows = svm.assign_folds(_emb_rows(spark, sf), 2, "clf")
    job = svm.SvmJob(rows, "clf", landmarks=16, max_rounds=15)
    return tuning.tune(job, rows.select("cluster_id").distinct(), "grid")[1]


@query()
def wrapper_select(spark, sf):
    rows = svm.assign_folds(_event_rows(spark, sf), 3, "clf")
    job = svm.SvmJob(rows, "clf")
    shape = rows.groupBy("cluster_id").agg((F.max(F.array_max("idx")) + 1).alias("d"))
    options = wrapper.SwarmOptions(bees=6, generations=2, elite=2, best=2, elite_bees=2, best_bees=1, elite_steps=2, best_steps=1, min_features=2)
    return wrapper.select_features(job, shape, options).select("cluster_id", wrapper.mask_key().alias("state"), "fitness")


# --- whole runs -----------------------------------------------------------------------------------


@query()
def end_to_end_clf(spark, sf):
    train, test = pf.split(tb.event_samples(spark, sf))
    config = Config("clf", clustering=True, k=3, cascade=True, cap=4000, balance=True, independence=True, construction=True,
                    mutual_info=True, n_init=1, max_rounds=6)
    return Pipeline(config).run(train, test).metrics


@query()
def end_to_end_text(spark, sf):
    train, test = pf.split(tb.token_samples(spark, sf, labelled=True))
    config = Config("clf", clustering=True, k=2, entropy_ratio=0.3, balance=True, mutual_info=True, n_init=1, max_rounds=6,
                    defaults={"kernel": "linear"})
    return Pipeline(config).run(train, test).metrics


@query()
def end_to_end_reg(spark, sf):
    train, test = pf.split(tb.lineitem_samples(spark, sf))
    config = Config("reg", clustering=True, k=2, cascade=True, cap=30_000, construction=True, n_init=1, max_rounds=6,
                    defaults={"kernel": "linear", "c": 10.0})
    return Pipeline(config).run(train, test).metrics


@query()
def sweep_best_run(spark, sf):
    train, test = pf.split(tb.embedding_samples(spark, sf))
    configs = sw.grid(Config("clf", clustering=True, method="fifo", k=2, defaults={"kernel": "linear"}), [None], [2, 4])
    return sw.best_runs(sw.sweep({"embeddings": (train, test)}, configs), "accuracy")


# --- run logs: written as files, one log per label, with a rule's results, and read back ------------------------------

LOG = """lg AS (SELECT 'log_docs' || label || '_20240101.log' AS file, label, count(*) AS n, avg((embedding[1] > 0)::INT) AS a FROM embeddings GROUP BY label)"""


@query(f"""WITH {LOG} SELECT 'docs' || label AS "Dataset", round(a, 4)::VARCHAR AS "Overall Accuracy", NULL AS "Overall F1 Score",
{', '.join("NULL AS " + chr(34) + k + chr(34) if k not in ("Training time",) else "n || '.50' AS " + chr(34) + k + chr(34) for k in runlog.TIMING_KEYS)},
{', '.join(("'clf' AS " if k == "Task type" else "'kmeans' AS " if k == "Algorithm" else "n::VARCHAR AS " if k == "Fixed k" else "NULL AS ") + chr(34) + k + chr(34) for k in runlog.CONFIGURATION_KEYS)},
file AS "Log File" FROM lg""")
def run_log_summary(spark, sf):
    e = tb.table(spark, sf, "embeddings")
    logs = e.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("embedding")[0] > 0).cast("int")), 4).alias("a"))
    text = F.array(
        F.lit("INFO -   Task type: reg"), F.lit("INFO -   Task type: clf "), F.lit("INFO -   Algorithm: kmeans"),
        F.concat(F.lit("INFO -   Fixed k: "), "n"), F.lit("INFO - Training time reached without a value"),
        F.concat(F.lit("INFO -   Training time: "), "n", F.lit(".50 seconds")),
        F.lit("INFO - Overall Accuracy: 0.0"), F.concat(F.lit("INFO - Overall Accuracy: "), F.col("a").cast("string")))
    logs = logs.select(F.concat(F.lit("log_docs"), "label", F.lit("_20240101.log")).alias("file"), F.concat_ws("\n", text).alias("text"))
    folder = shared_folder(spark)
    runlog.write_logs(logs, folder)
    return runlog.summarise(runlog.read_logs(spark, folder))
