"""Shared pieces of the comparison SQL."""

HASH = "md5(concat_ws('|', '{seed}', {keys}))"


def h(keys: str, seed: int = 42) -> str:
    return HASH.format(seed=seed, keys=keys)


def bits(keys: str, seed: int = 42) -> str:
    return f"(('0x' || substr({h(keys, seed)}, 1, 13))::BIGINT)"


def uniform(keys: str, seed: int = 42) -> str:
    return f"({bits(keys, seed)} / 4503599627370496.0)"


def rnd(expr: str, digits: int = 6) -> str:
    """Rounded, without negative zero."""
    return f"(round({expr}, {digits}) + 0.0)"


EMB = """emb AS (
  SELECT vec_id AS row_id, label::DOUBLE AS label, (vec_id % 4)::INT AS cluster_id,
         list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings),
emb_cells AS (
  SELECT * FROM (SELECT row_id, label, cluster_id, unnest(range(len(x)))::INT AS feature, unnest(x) AS value FROM emb)
  WHERE value <> 0)"""

LABELLED_TOK = """tok_counts AS (
  SELECT d.doc_id AS row_id, t.token, count(*) AS n
  FROM documents d SEMI JOIN labels l ON d.doc_id = l.doc_id,
       unnest(regexp_split_to_array(lower(d.text), '\\s+')) AS t(token)
  WHERE t.token <> '' GROUP BY ALL),
tok_ids AS (SELECT token, row_number() OVER (ORDER BY md5(token), token) - 1 AS feature FROM (SELECT DISTINCT token FROM tok_counts)),
tok_rows AS (SELECT d.doc_id AS row_id, l.quality::DOUBLE AS label, (d.doc_id % 4)::INT AS cluster_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
tok_cells AS (
  SELECT c.row_id, r.label, r.cluster_id, i.feature, c.n::DOUBLE AS value
  FROM tok_counts c JOIN tok_ids i USING (token) JOIN tok_rows r USING (row_id))"""

#: The same over all documents, with a null label where there is none.
TOK = LABELLED_TOK.replace(" SEMI JOIN labels l ON d.doc_id = l.doc_id", "").replace(
    "FROM documents d JOIN labels l", "FROM documents d LEFT JOIN labels l")

LINE = """line AS (
  SELECT md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity::DECIMAL(18,2),
             l_extendedprice::DECIMAL(18,2), l_discount::DECIMAL(18,2), l_tax::DECIMAL(18,2),
             l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d'))) AS row_id,
         l_extendedprice AS label, [l_quantity, l_discount, l_tax, l_linenumber::DOUBLE] AS x,
         l_returnflag, l_linestatus FROM lineitem),
line_cells AS (
  SELECT * FROM (SELECT row_id, label, unnest(range(4))::INT AS feature, unnest(x) AS value FROM line) WHERE value <> 0)"""

EV = """kinds AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS kind FROM (SELECT DISTINCT event_type FROM events)),
ev AS (
  SELECT event_id AS row_id, kind::DOUBLE AS label, (event_id % 4)::INT AS cluster_id,
         [value, hour(ts)::DOUBLE, (props->>'$.k')::DOUBLE, (user_id % 16)::DOUBLE] AS x
  FROM events JOIN kinds USING (event_type)),
ev_cells AS (
  SELECT * FROM (SELECT row_id, label, cluster_id, unnest(range(4))::INT AS feature, unnest(x) AS value FROM ev) WHERE value <> 0)"""


def newton_sql(rows: str, width: int, task: str, rounds: int = 16, c: float = 1.0, epsilon: float = 0.1) -> str:
    """CTEs of an unrolled Newton solution of the squared losses: from {rows}(fit, x, y), x with a constant last
    column and y +-1 or the target, to sol(fit, w) and fin(fit, objective, n_train, n_support)."""
    wide = range(1, width + 1)
    margin = "1 - y * f" if task == "clf" else f"abs(y - f) - {epsilon}"
    aim = "y" if task == "clf" else f"(y - sign(y - f) * {epsilon})"
    parts = [f"w0 AS MATERIALIZED (SELECT DISTINCT fit, [{', '.join('0.0::DOUBLE' for _ in wide)}] AS w FROM {rows})"]
    for r in range(rounds):
        parts.append(f"f{r} AS (SELECT fit, x, y, list_dot_product(x, w) AS f FROM {rows} JOIN w{r} USING (fit))")
        cells = [[f"{2 * c} * coalesce(sum(x[{i}] * x[{j}]) FILTER ({margin} > 0), 0)" + (f" + {1.0 if i < width else 1e-9}" if i == j else "") for j in wide]
                 + [f"{2 * c} * coalesce(sum(x[{i}] * {aim}) FILTER ({margin} > 0), 0)"] for i in wide]
        parts.append(f"e{r}_0 AS MATERIALIZED (SELECT fit, [{', '.join('[' + ', '.join(row) + ']' for row in cells)}] AS m FROM f{r} GROUP BY fit)")
        for k in wide:      # positive definite, so no pivot is looked for
            parts.append(f"e{r}_{k} AS MATERIALIZED (SELECT fit, list_transform(m, lambda q, i: CASE WHEN i = {k} THEN p ELSE list_transform(q, lambda v, j: v - q[{k}] * p[j]) END) AS m "
                         f"FROM (SELECT fit, m, list_transform(m[{k}], lambda v: v / m[{k}][{k}]) AS p FROM e{r}_{k - 1}))")
        parts.append(f"w{r + 1} AS MATERIALIZED (SELECT fit, list_transform(m, lambda q: q[{width + 1}]) AS w FROM e{r}_{width})")
    parts.append(f"sol AS (SELECT fit, w FROM w{rounds})")
    square = " + ".join(f"any_value(w[{i}]) ** 2" for i in range(1, width))
    parts.append(f"fin AS (SELECT fit, 0.5 * ({square}) + {c} * coalesce(sum(({margin}) ** 2) FILTER ({margin} > 0), 0) AS objective, count(*) AS n_train, "
                 f"count(*) FILTER ({margin} > 0) AS n_support FROM (SELECT fit, x, y, w, list_dot_product(x, w) AS f FROM {rows} JOIN sol USING (fit)) GROUP BY fit)")
    return ",\n".join(parts)
