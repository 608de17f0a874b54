"""Predictive power: the same cross-validation by sums, said in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.plans.power import predictive_matrix, predictors
from millrace.queries.registry import query

ORDER_KINDS = {"o_orderkey": "n", "o_custkey": "n", "o_orderstatus": "t", "o_totalprice": "n", "o_orderdate": "ts", "o_orderpriority": "t"}
_LINE = {"l_partkey": "n", "l_linenumber": "n", "l_quantity": "n", "l_extendedprice": "n", "l_discount": "n", "l_returnflag": "t", "l_linestatus": "t", "l_shipdate": "ts"}


def power_sql(table: str, kinds: dict[str, str], targets: list[str], key: list[str]) -> str:
    """Scores of all columns for the targets; ``kinds`` says which are numbers (n), times (ts) and texts (t)."""

    def values(name: str) -> str:
        number = {"n": f"CAST({name} AS DOUBLE)", "ts": f"CAST(epoch_us({name}) AS DOUBLE)", "t": "CAST(NULL AS DOUBLE)"}[kinds[name]]
        text = f"CAST({name} AS VARCHAR)" if kinds[name] == "t" else "CAST(NULL AS VARCHAR)"
        return f"SELECT id, k, '{name}' AS name, {number} AS n, {text} AS s FROM numbered WHERE {name} IS NOT NULL"

    joined = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in key)
    wanted = ", ".join(f"'{t}'" for t in targets)
    return f"""
    WITH numbered AS (SELECT *, row_number() OVER () AS id, (strpos('0123456789abcdef', md5({joined})[1]) - 1) % 4 AS k FROM {table}),
    v AS ({' UNION ALL '.join(values(n) for n in kinds)}),
    cells AS (
      SELECT x.name AS f, y.name AS t, x.n AS xn, x.s AS xs, y.n AS yn, y.s AS ys, x.k, count(*) AS n
      FROM v AS x JOIN v AS y ON x.id = y.id AND x.name <> y.name AND y.name IN ({wanted}) GROUP BY ALL),
    pairs AS (
      SELECT f, t, sum(n) AS total, count(DISTINCT coalesce(ys, CAST(yn AS VARCHAR))) AS y_values, count(DISTINCT coalesce(xs, CAST(xn AS VARCHAR))) AS x_values, count(yn) > 0 AS number, count(xs) > 0 AS text
      FROM cells GROUP BY f, t),
    cases AS (
      SELECT f, t, CASE WHEN total < 8 THEN 'too_few_rows' WHEN y_values = 1 THEN 'target_is_constant' WHEN text AND x_values >= total THEN 'feature_is_id'
        WHEN NOT number AND y_values >= total THEN 'target_is_id' WHEN number AND y_values > 2 THEN 'regression' ELSE 'classification' END AS kind FROM pairs),
    c AS (SELECT cells.*, kind, coalesce(ys, CAST(yn AS VARCHAR)) AS label FROM cells JOIN cases USING (f, t) WHERE kind IN ('regression', 'classification')),
    folds AS (SELECT unnest([0, 1, 2, 3]) AS fold),
    outside AS (SELECT f, t, xn, xs, fold, label, any_value(yn) AS yn, sum(n) AS n FROM c JOIN folds ON k <> fold GROUP BY f, t, xn, xs, fold, label),
    train AS (SELECT f, t, xn, xs, fold, sum(yn * n) / sum(n) AS mean, arg_min(label, (-n, label)) AS best FROM outside GROUP BY f, t, xn, xs, fold),
    whole AS (
      SELECT f, t, fold, sum(yn * n) / sum(n) AS mean, arg_min(label, (-n, label)) AS best
      FROM (SELECT f, t, fold, label, any_value(yn) AS yn, sum(n) AS n FROM outside GROUP BY f, t, fold, label) GROUP BY f, t, fold),
    asked AS (SELECT DISTINCT f, t, xn, k FROM c WHERE xn IS NOT NULL),
    numbers AS (SELECT * FROM train WHERE xn IS NOT NULL),
    near AS (
      SELECT a.f, a.t, a.xn, a.k, hi.xn IS NULL OR a.xn - lo.xn <= hi.xn - a.xn AS lower, lo.mean AS lm, lo.best AS lb, hi.mean AS hm, hi.best AS hb
      FROM asked AS a ASOF LEFT JOIN numbers AS lo ON a.f = lo.f AND a.t = lo.t AND a.k = lo.fold AND a.xn >= lo.xn
      ASOF LEFT JOIN numbers AS hi ON a.f = hi.f AND a.t = hi.t AND a.k = hi.fold AND a.xn <= hi.xn),
    told AS (
      SELECT c.f, c.t, c.k, c.kind, c.yn, c.label, c.n, CASE WHEN lower THEN lm ELSE hm END AS mean, CASE WHEN lower THEN lb ELSE hb END AS best
      FROM c JOIN near ON c.f = near.f AND c.t = near.t AND c.k = near.k AND c.xn = near.xn
      UNION ALL
      SELECT c.f, c.t, c.k, c.kind, c.yn, c.label, c.n, coalesce(train.mean, whole.mean), coalesce(train.best, whole.best)
      FROM c JOIN whole ON c.f = whole.f AND c.t = whole.t AND c.k = whole.fold
      LEFT JOIN train ON c.f = train.f AND c.t = train.t AND c.k = train.fold AND c.xs = train.xs WHERE c.xs IS NOT NULL),
    totals AS (SELECT f, t, kind, label, any_value(yn) AS yn, sum(n) AS n FROM c GROUP BY f, t, kind, label),
    medians AS (SELECT x.name AS f, y.name AS t, quantile_cont(y.n, 0.5) AS middle FROM v AS x JOIN v AS y ON x.id = y.id AND x.name <> y.name AND y.name IN ({wanted}) WHERE y.n IS NOT NULL GROUP BY ALL),
    regression AS (
      SELECT f, t, avg(e) AS model FROM (SELECT f, t, k, sum(n * abs(yn - mean)) / sum(n) AS e FROM told WHERE kind = 'regression' GROUP BY f, t, k) GROUP BY f, t),
    median_error AS (SELECT f, t, sum(n * abs(yn - middle)) / sum(n) AS baseline FROM totals JOIN medians USING (f, t) WHERE kind = 'regression' GROUP BY f, t),
    classes AS (
      SELECT f, t, k, class, sum(own) AS own, sum(said) AS said, sum(hit) AS hit FROM (
        SELECT f, t, k, label AS class, n AS own, 0 AS said, CASE WHEN label = best THEN n ELSE 0 END AS hit FROM told WHERE kind = 'classification'
        UNION ALL SELECT f, t, k, best, 0, n, 0 FROM told WHERE kind = 'classification') GROUP BY f, t, k, class),
    classification AS (
      SELECT f, t, avg(f1) AS model FROM (SELECT f, t, k, sum(own * 2 * hit / (own + said)) / sum(own) AS f1 FROM classes GROUP BY f, t, k) GROUP BY f, t),
    shares AS (SELECT f, t, max(n) / sum(n) AS share FROM totals WHERE kind = 'classification' GROUP BY f, t),
    scored AS (
      SELECT f, t, greatest(0, 1 - model / baseline) AS score, 'mean absolute error' AS metric, baseline, model FROM regression JOIN median_error USING (f, t)
      UNION ALL
      SELECT f, t, greatest(0, (model - b) / (1 - b)), 'weighted F1', b, model FROM classification JOIN (SELECT f, t, share * 2 * share / (1 + share) AS b FROM shares) USING (f, t))
    SELECT f AS x, t AS y, CAST(coalesce(score, CASE WHEN kind = 'target_is_constant' THEN 1 ELSE 0 END) AS DOUBLE) AS score, kind AS "case", metric, baseline, model
    FROM cases LEFT JOIN scored USING (f, t)"""


def _compared(scores: str) -> str:
    # errors of times are large numbers; how much of the baseline's is left says the same
    return f'SELECT x, y, round(score, 6) AS score, "case", metric, round(model / baseline, 6) AS ratio FROM ({scores})'


def compared_scores(df):
    return df.select("x", "y", F.round("score", 6).alias("score"), "case", "metric", F.round(F.col("model") / F.col("baseline"), 6).alias("ratio"))


def _itself(names) -> str:
    return "".join(f" UNION ALL SELECT '{n}', '{n}', 1, 'predict_itself', NULL, NULL" for n in names)


def power_matrix_sql(table: str, kinds: dict[str, str], key: list[str]) -> str:
    return _compared(power_sql(table, kinds, list(kinds), key)) + _itself(kinds)


_LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey"]
query("e24_predictors", lambda t: compared_scores(predictors(t("lineitem"), "l_extendedprice", list(_LINE), fold_by=_LINE_KEY)), _compared(power_sql("lineitem", _LINE, ["l_extendedprice"], _LINE_KEY)))
query("e24_predictors_of_class", lambda t: compared_scores(predictors(t("lineitem"), "l_returnflag", list(_LINE), fold_by=_LINE_KEY)), _compared(power_sql("lineitem", _LINE, ["l_returnflag"], _LINE_KEY)))
query("e25_predictive_matrix", lambda t: compared_scores(predictive_matrix(t("orders"), fold_by=["o_orderkey"])), power_matrix_sql("orders", ORDER_KINDS, ["o_orderkey"]))
