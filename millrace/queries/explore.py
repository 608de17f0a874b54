"""Profiles, relations between columns, chart data, custom functions and recipes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

import millrace as m
from millrace.plans import chartdata as chart, profile, relate
from millrace.plans.recipe import Recipe, register_op, registered_op
from millrace.queries.power import ORDER_KINDS, compared_scores, power_matrix_sql
from millrace.queries.registry import Tables, query, rounded, scratch
from millrace.queries.tables import _LABELLED, labelled
from millrace.sources.ranged import parquet_ranges, ranged_source, read_parquet_range

# --- one column ----------------------------------------------------------------------------------


def _facts(table: str, columns: dict[str, str], valid: bool = False) -> str:
    parts = []
    for i, (c, kind) in enumerate(columns.items(), 1):
        extra = f"count({c}) AS valid_count, " if valid else ""
        parts.append(
            f"SELECT {i} AS position, '{c}' AS \"column\", '{kind}' AS dtype, {extra}count(DISTINCT {c}) AS unique_count, round(count(DISTINCT {c}) * 100.0 / count(*), 6) AS unique_percent, "
            f"count(*) - count({c}) AS missing_count, round((count(*) - count({c})) * 100.0 / count(*), 6) AS missing_percent FROM {table}"
        )
    return " UNION ALL ".join(parts)


_LINE = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double",
         "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp"}
_DOCS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
_LABEL = {"doc_id": "bigint", "lang": "string", "source": "string", "n_chars": "bigint", "quality": "int", "toxic": "int"}

query("e01_glimpse", lambda t: rounded(profile.glimpse(t("lineitem"))), _facts("lineitem", _LINE))
query("e01_glimpse_texts", lambda t: rounded(profile.glimpse(t("documents"))), _facts("documents", _DOCS))


def _stored_states(t: Tables) -> DataFrame:
    """States of parts, written, read and merged, against the exact facts."""
    folder = scratch(t.spark)
    m.column_states(t("lineitem").withColumn("part", F.col("l_returnflag")), list(_LINE), by=["part"]).write.parquet(folder)
    told = m.state_facts(m.merge_states(t.spark.read.parquet(folder)))
    exact = profile.glimpse(t("lineitem")).select("column", F.col("unique_count").alias("exact"))
    near = F.abs(F.col("unique_count") - F.col("exact")) <= 0.04 * F.col("exact") + 1
    return told.join(exact, "column").select("column", "dtype", "rows", "missing_count", F.col("exact").alias("unique_count"), near.alias("near"))


query("e01_glimpse_states", _stored_states,
      " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{kind}' AS dtype, count(*) AS \"rows\", count(*) - count({c}) AS missing_count, count(DISTINCT {c}) AS unique_count, true AS near FROM lineitem" for c, kind in _LINE.items()))
query("e01_glimpse_sketch", lambda t: profile.glimpse(labelled(t), exact=False).select("position", "column", "dtype", "missing_count"),
      " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS \"column\", '{k}' AS dtype, count(*) - count({c}) AS missing_count FROM {_LABELLED}" for i, (c, k) in enumerate(_LABEL.items(), 1)))
query("e02_column_summary", lambda t: rounded(profile.column_summary(labelled(t))), _facts(_LABELLED, _LABEL, valid=True))
query("e03_missing_rows", lambda t: profile.missing_rows(labelled(t), "toxic"), f"SELECT * FROM {_LABELLED} WHERE toxic IS NULL")
query("e03_missing_report", lambda t: rounded(profile.missing_report(labelled(t), "toxic")),
      f"""SELECT count(*) AS "rows", count(*) - count(toxic) AS missing_count, round((count(*) - count(toxic)) * 100.0 / count(*), 6) AS missing_percent FROM {_LABELLED}""")


def _value_counts(table: str, column: str, top: str = "") -> str:
    return f"""SELECT * FROM (SELECT row_number() OVER w AS rank, {column}, n AS "count", round(n * 100.0 / sum(n) OVER (), 6) AS "percent",
               CAST(sum(n) OVER w AS BIGINT) AS cumulative_count, round(sum(n) OVER w * 100.0 / sum(n) OVER (), 6) AS cumulative_percent
               FROM (SELECT {column}, count(*) AS n FROM {table} WHERE {column} IS NOT NULL GROUP BY {column}) WINDOW w AS (ORDER BY n DESC, {column} ROWS UNBOUNDED PRECEDING)) {top}"""


query("e04_value_counts", lambda t: rounded(profile.value_counts(t("events"), "user_id")), _value_counts("events", "user_id", "WHERE rank <= 10"))
query("e04_value_counts_all", lambda t: rounded(profile.value_counts(t("lineitem"), "l_shipdate", top=None)), _value_counts("lineitem", "l_shipdate"))
query("w04_running_share", lambda t: rounded(profile.value_counts(t("lineitem"), "l_partkey", top=None)).select("l_partkey", "cumulative_count", "cumulative_percent"),
      f"SELECT l_partkey, cumulative_count, cumulative_percent FROM ({_value_counts('lineitem', 'l_partkey')})")
query("e05_boolean_counts", lambda t: rounded(profile.value_counts(m.with_formula(labelled(t), "good", "quality = 1"), "good")),
      _value_counts(f"(SELECT quality = 1 AS good FROM {_LABELLED})", "good"))
_STATS = """count({0}) AS "count", min({0}) AS "min", round(quantile_cont({0}, 0.25), 4) AS q1, round(quantile_cont({0}, 0.5), 4) AS median, round(quantile_cont({0}, 0.75), 4) AS q3,
            max({0}) AS "max", round(avg({0}), 4) AS mean, round(stddev_samp({0}), 4) AS std"""
query("e06_numeric_stats", lambda t: rounded(profile.numeric_stats(t("lineitem"), "l_extendedprice"), 4), f"SELECT {_STATS.format('l_extendedprice')} FROM lineitem")
query("e06_numeric_stats_by_group", lambda t: rounded(profile.numeric_stats(t("events"), "value", "event_type"), 4), f"SELECT event_type, {_STATS.format('value')} FROM events GROUP BY event_type")
query("e07_sign_counts", lambda t: profile.sign_counts(m.with_formula(t("customer"), "balance", "c_acctbal - 1000"), "balance"),
      "SELECT count(*) FILTER (c_acctbal > 1000) AS positive, count(*) FILTER (c_acctbal = 1000) AS zero, count(*) FILTER (c_acctbal < 1000) AS negative FROM customer")


def _classes(t: Tables) -> DataFrame:
    table = m.with_formula(m.with_formula(t("orders"), "one", "1"), "void", "cast(NULL as double)")
    found = profile.semantic_classes(table)
    return t.spark.createDataFrame(list(found.items()), "column string, class string")


query("e08_semantic_class", _classes, """SELECT * FROM (VALUES ('o_orderkey', 'numeric'), ('o_custkey', 'numeric'), ('o_orderstatus', 'cat10'), ('o_totalprice', 'numeric'),
      ('o_orderdate', 'datetime'), ('o_orderpriority', 'cat10'), ('one', 'constant'), ('void', 'only_nans')) v("column", class)""")
query("e08_semantic_class_id", lambda t: t.spark.createDataFrame(list(profile.semantic_classes(t("customer")).items()), "column string, class string"),
      """SELECT 'c_name' AS "column", CASE WHEN count(DISTINCT c_name) = count(c_name) THEN 'id' ELSE 'cat300' END AS class FROM customer
         UNION ALL SELECT 'c_mktsegment', CASE WHEN count(DISTINCT c_mktsegment) <= 2 THEN 'cat2' WHEN count(DISTINCT c_mktsegment) <= 20 THEN 'cat10' END FROM customer
         UNION ALL SELECT unnest(['c_custkey', 'c_nationkey', 'c_acctbal']), 'numeric'""")
_HIST = """WITH r AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), b AS (SELECT least(floor((l_quantity - lo) / 2.5), 19) AS bin FROM lineitem, r), g AS (SELECT unnest(range(20)) AS bin)"""
query("e09_histogram", lambda t: profile.histogram(t("lineitem"), "l_quantity"),
      f"""{_HIST} SELECT CAST(g.bin AS INTEGER) AS bin, lo + g.bin * 2.5 AS bin_start, lo + g.bin * 2.5 + 2.5 AS bin_end, (SELECT count(*) FROM b WHERE b.bin = g.bin) AS "count" FROM g, r""")
query("e09_histogram_range", lambda t: profile.histogram(t("lineitem"), "l_extendedprice", lo=10000, hi=60000, bins=10),
      """SELECT CAST(b AS INTEGER) AS bin, CAST(10000 + b * 5000 AS DOUBLE) AS bin_start, CAST(15000 + b * 5000 AS DOUBLE) AS bin_end,
                (SELECT count(*) FROM lineitem WHERE l_extendedprice BETWEEN 10000 AND 60000 AND least(floor((l_extendedprice - 10000) / 5000), 9) = b) AS "count" FROM range(10) r(b)""")
query("e10_fd_bins", lambda t: profile.fd_bins(t("lineitem"), "l_extendedprice"),
      """SELECT CAST(ceil((max(l_extendedprice) - min(l_extendedprice)) / (2 * (quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)) / pow(count(*), 1.0 / 3.0))) AS INTEGER) AS bins FROM lineitem""")
query("e11_time_distribution", lambda t: profile.time_distribution(t("events"), "ts"), """SELECT date_trunc('day', ts) AS ts, count(*) AS "count" FROM events GROUP BY 1""")
query("e11_time_span", lambda t: rounded(profile.time_span(t("events"), "ts"), 3), """SELECT min(ts) AS "first", max(ts) AS "last", round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0, 3) AS span_seconds FROM events""")


def _default(t: Tables) -> DataFrame:
    rows = [(name, profile.default_frequency(t(name), ts), profile.expected_points(t(name), ts, 2, "D")) for name, ts in (("events", "ts"), ("orders", "o_orderdate"))]
    return t.spark.createDataFrame(rows, "source string, unit string, points_of_two_days long")


query("e12_default_frequency", _default,
      """SELECT 'events' AS source, 'D' AS unit, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / 172800) AS BIGINT) AS points_of_two_days FROM events
         UNION ALL SELECT 'orders', 'MS', CAST(floor((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 1e6 / 172800) AS BIGINT) FROM orders""")
query("e13_over_time", lambda t: rounded(profile.over_time(t("events"), "ts", "value", ["mean", "median", "max", "std"], 2, "D"), 4),
      """SELECT date_trunc('day', (SELECT min(ts) FROM events)) + INTERVAL 2 DAY * CAST(date_diff('day', (SELECT min(ts) FROM events), ts) // 2 AS INTEGER) AS ts, round(avg(value), 4) AS value_mean,
                round(quantile_cont(value, 0.5), 4) AS value_median, max(value) AS value_max, round(stddev_samp(value), 4) AS value_std FROM events GROUP BY 1""")
query("e13_over_time_category", lambda t: profile.over_time(t("orders"), "o_orderdate", "o_orderpriority", ["size", "nunique"], 1, "QS"),
      "SELECT CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS o_orderdate, count(*) AS o_orderpriority_size, count(DISTINCT o_orderpriority) AS o_orderpriority_nunique FROM orders GROUP BY 1")

# --- two columns ---------------------------------------------------------------------------------

_CELLS = """WITH r AS (SELECT min(l_quantity) AS xl, max(l_quantity) AS xh, min(l_extendedprice) AS yl, max(l_extendedprice) AS yh FROM lineitem),
  b AS (SELECT least(floor((l_quantity - xl) / ((xh - xl) / 10)), 9) AS i, least(floor((l_extendedprice - yl) / ((yh - yl) / 10)), 9) AS j FROM lineitem, r),
  c AS (SELECT i, j, count(*) AS n FROM b GROUP BY i, j), g AS (SELECT a.x, d.y FROM range(10) a(x), range(10) d(y)),
  f AS (SELECT CAST(x AS INTEGER) AS x_bin, CAST(y AS INTEGER) AS y_bin, coalesce(n, 0) AS n FROM g LEFT JOIN c ON x = i AND y = j)"""
_MARGINS = """x_bin, y_bin, n AS "count", CAST(sum(n) OVER (PARTITION BY x_bin) AS BIGINT) AS x_count, CAST(sum(n) OVER (PARTITION BY y_bin) AS BIGINT) AS y_count"""
query("e14_density_2d", lambda t: profile.density_2d(t("lineitem"), "l_quantity", "l_extendedprice").drop("x_range", "y_range"), f"{_CELLS} SELECT {_MARGINS} FROM f")
query("e15_predictive_density", lambda t: rounded(profile.density_2d(t("lineitem"), "l_quantity", "l_extendedprice", normalize="x").drop("x_range", "y_range")),
      f"{_CELLS} SELECT {_MARGINS}, round(n / sum(n) OVER (PARTITION BY x_bin), 6) AS share FROM f")
query("e16_bin_category_table", lambda t: rounded(profile.bin_category_table(t("orders"), "o_totalprice", "o_orderstatus", 6)).drop("range"),
      """WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), b AS (SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 6)), 5) AS INTEGER) AS bin, o_orderstatus FROM orders, r)
         SELECT bin, o_orderstatus AS category, count(*) AS "count", CAST(sum(count(*)) OVER (PARTITION BY bin) AS BIGINT) AS bin_count, round(count(*) / sum(count(*)) OVER (PARTITION BY bin), 6) AS share FROM b GROUP BY bin, o_orderstatus""")
query("e17_histogram_by_class", lambda t: profile.histogram(t("lineitem"), "l_quantity", by="l_returnflag"),
      f"""{_HIST} SELECT c.l_returnflag AS class, CAST(g.bin AS INTEGER) AS bin, lo + g.bin * 2.5 AS bin_start, lo + g.bin * 2.5 + 2.5 AS bin_end, count(x.bin) AS "count"
          FROM (SELECT DISTINCT l_returnflag FROM lineitem) c, g, r LEFT JOIN (SELECT l_returnflag, least(floor((l_quantity - lo) / 2.5), 19) AS bin FROM lineitem, r) x ON x.bin = g.bin AND x.l_returnflag = c.l_returnflag
          GROUP BY ALL""")


def _box_sql(group: str, total: str) -> str:
    keyed = f"GROUP BY {group}" if group else ""
    name = group or "CAST(NULL AS VARCHAR)"
    return f"""(WITH q AS (SELECT {name} AS category, {_STATS.format('o_totalprice')}, quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders {keyed}),
        w AS (SELECT q.category, min(o_totalprice) FILTER (o_totalprice BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS lower_whisker, max(o_totalprice) FILTER (o_totalprice BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS upper_whisker,
              count(*) FILTER (o_totalprice NOT BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS outliers FROM orders o JOIN q ON {f'o.{group} = q.category' if group else 'true'} GROUP BY q.category)
        SELECT q.* EXCLUDE (a, b), {total} AS is_total, w.lower_whisker, w.upper_whisker, w.outliers FROM q JOIN w ON q.category IS NOT DISTINCT FROM w.category)"""


query("e18_box_stats", lambda t: rounded(profile.box_stats(t("orders"), "o_totalprice", "o_orderpriority"), 4),
      _box_sql("o_orderpriority", "false") + " UNION ALL BY NAME " + _box_sql("", "true"))
query("e19_crosstab", lambda t: rounded(profile.crosstab(t("documents"), "source", "lang", normalize="x", zeros=True)),
      """SELECT a.source AS x, b.lang AS y, count(d.doc_id) AS "count", round(count(d.doc_id) / sum(count(d.doc_id)) OVER (PARTITION BY a.source), 6) AS share
         FROM (SELECT DISTINCT source FROM documents) a CROSS JOIN (SELECT DISTINCT lang FROM documents) b LEFT JOIN documents d ON d.source = a.source AND d.lang = b.lang GROUP BY a.source, b.lang""")
query("e19_crosstab_counts", lambda t: profile.crosstab(t("orders"), "o_orderstatus", "o_orderpriority"),
      """SELECT o_orderstatus AS x, o_orderpriority AS y, count(*) AS "count" FROM orders GROUP BY ALL""")
query("e19_crosstab_sparse", lambda t: rounded(profile.crosstab(t("lineitem"), "l_partkey", "l_suppkey", normalize="y")),
      """SELECT l_partkey AS x, l_suppkey AS y, count(*) AS "count", round(count(*) / sum(count(*)) OVER (PARTITION BY l_suppkey), 6) AS share FROM lineitem GROUP BY l_partkey, l_suppkey""")
query("e19_crosstab_others", lambda t: rounded(profile.crosstab(t("orders"), "o_custkey", "o_orderpriority", normalize="all", top_x=7, top_y=3)),
      """WITH a AS (SELECT o_custkey AS k FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 7), b AS (SELECT o_orderpriority AS k FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)
         SELECT a.k AS x, a.k IS NULL AS x_other, b.k AS y, b.k IS NULL AS y_other, count(*) AS "count", round(count(*) / sum(count(*)) OVER (), 6) AS share
         FROM orders LEFT JOIN a ON o_custkey = a.k LEFT JOIN b ON o_orderpriority = b.k GROUP BY a.k, b.k""")
query("e20_unique_table", lambda t: profile.unique_table(t("lineitem"), "l_suppkey", "l_partkey"),
      """SELECT l_suppkey AS x, count(*) AS "count", count(DISTINCT l_partkey) AS unique_count FROM lineitem GROUP BY l_suppkey""")
query("e20_drill", lambda t: relate.drill(t("lineitem"), "l_suppkey", 7), "SELECT * FROM lineitem WHERE l_suppkey = 7")
query("e20_unique_table_binned", lambda t: profile.unique_table(t("orders"), "o_totalprice", "o_custkey", bins=4).select("count", "unique_count"),
      """WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT count(*) AS "count", count(DISTINCT o_custkey) AS unique_count FROM orders, r GROUP BY least(floor((o_totalprice - lo) / ((hi - lo) / 4)), 3)""")
query("e21_relate_categories", lambda t: rounded(relate.relate(t("orders"), "o_orderstatus", "o_orderpriority")["counts"]),
      """SELECT o_orderstatus AS x, o_orderpriority AS y, count(*) AS "count", round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 6) AS share FROM orders GROUP BY o_orderstatus, o_orderpriority""")
query("e21_relate_id", lambda t: relate.relate(t("customer"), "c_name", "c_mktsegment")["unique"],
      """SELECT c_name AS x, count(*) AS "count", count(DISTINCT c_mktsegment) AS unique_count FROM customer GROUP BY c_name""")
query("e21_relate_left_out", lambda t: relate.relate(t("events"), "props", "event_type")["left_out"],
      """SELECT 'props' AS "column", count(*) - 20 AS categories, CAST(sum(n) - (SELECT sum(n) FROM (SELECT count(*) AS n FROM events GROUP BY props ORDER BY n DESC, props LIMIT 20)) AS BIGINT) AS "rows"
         FROM (SELECT props, count(*) AS n FROM events GROUP BY props)""")
query("e21_relate_time_and_number", lambda t: rounded(relate.relate(t("events"), "ts", "value")["over_time"]),
      "SELECT date_trunc('day', ts) AS ts, round(avg(value), 6) AS value_mean FROM events GROUP BY 1")
query("e21_relate_many_categories", lambda t: relate.relate(t("events"), "props", "event_type")["unique"],
      """SELECT props AS x, count(*) AS "count", count(DISTINCT event_type) AS unique_count FROM events
         WHERE props IN (SELECT props FROM events GROUP BY props ORDER BY count(*) DESC, props LIMIT 20) GROUP BY props""")
query("e22_scatter_rows", lambda t: m.sample_rows(t("lineitem").select("l_quantity", "l_extendedprice"), 5000).agg(F.count(F.lit(1)).alias("n"), (F.min("l_quantity") >= 1).alias("plausible")),
      "SELECT least(5000, count(*)) AS n, true AS plausible FROM lineitem")
_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
query("e23_correlations", lambda t: rounded(profile.correlations(t("lineitem"), list(_NUMBERS))),
      " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS correlation FROM lineitem" for a in _NUMBERS for b in _NUMBERS))
query("e23_correlations_missing", lambda t: rounded(profile.correlations(labelled(t), ["n_chars", "quality", "toxic"])),
      " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS correlation FROM {_LABELLED}" for a in ("n_chars", "quality", "toxic") for b in ("n_chars", "quality", "toxic")))
_WIDE = range(40)
query("e23_correlations_wide", lambda t: rounded(profile.correlations(t("embeddings").select(*[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in _WIDE], F.col("label").alias("e40")))),
      """WITH v AS (SELECT vec_id, 'e' || i AS name, CASE WHEN i < 40 THEN CAST(embedding[i + 1] AS DOUBLE) ELSE label END AS v FROM embeddings, range(41) r(i))
         SELECT a.name AS x, b.name AS y, round(corr(a.v, b.v), 6) AS correlation FROM v a JOIN v b USING (vec_id) GROUP BY ALL""")
query("e26_overview", lambda t: rounded(relate.overview(t("orders"))["columns"]),
      _facts("orders", {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp", "o_orderpriority": "string"}, valid=True))
query("e26_overview_patterns", lambda t: compared_scores(relate.overview(t("orders"), fold_by=["o_orderkey"])["patterns"]), power_matrix_sql("orders", ORDER_KINDS, ["o_orderkey"]))
query("e26_overview_glimpse", lambda t: rounded(relate.overview(t("orders"))["glimpse"]), _facts("orders", {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp", "o_orderpriority": "string"}))
query("e27_over_all_times", lambda t: rounded(profile.over_all_times(m.join(t("lineitem"), t("orders"), on=[("l_orderkey", "o_orderkey")]), "l_quantity", ["sum"])["o_orderdate"], 2),
      "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS o_orderdate, round(sum(l_quantity), 2) AS l_quantity_sum FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")

# --- chart data ----------------------------------------------------------------------------------

_QBIN = "(SELECT min(l_quantity) FROM lineitem) + 2.5 * least(floor((l_quantity - (SELECT min(l_quantity) FROM lineitem)) / 2.5), 19)"
query("h01_histogram", lambda t: rounded(chart.histogram_chart(t("lineitem"), "l_quantity", norm="percent", groups=["l_returnflag"]), 4),
      f"SELECT l_returnflag, {_QBIN} AS x, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY l_returnflag), 4) AS value FROM lineitem GROUP BY 1, 2")
query("h01_histogram_average", lambda t: rounded(chart.histogram_chart(t("lineitem"), "l_quantity", "l_extendedprice", fn="avg"), 4),
      f"SELECT {_QBIN} AS x, round(avg(l_extendedprice), 4) AS value FROM lineitem GROUP BY 1")
query("h01_histogram_cumulative_density", lambda t: rounded(chart.histogram_chart(t("lineitem"), "l_quantity", norm="probability density", cumulative=True), 6),
      f"SELECT x, round(sum(n / 2.5 / total) OVER (ORDER BY x), 6) AS value FROM (SELECT {_QBIN} AS x, count(*) AS n, sum(count(*)) OVER () AS total FROM lineitem GROUP BY 1)")
query("h01_histogram_of_categories", lambda t: rounded(chart.histogram_chart(t("orders"), "o_orderpriority", "o_totalprice", fn="sum", norm="probability", groups=["o_orderstatus"])),
      "SELECT o_orderstatus, o_orderpriority AS x, round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER (PARTITION BY o_orderstatus), 6) AS value FROM orders GROUP BY 1, 2")
query("h02_bar", lambda t: rounded(chart.bar_chart(m.group_agg(t("orders"), ["o_orderstatus", "o_orderpriority"], {"n": (None, "size")}), "o_orderstatus", "n", ["o_orderpriority"], norm="percent")),
      "SELECT o_orderstatus, count(*) AS n, o_orderpriority, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY o_orderstatus), 6) AS share FROM orders GROUP BY o_orderstatus, o_orderpriority")
query("h03_line", lambda t: chart.line_chart(t("events"), "ts", "value", ["event_type"]), "SELECT ts, value, event_type FROM events")
query("h04_scatter_trendline", lambda t: rounded(chart.trendline(t("lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]), 4),
      """SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 4) AS r2, count(*) AS "count" FROM lineitem GROUP BY 1""")
query("h04_scatter_points", lambda t: chart.scatter_chart(t("lineitem"), ["l_quantity", "l_extendedprice"], 2000).agg(F.count(F.lit(1)).alias("n")), "SELECT least(2000, count(*)) AS n FROM lineitem")
query("h05_pie", lambda t: rounded(chart.pie_chart(t("orders"), "o_orderpriority", "o_totalprice"), 4),
      "SELECT o_orderpriority AS label, round(sum(o_totalprice), 4) AS value, round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER (), 4) AS share FROM orders GROUP BY 1")
query("h06_box", lambda t: rounded(chart.box_chart(t("orders"), "o_totalprice", "o_orderpriority"), 4), _box_sql("o_orderpriority", "false"))
query("h07_violin", lambda t: rounded(chart.violin_chart(t("lineitem"), "l_quantity", "l_returnflag")["density"]),
      f"""{_HIST} SELECT c.l_returnflag AS class, CAST(g.bin AS INTEGER) AS bin, lo + g.bin * 2.5 AS bin_start, lo + g.bin * 2.5 + 2.5 AS bin_end, count(x.bin) AS "count",
              round(count(x.bin) / (sum(count(x.bin)) OVER (PARTITION BY c.l_returnflag) * 2.5), 6) AS density
          FROM (SELECT DISTINCT l_returnflag FROM lineitem) c, g, r LEFT JOIN (SELECT l_returnflag, least(floor((l_quantity - lo) / 2.5), 19) AS bin FROM lineitem, r) x ON x.bin = g.bin AND x.l_returnflag = c.l_returnflag
          GROUP BY c.l_returnflag, g.bin, lo""")
query("h04_scatter_by_key", lambda t: chart.scatter_chart(t("lineitem"), ["l_quantity", "l_extendedprice"], 2000, by=["l_orderkey", "l_linenumber"]),
      """SELECT l_quantity, l_extendedprice FROM lineitem
         ORDER BY md5('123' || chr(31) || CAST(l_orderkey AS VARCHAR) || chr(31) || CAST(l_linenumber AS VARCHAR)), l_orderkey, l_linenumber LIMIT 2000""")
query("e22_relate_scatter_by_key", lambda t: relate.relate(t("orders"), "o_custkey", "o_totalprice", by=["o_orderkey"])["scatter"],
      "SELECT o_custkey, o_totalprice FROM orders ORDER BY md5('123' || chr(31) || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 10000")
query("h08_strip", lambda t: chart.scatter_chart(labelled(t), ["lang", "quality"], 10**6), f"SELECT lang, quality FROM {_LABELLED} WHERE quality IS NOT NULL")
query("h09_density_heatmap", lambda t: rounded(chart.density_chart(t("lineitem"), "l_quantity", "l_extendedprice", "l_discount", fn="avg").select("x_bin", "y_bin", "value")),
      _CELLS.split("b AS (")[0] + """b AS (SELECT CAST(least(floor((l_quantity - xl) / ((xh - xl) / 10)), 9) AS INTEGER) AS x_bin, CAST(least(floor((l_extendedprice - yl) / ((yh - yl) / 10)), 9) AS INTEGER) AS y_bin, l_discount FROM lineitem, r)
      SELECT x_bin, y_bin, round(avg(l_discount), 6) AS value FROM b GROUP BY x_bin, y_bin""")
query("h10_density_contour", lambda t: chart.density_chart(t("lineitem"), "l_quantity", "l_extendedprice").select("x_bin", "y_bin", "value"),
      f"{_CELLS} SELECT x_bin, y_bin, n AS value FROM f WHERE n > 0")
query("h11_area", lambda t: rounded(chart.area_chart(m.resample(t("events"), "ts", 1, "D", "size", by="event_type"), "ts", "count", ["event_type"], norm="fraction")),
      """SELECT date_trunc('day', ts) AS ts, count(*) AS "count", event_type, round(count(*) / sum(count(*)) OVER (PARTITION BY date_trunc('day', ts)), 6) AS share FROM events GROUP BY 1, event_type""")
query("h12_scatter_3d", lambda t: chart.scatter_chart(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], 3000).agg(F.count(F.lit(1)).alias("n")), "SELECT least(3000, count(*)) AS n FROM lineitem")
query("h13_line_3d", lambda t: chart.line_chart(t("orders"), "o_orderdate", ["o_totalprice", "o_custkey"]), "SELECT o_orderdate, o_totalprice, o_custkey FROM orders")
query("h14_scatter_matrix", lambda t: chart.scatter_chart(labelled(t), ["n_chars", "quality", "toxic"], 10**6), f"SELECT n_chars, quality, toxic FROM {_LABELLED} WHERE quality IS NOT NULL AND toxic IS NOT NULL")
query("h15_parallel_coordinates", lambda t: chart.scatter_chart(t("part"), ["p_size", "p_retailprice"], 10**6), "SELECT p_size, p_retailprice FROM part")
query("h16_parallel_categories", lambda t: chart.path_counts(t("lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"]),
      """SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS "count" FROM lineitem GROUP BY ALL""")
query("h17_candlestick", lambda t: chart.candlestick_chart(t("events"), "ts", "value", 1, "W", order_by=["event_id"]),
      """SELECT CAST(date_trunc('week', ts) + INTERVAL 6 DAY AS TIMESTAMP) AS ts, arg_min(value, (ts, event_id)) AS "open", max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS "close" FROM events GROUP BY 1""")
query("h18_treemap_rollup", lambda t: rounded(chart.treemap_chart(t("orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice"), 2),
      """SELECT o_orderstatus, o_orderpriority, 2 AS level, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2 UNION ALL SELECT o_orderstatus, NULL, 1, round(sum(o_totalprice), 2) FROM orders GROUP BY 1""")
query("h18_treemap_remainder", lambda t: chart.treemap_chart(t("lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], mode="remainder"),
      """SELECT l_returnflag, l_linestatus, l_linenumber, 3 AS level, count(*) AS value FROM lineitem GROUP BY 1, 2, 3
         UNION ALL SELECT DISTINCT l_returnflag, l_linestatus, CAST(NULL AS INTEGER), 2, 0 FROM lineitem UNION ALL SELECT DISTINCT l_returnflag, NULL, NULL, 1, 0 FROM lineitem""")

# --- custom functions and recipes ----------------------------------------------------------------


def _digit_sums(t: Tables) -> DataFrame:
    # a local function travels to the executors by value, so they need no copy of this package
    def digit_sum(key: int, line: int) -> int:
        return sum(int(d) for d in str(key)) + line

    lines = t("lineitem").select("l_orderkey", "l_linenumber")
    return m.with_udf(lines, "digits", digit_sum, ["l_orderkey", "l_linenumber"], "long")


query("z01_python_function", _digit_sums,
      "SELECT l_orderkey, l_linenumber, CAST(list_sum(list_transform(string_split(CAST(l_orderkey AS VARCHAR), ''), lambda d: CAST(d AS BIGINT))) AS BIGINT) + l_linenumber AS digits FROM lineitem")


@register_op("net price")
def net_price(df: DataFrame, into: str = "net") -> DataFrame:
    return m.with_formula(df, into, "round(l_extendedprice * (1 - l_discount), 4)")


@m.register_source("line items of a folder")
def _line_items(spark, folder: str) -> DataFrame:
    return Tables(spark, folder)("lineitem")


query("z02_registered_operator", lambda t: t("lineitem").select("l_orderkey", "l_extendedprice", "l_discount").transform(registered_op("net price")),
      "SELECT l_orderkey, l_extendedprice, l_discount, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
ranged_source("line items by ranges", "l_orderkey bigint, l_linenumber int, l_extendedprice double, l_returnflag string", parquet_ranges, read_parquet_range)


def _by_ranges(t: Tables) -> DataFrame:
    return m.load("line items by ranges", t.spark, path=f"{t.folder}/lineitem.parquet", columns="l_orderkey,l_linenumber,l_extendedprice,l_returnflag", bytes_per_range=1 << 20)


query("z03_ranged_source", _by_ranges, "SELECT l_orderkey, l_linenumber, l_extendedprice, l_returnflag FROM lineitem")
query("z03_registered_source", lambda t: m.load("line items of a folder", t.spark, folder=t.folder).select("l_orderkey", "l_tax"), "SELECT l_orderkey, l_tax FROM lineitem")


def price_recipe() -> Recipe:
    return (
        Recipe()
        .add(m.filter_rows, [m.cmp("l_quantity", ">", 10)], text="Keep larger quantities")
        .add("net price")
        .add(m.group_agg, ["l_returnflag"], {"net": ("net", "sum"), "n": (None, "size")})
    )


query("z04_recipe", lambda t: rounded(price_recipe().run(t("lineitem")), 2),
      "SELECT l_returnflag, round(sum(round(l_extendedprice * (1 - l_discount), 4)), 2) AS net, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY 1")
query("z05_recipe_undo_redo", lambda t: rounded(price_recipe().undo().undo().redo().run(t("lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount")), 4),
      "SELECT l_orderkey, l_quantity, round(l_extendedprice, 4) AS l_extendedprice, l_discount, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_quantity > 10")
