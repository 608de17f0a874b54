"""Aggregation, pivot tables, running calculations, sorting and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

import millrace as m
from millrace.queries.registry import Tables, query, rounded
from millrace.queries.tables import _LABELLED, labelled

# --- flagship ------------------------------------------------------------------------------------


def pricing_summary(t: Tables) -> DataFrame:
    lines = m.filter_rows(t("lineitem"), m.cmp("l_shipdate", "<=", "2000-09-02"))
    lines = m.with_formula(lines, "revenue", "l_extendedprice * (1 - l_discount)")
    lines = m.with_formula(lines, "charge", "revenue * (1 + l_tax)")
    summary = m.group_agg(lines, ["l_returnflag", "l_linestatus"], {
        "sum_qty": ("l_quantity", "sum"), "sum_base_price": ("l_extendedprice", "sum"), "sum_revenue": ("revenue", "sum"),
        "sum_charge": ("charge", "sum"), "avg_qty": ("l_quantity", "mean"), "avg_price": ("l_extendedprice", "mean"),
        "avg_discount": ("l_discount", "mean"), "count_order": (None, "size"),
    })
    return rounded(m.sort_rows(summary, ["l_returnflag", "l_linestatus"]), 2)


query("flagship_pricing_summary", pricing_summary,
      """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
                round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_revenue, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
                round(avg(l_quantity), 2) AS avg_qty, round(avg(l_extendedprice), 2) AS avg_price, round(avg(l_discount), 2) AS avg_discount, count(*) AS count_order
         FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL ORDER BY 1, 2""")

# --- group-by ------------------------------------------------------------------------------------

query("a01_many_functions", lambda t: rounded(m.group_agg(t("lineitem"), ["l_returnflag"], [(["sum", "mean", "max"], m.of_type("float")), (["nunique"], ["l_suppkey"])]), 3),
      """SELECT l_returnflag, """ + ", ".join(
          f"round({fn}({c}), 3) AS {c}_{out}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax") for fn, out in (("sum", "sum"), ("avg", "mean"), ("max", "max"))
      ) + ", count(DISTINCT l_suppkey) AS l_suppkey_nunique FROM lineitem GROUP BY l_returnflag")
query("a02_named_outputs", lambda t: rounded(m.group_agg(t("orders"), ["o_orderstatus", "o_orderpriority"], {"orders": (None, "size"), "average": ("o_totalprice", "mean"), "": ("o_totalprice", "min")})),
      "SELECT o_orderstatus, o_orderpriority, count(*) AS orders, round(avg(o_totalprice), 6) AS average, round(min(o_totalprice), 6) AS o_totalprice_min FROM orders GROUP BY ALL")
query("a03_as_columns", lambda t: rounded(m.group_agg(t("orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", {"mean_price": ("o_totalprice", "mean"), "n": (None, "size")}, as_columns=True)),
      "SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS o_totalprice, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS mean_price, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
query("a03_as_columns_drops_missing_keys", lambda t: m.group_agg(labelled(t), "quality", {"sources": ("source", "nunique")}, as_columns=True),
      f"SELECT d.*, s.sources FROM {_LABELLED} d JOIN (SELECT quality, count(DISTINCT source) AS sources FROM {_LABELLED} GROUP BY quality) s ON d.quality = s.quality")
query("a04_repeated_pairs", lambda t: m.group_agg(t("orders"), "o_orderstatus", [(["min", "max"], ["o_totalprice"]), (["max", "min", "count"], ["o_totalprice"])]),
      "SELECT o_orderstatus, min(o_totalprice) AS o_totalprice_min, max(o_totalprice) AS o_totalprice_max, count(o_totalprice) AS o_totalprice_count FROM orders GROUP BY o_orderstatus")


def by_source(fn: str, column: str = "quality", **options):
    return lambda t: rounded(m.group_agg(labelled(t), ["source"], {"value": (column, fn)}, **options))


def per_source(expression: str) -> str:
    return f"SELECT source, {expression} AS value FROM {_LABELLED} GROUP BY source"


query("a05_size", by_source("size"), per_source("count(*)"))
query("a06_count", by_source("count"), per_source("count(quality)"))
query("a07_sum", by_source("sum"), per_source("CAST(coalesce(sum(quality), 0) AS BIGINT)"))
query("a08_mean", by_source("mean", "n_chars"), per_source("round(avg(n_chars), 6)"))
query("a09_median", by_source("median", "n_chars"), per_source("round(quantile_cont(CAST(n_chars AS DOUBLE), 0.5), 6)"))
query("a09_median_price_by_flag", lambda t: rounded(m.group_agg(t("lineitem"), ["l_returnflag", "l_linestatus"], {"median_price": ("l_extendedprice", "median"), "median_qty": ("l_quantity", "median")}), 4),
      "SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.5), 4) AS median_price, round(quantile_cont(l_quantity, 0.5), 4) AS median_qty FROM lineitem GROUP BY ALL")
query("a10_min", by_source("min", "n_chars"), per_source("min(n_chars)"))
query("a11_max", by_source("max", "lang"), per_source("max(lang)"))
query("a12_first", by_source("first", "quality", order_by=["doc_id"]), per_source("arg_min(quality, doc_id) FILTER (quality IS NOT NULL)"))
query("a13_last", by_source("last", "quality", order_by=["n_chars", "doc_id"]), per_source("arg_max(quality, (n_chars, doc_id)) FILTER (quality IS NOT NULL)"))
query("a14_nunique", by_source("nunique", "lang"), per_source("count(DISTINCT lang)"))
query("a15_std", by_source("std", "n_chars"), per_source("round(stddev_samp(n_chars), 6)"))
query("a16_var", by_source("var", "quality"), per_source("round(var_samp(quality), 6)"))
query("a17_sem", by_source("sem", "n_chars"), per_source("round(stddev_samp(n_chars) / sqrt(count(n_chars)), 6)"))
query("a18_mad", lambda t: rounded(m.group_agg(t("orders"), ["o_orderpriority"], {"mad": ("o_totalprice", "mad"), "mean": ("o_totalprice", "mean")}), 4),
      """SELECT o_orderpriority, round(avg(abs(o_totalprice - mu)), 4) AS mad, round(any_value(mu), 4) AS mean
         FROM (SELECT *, avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS mu FROM orders) GROUP BY o_orderpriority""")
query("a19_skew", lambda t: rounded(m.group_agg(t("events"), ["event_type"], {"skew": ("value", "skew")})),
      "SELECT event_type, round(skewness(value), 6) AS skew FROM events GROUP BY event_type")
query("a20_ngroup", lambda t: m.group_agg(t("orders"), ["o_orderstatus", "o_orderpriority"], {"n": (None, "size"), "group_number": (None, "ngroup")}),
      "SELECT o_orderstatus, o_orderpriority, count(*) AS n, row_number() OVER (ORDER BY o_orderstatus, o_orderpriority) - 1 AS group_number FROM orders GROUP BY o_orderstatus, o_orderpriority")
query("a21_all", by_source("all"), per_source("coalesce(bool_and(quality <> 0), true)"))
query("a22_any", by_source("any", "toxic"), per_source("coalesce(bool_or(toxic <> 0), false)"))
query("a23_idxmax", lambda t: m.group_agg(t("lineitem"), ["l_returnflag", "l_linestatus"], {"row": ("l_quantity", "idxmax")}, order_by=["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], label="l_orderkey"),
      """SELECT l_returnflag, l_linestatus, l_orderkey AS "row" FROM lineitem
         QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_quantity DESC, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) = 1""")
query("a24_idxmin", lambda t: m.group_agg(t("documents"), ["source"], {"row": ("n_chars", "idxmin")}, order_by=["doc_id"], label="doc_id"),
      """SELECT source, doc_id AS "row" FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) = 1""")
query("a25_prod", lambda t: rounded(m.group_agg(m.with_formula(t("orders"), "factor", "1 + o_totalprice / 1e7"), ["o_custkey"], {"value": ("factor", "prod")})),
      "SELECT o_custkey, round(product(1 + o_totalprice / 1e7), 6) AS value FROM orders GROUP BY o_custkey")
query("a14_nunique_sketch", lambda t: m.group_agg(t("orders"), [], {"customers": ("o_custkey", "nunique")}, accuracy=50).select((F.col("customers") > 0).alias("found")),
      "SELECT count(DISTINCT o_custkey) > 0 AS found FROM orders")

# --- pivot tables --------------------------------------------------------------------------------

_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _cells(expression: str, fill: str = "NULL") -> str:
    return ", ".join(f"""coalesce({expression.replace('@', f"FILTER (o_orderpriority = '{p}')")}, {fill}) AS "{p}" """ for p in _PRIORITIES)


query("a26_pivot_table", lambda t: rounded(m.pivot_table(t("orders"), "o_orderstatus", "o_orderpriority", "o_totalprice", "mean")),
      f"SELECT o_orderstatus, {_cells('round(avg(o_totalprice) @, 6)')} FROM orders GROUP BY o_orderstatus")
query("a26_pivot_table_median", lambda t: rounded(m.pivot_table(t("orders"), "o_orderstatus", "o_orderpriority", "o_totalprice", "median"), 4),
      f"SELECT o_orderstatus, {_cells('round(quantile_cont(o_totalprice, 0.5) @, 4)')} FROM orders GROUP BY o_orderstatus")
query("a26_pivot_table_two_columns", lambda t: m.pivot_table(t("lineitem"), "l_linenumber", ["l_returnflag", "l_linestatus"], "l_quantity", "count"),
      "SELECT l_linenumber, " + ", ".join(f"""nullif(count(l_quantity) FILTER (l_returnflag = '{r}' AND l_linestatus = '{s}'), 0) AS "{r}_{s}" """ for r in "ANR" for s in "FO") + " FROM lineitem GROUP BY l_linenumber")
# headings of types whose text differs between Python and Spark
for _name, _formula, _sql_head, _heads in (
    ("boolean", "l_quantity > 25", "l_quantity > 25", {"true": "true", "false": "false"}),
    ("double", "l_linenumber * 10000000.0D", "l_linenumber * 10000000.0", {f"{k}.0E7": f"{k}0000000.0" for k in range(1, 8)}),
    ("timestamp", "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, l_linenumber / 2.0)", "TIMESTAMP '2024-01-01 00:00:00' + to_milliseconds(CAST(l_linenumber * 500 AS BIGINT))",
     {f"2024-01-01 00:00:0{k // 2}" + (".5" if k % 2 else ""): f"TIMESTAMP '2024-01-01 00:00:0{k / 2}'" for k in range(1, 8)}),
):
    for _margins in (False, True):
        _cell = ", ".join(f'nullif(sum(l_quantity) FILTER (head = {v}), NULL) AS "{h}"' for h, v in _heads.items())
        _all = ', sum(l_quantity) AS "All"' if _margins else ""
        query(f"a26_pivot_table_{_name}" + ("_margins" if _margins else ""),
              lambda t, f=_formula, g=_margins: m.pivot_table(m.with_formula(t("lineitem"), "head", f), "l_returnflag", "head", "l_quantity", "sum", margins=g),
              f"WITH t AS (SELECT *, {_sql_head} AS head FROM lineitem) SELECT l_returnflag, {_cell}{_all} FROM t GROUP BY l_returnflag"
              + (f" UNION ALL SELECT 'All', {_cell}{_all} FROM t" if _margins else ""))


def _sketched_medians(t: Tables) -> DataFrame:
    """Whether the sketched median of each cell and margin lies within one hundredth of the middle of its rows."""
    wide = m.pivot_table(t("orders"), "o_orderstatus", "o_orderpriority", "o_totalprice", "median", margins=True, accuracy=200)
    cells = wide.unpivot(["o_orderstatus"], [c for c in wide.columns if c != "o_orderstatus"], "o_orderpriority", "median")
    either = [F.explode(F.array(F.col(c), F.lit("All"))).alias(c) for c in ("o_orderstatus", "o_orderpriority")]
    rows = t("orders").select("o_totalprice", either[0], "o_orderpriority").select("o_totalprice", "o_orderstatus", either[1])
    x, median = F.col("o_totalprice"), F.col("median")
    counted = rows.join(cells, ["o_orderstatus", "o_orderpriority"]).groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(x < median).alias("under"), F.count_if(x <= median).alias("upto")
    )
    return counted.select("o_orderstatus", "o_orderpriority", "n", ((F.col("under") <= 0.51 * F.col("n")) & (F.col("upto") >= 0.49 * F.col("n"))).alias("near"))


query("a27_pivot_margins_sketched", _sketched_medians,
      """SELECT coalesce(o_orderstatus, 'All') AS o_orderstatus, coalesce(o_orderpriority, 'All') AS o_orderpriority, count(*) AS n, true AS near
         FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
query("a27_pivot_margins", lambda t: rounded(m.pivot_table(t("orders"), "o_orderstatus", "o_orderpriority", "o_totalprice", "mean", margins=True)),
      f"""SELECT o_orderstatus, {_cells('round(avg(o_totalprice) @, 6)')}, round(avg(o_totalprice), 6) AS "All" FROM orders GROUP BY o_orderstatus
          UNION ALL SELECT 'All', {_cells('round(avg(o_totalprice) @, 6)')}, round(avg(o_totalprice), 6) FROM orders""")
query("a27_pivot_margins_median", lambda t: rounded(m.pivot_table(t("orders"), "o_orderstatus", "o_orderpriority", "o_totalprice", "median", margins=True, margins_name="Total"), 4),
      f"""SELECT o_orderstatus, {_cells('round(quantile_cont(o_totalprice, 0.5) @, 4)')}, round(quantile_cont(o_totalprice, 0.5), 4) AS "Total" FROM orders GROUP BY o_orderstatus
          UNION ALL SELECT 'Total', {_cells('round(quantile_cont(o_totalprice, 0.5) @, 4)')}, round(quantile_cont(o_totalprice, 0.5), 4) FROM orders""")
query("a28_pivot_fill_value", lambda t: m.pivot_table(t("orders"), "o_custkey", "o_orderpriority", "o_orderkey", "max", fill_value=-1),
      f"SELECT o_custkey, {_cells('max(o_orderkey) @', '-1')} FROM orders GROUP BY o_custkey")
query("a29_pivot_keep_empty_columns", lambda t: m.pivot_table(
          m.set_values(t("orders"), "o_totalprice", m.isin("o_orderpriority", ["5-LOW"]), None), "o_orderstatus", "o_orderpriority", "o_totalprice", "max", keep_all_null_columns=True),
      "SELECT o_orderstatus, " + ", ".join(f"""max(o_totalprice) FILTER (o_orderpriority = '{p}') AS "{p}" """ for p in _PRIORITIES[:4]) + """, CAST(NULL AS DOUBLE) AS "5-LOW" FROM orders GROUP BY o_orderstatus""")
query("a29_pivot_drop_empty_columns", lambda t: m.pivot_table(
          m.set_values(t("orders"), "o_totalprice", m.isin("o_orderpriority", ["5-LOW"]), None), "o_orderstatus", "o_orderpriority", "o_totalprice", "max"),
      "SELECT o_orderstatus, " + ", ".join(f"""max(o_totalprice) FILTER (o_orderpriority = '{p}') AS "{p}" """ for p in _PRIORITIES[:4]) + " FROM orders GROUP BY o_orderstatus")
query("a30_pivot_precision", lambda t: m.pivot_table(t("orders"), "o_orderstatus", "o_orderpriority", "o_totalprice", "std", precision=1),
      f"SELECT o_orderstatus, {_cells('round(stddev_samp(o_totalprice) @, 1)')} FROM orders GROUP BY o_orderstatus")
query("a31_pivot_observed", lambda t: m.pivot_table(labelled(t), "lang", "quality", "doc_id", "count"),
      f"""SELECT lang, nullif(count(doc_id) FILTER (quality = 0), 0) AS "0", nullif(count(doc_id) FILTER (quality = 1), 0) AS "1" FROM {_LABELLED} WHERE quality IS NOT NULL GROUP BY lang""")

# --- running calculations ------------------------------------------------------------------------

_RUN = "ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
query("w01_pct_change", lambda t: rounded(m.pct_change(t("events").select("event_id", "ts", "value"), "value", order_by=["ts", "event_id"])),
      "SELECT event_id, ts, round(value, 6) AS value, round(value / lag(value) OVER (ORDER BY ts, event_id) - 1, 6) AS value_pct_change FROM events")
query("w01_pct_change_by_group", lambda t: rounded(m.pct_change(
          m.set_values(t("events").select("event_id", "ts", "user_id", "value"), "value", F.col("event_id") % 3 == 0, None), "value", order_by=["ts", "event_id"], by="user_id", into="change")),
      f"""SELECT event_id, ts, user_id, round(v, 6) AS value, round(filled / lag(filled) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1, 6) AS change
          FROM (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id {_RUN}) AS filled FROM (SELECT *, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events))""")
query("w02_cumulative_product", lambda t: rounded(m.cumulative_product(
          m.with_formula(t("events").select("event_id", "ts", "value"), "growth", "1 + (value - 50) / 1e6"), "growth", order_by=["ts", "event_id"]), 9),
      f"SELECT event_id, ts, round(value, 9) AS value, round(1 + (value - 50) / 1e6, 9) AS growth, round(product(1 + (value - 50) / 1e6) OVER ({_RUN}), 9) AS growth_cumprod FROM events")
query("w03_cumulative_sum", lambda t: rounded(m.cumulative_sum(t("events").select("event_id", "ts", "value"), "value", order_by=["ts", "event_id"]), 4),
      f"SELECT event_id, ts, round(value, 4) AS value, round(sum(value) OVER ({_RUN}), 4) AS value_cumsum FROM events")
query("w03_cumulative_sum_by_group", lambda t: rounded(m.cumulative_sum(
          m.set_values(t("events").select("event_id", "ts", "event_type", "value"), "value", F.col("event_id") % 4 == 0, None), "value", order_by=["ts", "event_id"], by=["event_type"]), 4),
      f"""SELECT event_id, ts, event_type, round(v, 4) AS value, CASE WHEN v IS NOT NULL THEN round(sum(v) OVER (PARTITION BY event_type {_RUN}), 4) END AS value_cumsum
          FROM (SELECT *, CASE WHEN event_id % 4 <> 0 THEN value END AS v FROM events)""")

# --- sort, sample, top-k, pages ------------------------------------------------------------------

query("o01_sort_rows", lambda t: m.sort_rows(labelled(t), [("quality", "desc"), "n_chars", "doc_id"]),
      f"SELECT * FROM {_LABELLED} ORDER BY quality DESC NULLS LAST, n_chars, doc_id")
query("o02_sort_as_text", lambda t: m.sort_rows(t("documents").select("doc_id", "lang"), "doc_id", as_text=True),
      "SELECT doc_id, lang FROM documents ORDER BY CAST(doc_id AS VARCHAR)")
query("o03_first_rows", lambda t: m.first_rows(t("lineitem"), 1234).agg(F.count(F.lit(1)).alias("n")),
      "SELECT count(*) AS n FROM (SELECT * FROM lineitem LIMIT 1234)")
query("o04_sample_rows", lambda t: m.sample_rows(t("orders"), 1000).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("n_keys")),
      "SELECT least(1000, count(*)) AS n, least(1000, count(*)) AS n_keys FROM orders")
query("o04_sample_by_key", lambda t: m.sample_rows(t("orders"), 1000, by=["o_orderkey"]).select("o_orderkey", "o_totalprice", "o_orderpriority"),
      "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders ORDER BY md5('123' || chr(31) || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 1000")
query("o05_keep_top_values", lambda t: m.keep_top_values(t("documents").select("doc_id", "source"), "source", 5),
      "SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 5)")
query("o05_top_values", lambda t: m.top_values(t("events"), "user_id", 20),
      """SELECT user_id, count(*) AS "count" FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 20""")
query("o06_page", lambda t: m.page(t("orders"), ["o_totalprice", "o_orderkey"], 1200, 100),
      "SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100 OFFSET 1200")
