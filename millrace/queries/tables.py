"""Sources, sinks, columns, filters, missing values, joins and sets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

import millrace as m
from millrace.queries.registry import Tables, query, rounded, scratch

# --- sources and sinks ---------------------------------------------------------------------------


def _csv_round_trip(t: Tables) -> DataFrame:
    folder = scratch(t.spark)
    german = t("customer").withColumn("c_acctbal", F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(",")))
    m.write_csv(german, folder, sep=";")
    back = m.read_csv(t.spark, folder, sep=";", decimal=",")
    return back.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_acctbal", "c_mktsegment")


_LISTED = ("region", "nation", "customer")


def _named(t: Tables, table: str) -> str:
    name = f"millrace_{table}"
    m.register(t(table), name)
    return name


def _catalog_round_trip(t: Tables) -> DataFrame:
    name = f"millrace_{uuid.uuid4().hex}"
    m.write_table(t("customer"), name, database="default")
    try:
        stored = m.read_table(t.spark, f"spark_catalog.default.{name}")
        per_segment = m.group_agg(stored, "c_mktsegment", {"n": (None, "size"), "balance": ("c_acctbal", "sum")})
        rows = rounded(per_segment, 2).collect()  # one row per market segment
        return t.spark.createDataFrame(rows, per_segment.schema)
    finally:
        t.spark.sql(f"DROP TABLE IF EXISTS default.{name}")


def _listed(t: Tables) -> DataFrame:
    """The rows of every table that the list names, beside the catalog and the database that the lists name."""
    for table in _LISTED:
        _named(t, table)
    listed = m.list_tables(t.spark).where(F.col("tableName").isin([f"millrace_{n}" for n in _LISTED])).select("tableName", "isTemporary").collect()
    catalogs = m.list_catalogs(t.spark).where("catalog = 'spark_catalog'").select("catalog")
    databases = m.list_databases(t.spark, "spark_catalog").where("namespace = 'default'").select("namespace")
    counts = [
        m.read_table(t.spark, name).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), F.lit(temporary).alias("temporary"), "rows")
        for name, temporary in listed
    ]
    return m.concat_rows(*counts).select(catalogs.scalar().alias("catalog"), databases.scalar().alias("database"), "table_name", "temporary", "rows")


query(
    "s01_read_csv", _csv_round_trip,
    "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer",
)
query(
    "s02_read_parquet_limit",
    lambda t: m.read_parquet(t.spark, f"{t.folder}/lineitem.parquet", limit=500).agg(F.count(F.lit(1)).alias("n")),
    "SELECT count(*) AS n FROM (SELECT * FROM lineitem LIMIT 500)",
)
query(
    "s03_read_table_last",
    lambda t: m.read_table(t.spark, _named(t, "orders"), mode="last", n=250, order_by=["o_orderkey"]),
    "SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 250",
)
query(
    "s03_read_table_first",
    lambda t: m.read_table(t.spark, _named(t, "orders"), mode="first", n=250).agg(F.count(F.lit(1)).alias("n")),
    "SELECT count(*) AS n FROM (SELECT * FROM orders LIMIT 250)",
)
query(
    "s03_read_table_random",
    lambda t: m.read_table(t.spark, _named(t, "orders"), mode="random", n=250).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("n_keys")
    ),
    "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS n_keys FROM (SELECT * FROM orders LIMIT 250)",
)
query(
    "s04_three_level_table_and_k02_write_table", _catalog_round_trip,
    "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY c_mktsegment",
)
query(
    "s05_list_tables", _listed,
    " UNION ALL ".join(f"SELECT 'spark_catalog' AS catalog, 'default' AS database, 'millrace_{n}' AS table_name, true AS temporary, count(*) AS \"rows\" FROM {n}" for n in _LISTED),
)
query(
    "s06_repeat_rows",
    lambda t: m.repeat_rows(t("orders"), 7).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")),
    "SELECT o_orderstatus, count(*) * 7 AS n FROM orders GROUP BY o_orderstatus",
)


def _csv_copy(t: Tables) -> DataFrame:
    folder = scratch(t.spark)
    m.write_csv(t("orders"), folder)
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    return m.read_csv(t.spark, folder, schema=schema)


query("k01_write_csv", _csv_copy, "SELECT * FROM orders")


def _kept(t: Tables) -> DataFrame:
    m.register(m.filter_rows(t("orders"), m.cmp("o_totalprice", ">", 400000)), "millrace_large_orders")
    return t.spark.table("millrace_large_orders").select("o_orderkey", "o_totalprice")


query("k03_register", _kept, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000")

# --- projection and selectors --------------------------------------------------------------------

query("p01_select_columns", lambda t: m.select_columns(t("orders"), ["o_totalprice", "o_orderkey"]),
      "SELECT o_totalprice, o_orderkey FROM orders")
query("p02_drop_columns", lambda t: m.drop_columns(t("orders"), ["o_orderdate", "o_custkey"]),
      "SELECT * EXCLUDE (o_orderdate, o_custkey) FROM orders")
query("p03_select_all", lambda t: m.select_columns(t("nation"), m.all_columns()), "SELECT * FROM nation")
query("p04_select_by_type", lambda t: m.select_columns(t("orders"), [m.of_type("float"), m.of_type("datetime")]),
      "SELECT o_totalprice, o_orderdate FROM orders")
query("p04_select_integers", lambda t: m.select_columns(t("part"), m.of_type("integer")),
      "SELECT p_partkey, p_size FROM part")
query("p05_select_by_regex", lambda t: m.select_columns(t("lineitem"), m.matching("^l_.*key$")),
      "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem")
query("p06_select_by_name", lambda t: m.select_columns(
          t("orders"), [m.starting_with("o_order"), m.ending_with("price"), m.containing("cust")]),
      "SELECT o_orderkey, o_orderstatus, o_orderdate, o_orderpriority, o_totalprice, o_custkey FROM orders")
query("p07_select_mixed", lambda t: m.select_columns(t("customer"), [*m.cols("c_mktsegment", "c_custkey"), m.of_type("float")]),
      "SELECT c_mktsegment, c_custkey, c_acctbal FROM customer")
query("p08_rename_one", lambda t: m.rename(t("nation"), {"n_name": "nation"}),
      "SELECT n_nationkey, n_name AS nation, n_regionkey FROM nation")
query("p09_rename_several", lambda t: m.rename(t("customer"), {"c_custkey": "id", "c_name": "name", "c_acctbal": "balance"}),
      "SELECT c_custkey AS id, c_name AS name, c_nationkey, c_acctbal AS balance, c_mktsegment FROM customer")
query("p10_clean_column_names", lambda t: m.clean_column_names(
          t("supplier").toDF(" SuppKey", "Supplier - Name", "nation_Key?", "AcctBal (USD)")),
      "SELECT s_suppkey AS supp_key, s_name AS supplier_name, s_nationkey AS nation_key, s_acctbal AS acct_bal_usd FROM supplier")
query("p11_copy_column", lambda t: m.copy_column(t("nation"), "n_name", "n_label"), "SELECT *, n_name AS n_label FROM nation")
query("p12_move_columns", lambda t: m.move_columns(t("supplier"), ["s_acctbal", "s_name"], "before", "s_suppkey"),
      "SELECT s_acctbal, s_name, s_suppkey, s_nationkey FROM supplier")
query("p13_normalize_names", lambda t: m.normalize_names(
          t("part").select("p_partkey", F.struct("p_brand", F.col("p_size").alias("size")).alias("info"), F.col("p_type").alias("p_partkey"))),
      "SELECT p_partkey, p_brand AS info_p_brand, p_size AS info_size, p_type AS p_partkey_1 FROM part")
query("p14_formula", lambda t: m.with_formula(
          m.with_formula(t("lineitem").select("l_orderkey", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"),
                         "revenue", "round(l_extendedprice * (1 - l_discount), 4)"),
          "flags", "l_returnflag || '-' || l_linestatus"),
      """SELECT l_orderkey, l_extendedprice, l_discount, l_returnflag, l_linestatus,
                round(l_extendedprice * (1 - l_discount), 4) AS revenue,
                l_returnflag || '-' || l_linestatus AS flags FROM lineitem""")
query("p14_boolean_formula", lambda t: m.with_formula(t("part").select("p_partkey", "p_size", "p_type"), "odd",
          "NOT (p_size > 10 AND p_type = 'ECONOMY') OR p_size BETWEEN 20 AND 25"),
      """SELECT p_partkey, p_size, p_type,
                NOT (p_size > 10 AND p_type = 'ECONOMY') OR p_size BETWEEN 20 AND 25 AS odd FROM part""")
query("p15_in_place_or_new", lambda t: m.upper(m.lower(t("part").select("p_partkey", "p_brand"), "p_brand", suffix="_low"), "p_brand"),
      "SELECT p_partkey, upper(p_brand) AS p_brand, lower(p_brand) AS p_brand_low FROM part")

# --- filters -------------------------------------------------------------------------------------

_LABELLED = "(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def labelled(t: Tables) -> DataFrame:
    """Documents with their labels; most labels are missing."""
    docs = t("documents").select("doc_id", "lang", "source", "n_chars")
    return m.join(docs, t("labels"), on="doc_id", how="left")


query("f01_keep_rows", lambda t: m.filter_rows(t("orders"), [m.cmp("o_totalprice", ">", 300000), m.isin("o_orderstatus", ["F"])]),
      "SELECT * FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F'")
query("f01_drop_rows", lambda t: m.filter_rows(labelled(t), m.cmp("quality", "==", 1), how="drop"),
      f"SELECT * FROM {_LABELLED} WHERE quality IS DISTINCT FROM 1")
query("f02_left_to_right_chain", lambda t: m.filter_rows(t("orders"), m.chain(
          m.isin("o_orderstatus", ["P"]), ("or", m.cmp("o_totalprice", "<", 50000)), ("and", m.contains("o_orderpriority", "high")))),
      "SELECT * FROM orders WHERE (o_orderstatus = 'P' OR o_totalprice < 50000) AND contains(lower(o_orderpriority), 'high')")
query("f03_isin", lambda t: m.filter_rows(labelled(t), m.isin("toxic", [1, None])),
      f"SELECT * FROM {_LABELLED} WHERE toxic = 1 OR toxic IS NULL")
query("f03_isin_long_list", lambda t: m.keep_in(t("orders"), "o_custkey", m.filter_rows(t("customer"), m.isin("c_mktsegment", ["BUILDING"])).select("c_custkey")),
      "SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
query("f04_starts_with", lambda t: m.filter_rows(t("part"), m.starts_with("p_name", "red")), "SELECT * FROM part WHERE starts_with(p_name, 'red')")
query("f05_ends_with", lambda t: m.filter_rows(t("part"), m.ends_with("p_name", "bolt")), "SELECT * FROM part WHERE suffix(p_name, 'bolt')")
query("f06_contains", lambda t: m.filter_rows(t("documents"), m.contains("text", "THE")).select("doc_id"),
      "SELECT doc_id FROM documents WHERE contains(lower(text), 'the')")
query("f06_contains_case", lambda t: m.filter_rows(t("documents"), m.contains("text", "The", case=True)).select("doc_id"),
      "SELECT doc_id FROM documents WHERE contains(text, 'The')")
query("f06_contains_regex", lambda t: m.filter_rows(t("documents"), m.contains("text", "[0-9]{3}-[0-9]{2,4}", regex=True)).select("doc_id"),
      "SELECT doc_id FROM documents WHERE regexp_matches(text, '[0-9]{3}-[0-9]{2,4}')")
query("f07_is_missing", lambda t: m.filter_rows(labelled(t), m.is_missing("quality")), f"SELECT * FROM {_LABELLED} WHERE quality IS NULL")
query("f07_is_not_missing", lambda t: m.filter_rows(labelled(t), m.is_present("quality")), f"SELECT * FROM {_LABELLED} WHERE quality IS NOT NULL")
query("f08_compare_numbers", lambda t: m.filter_rows(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"),
          [m.cmp("l_quantity", ">=", 10), m.cmp("l_extendedprice", "<", "l_quantity * 1500"), m.cmp("l_discount", "!=", 0.05)]),
      """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount FROM lineitem
         WHERE l_quantity >= 10 AND l_extendedprice < l_quantity * 1500 AND l_discount <> 0.05""")
query("f08_not_equal_keeps_missing", lambda t: m.filter_rows(labelled(t), m.cmp("quality", "!=", 1)),
      f"SELECT * FROM {_LABELLED} WHERE quality IS DISTINCT FROM 1")
query("f09_compare_dates", lambda t: m.filter_rows(t("orders"), [m.cmp("o_orderdate", ">=", "1996-03-01"), m.cmp("o_orderdate", "<", "1996-06-01")]),
      "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-06-01'")
query("f10_is_true", lambda t: m.filter_rows(m.with_formula(labelled(t), "good", "quality = 1"), m.is_true("good")),
      f"SELECT *, quality = 1 AS good FROM {_LABELLED} WHERE quality = 1")
query("f11_between", lambda t: m.filter_rows(t("orders"), [m.between("o_totalprice", 100000, 150000), m.between("o_orderdate", "1997-01-01", None)]),
      "SELECT * FROM orders WHERE o_totalprice BETWEEN 100000 AND 150000 AND o_orderdate >= TIMESTAMP '1997-01-01'")
query("f12_is_false", lambda t: m.filter_rows(m.with_formula(labelled(t), "good", "quality = 1"), m.is_false("good")),
      f"SELECT *, quality = 1 AS good FROM {_LABELLED} WHERE NOT (quality = 1)")
query("f13_not_in", lambda t: m.filter_rows(labelled(t), m.not_in("toxic", [0])), f"SELECT * FROM {_LABELLED} WHERE toxic IS DISTINCT FROM 0")
query("f14_all_filters", lambda t: m.filter_rows(t("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate", "l_returnflag"),
          [m.between("l_quantity", 5, 20), m.between("l_shipdate", "1998-01-01", "1998-12-31"), m.not_in("l_returnflag", ["N"])]),
      """SELECT l_orderkey, l_partkey, l_quantity, l_shipdate, l_returnflag FROM lineitem
         WHERE l_quantity BETWEEN 5 AND 20 AND l_shipdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-12-31' AND l_returnflag <> 'N'""")
query("f15_filter_report", lambda t: m.filter_report(t("orders"), m.cmp("o_totalprice", ">", 250000)),
      """SELECT count(*) AS rows_before, count(*) FILTER (o_totalprice > 250000) AS rows_after,
                count(*) FILTER (o_totalprice <= 250000) AS removed,
                CAST(floor(count(*) FILTER (o_totalprice <= 250000) * 100.0 / count(*)) AS BIGINT) AS removed_percent FROM orders""")


def _offered(t: Tables) -> DataFrame:
    """The predicates a filter form would offer, for the columns that hold values."""
    orders = t("orders")
    offered = {f.name: ",".join(m.predicates_for(f)) for f in orders.schema.fields}
    filled = orders.agg(*[F.count(c).alias(c) for c in orders.columns])
    rows = filled.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(text).alias("predicates"), F.col(c).alias("values")) for c, text in offered.items()
    ])).alias("e"))
    return rows.select("e.*").where(F.col("column").isin("o_orderstatus", "o_totalprice"))


query("f16_predicates_for", _offered,
      """SELECT 'o_orderstatus' AS "column", 'isin,not_in,starts_with,ends_with,contains,is_missing,is_present' AS predicates, count(o_orderstatus) AS "values" FROM orders
         UNION ALL SELECT 'o_totalprice', '<,<=,==,!=,>,>=,between,is_missing,is_present', count(o_totalprice) FROM orders""")

# --- missing values ------------------------------------------------------------------------------

query("m01_drop_missing_rows", lambda t: m.drop_missing_rows(labelled(t), ["quality"]), f"SELECT * FROM {_LABELLED} WHERE quality IS NOT NULL")
query("m01_drop_missing_rows_any", lambda t: m.drop_missing_rows(labelled(t)), f"SELECT * FROM {_LABELLED} WHERE quality IS NOT NULL AND toxic IS NOT NULL")
query("m02_drop_missing_columns_any", lambda t: m.drop_missing_columns(labelled(t), "any"), f"SELECT doc_id, lang, source, n_chars FROM {_LABELLED}")
query("m02_drop_missing_columns_all", lambda t: m.drop_missing_columns(labelled(t).withColumn("void", F.lit(None).cast("int")), "all"), f"SELECT * FROM {_LABELLED}")
query("m03_fill_constant", lambda t: m.fill_missing(m.fill_missing(labelled(t), "quality", 9), "toxic", "unknown"),
      f"SELECT * REPLACE (coalesce(quality, 9) AS quality, coalesce(CAST(toxic AS VARCHAR), 'unknown') AS toxic) FROM {_LABELLED}")
query("m04_fill_mean", lambda t: rounded(m.fill_missing(labelled(t), ["quality", "toxic"], how="mean")),
      f"""SELECT * REPLACE (round(coalesce(CAST(quality AS DOUBLE), (SELECT avg(quality) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents))), 6) AS quality,
                            round(coalesce(CAST(toxic AS DOUBLE), (SELECT avg(toxic) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents))), 6) AS toxic) FROM {_LABELLED}""")
query("m05_fill_median", lambda t: m.fill_missing(labelled(t), "quality", how="median"),
      f"SELECT * REPLACE (coalesce(CAST(quality AS DOUBLE), (SELECT quantile_cont(CAST(quality AS DOUBLE), 0.5) FROM {_LABELLED})) AS quality) FROM {_LABELLED}")
query("m06_fill_mode", lambda t: m.fill_missing(labelled(t), "toxic", how="mode"),
      f"SELECT * REPLACE (coalesce(toxic, (SELECT toxic FROM {_LABELLED} WHERE toxic IS NOT NULL GROUP BY toxic ORDER BY count(*) DESC, toxic LIMIT 1)) AS toxic) FROM {_LABELLED}")
query("m07_forward_fill", lambda t: m.fill_missing(labelled(t), ["quality", "toxic"], how="ffill", order_by=["doc_id"]),
      f"""SELECT * REPLACE (last_value(quality IGNORE NULLS) OVER w AS quality, last_value(toxic IGNORE NULLS) OVER w AS toxic) FROM {_LABELLED}
          WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
query("m07_forward_fill_by_group", lambda t: m.fill_missing(labelled(t), "quality", how="ffill", order_by=["doc_id"], partition_by=["source"]),
      f"""SELECT * REPLACE (last_value(quality IGNORE NULLS) OVER w AS quality) FROM {_LABELLED}
          WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
query("m08_backward_fill", lambda t: m.fill_missing(labelled(t), ["quality"], how="bfill", order_by=["doc_id"]),
      f"""SELECT * REPLACE (first_value(quality IGNORE NULLS) OVER w AS quality) FROM {_LABELLED}
          WINDOW w AS (ORDER BY doc_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")

# --- value replacement ---------------------------------------------------------------------------

query("v01_replace_in_column", lambda t: m.replace_value(t("orders"), "F", "finished", "o_orderstatus"),
      "SELECT * REPLACE (CASE WHEN o_orderstatus = 'F' THEN 'finished' ELSE o_orderstatus END AS o_orderstatus) FROM orders")
query("v01_replace_everywhere", lambda t: m.replace_value(labelled(t), 1, 100),
      f"""SELECT * REPLACE (CASE WHEN doc_id = 1 THEN 100 ELSE doc_id END AS doc_id, CASE WHEN n_chars = 1 THEN 100 ELSE n_chars END AS n_chars,
                            CASE WHEN quality = 1 THEN 100 ELSE quality END AS quality, CASE WHEN toxic = 1 THEN 100 ELSE toxic END AS toxic) FROM {_LABELLED}""")
query("v01_replace_missing", lambda t: m.replace_value(labelled(t), None, -1, "quality"), f"SELECT * REPLACE (coalesce(quality, -1) AS quality) FROM {_LABELLED}")
query("v02_set_values", lambda t: m.set_values(t("orders"), "o_orderpriority", m.cmp("o_totalprice", ">", 400000), "0-TOP"),
      "SELECT * REPLACE (CASE WHEN o_totalprice > 400000 THEN '0-TOP' ELSE o_orderpriority END AS o_orderpriority) FROM orders")
query("v03_if_else", lambda t: m.set_values(t("orders"), "size", m.cmp("o_totalprice", ">", 250000), "large", otherwise="small"),
      "SELECT *, CASE WHEN o_totalprice > 250000 THEN 'large' ELSE 'small' END AS size FROM orders")
query("v04_operands", lambda t: m.set_values(m.set_values(t("orders"), "o_orderstatus", m.isin("o_orderstatus", ["P"]), None),
          "o_orderpriority", m.cmp("o_totalprice", "<", 50000), F.col("o_orderstatus")),
      """SELECT * REPLACE (CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS o_orderstatus,
                CASE WHEN o_totalprice < 50000 THEN CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END ELSE o_orderpriority END AS o_orderpriority) FROM orders""")

# --- joins ---------------------------------------------------------------------------------------

query("j01_inner_join", lambda t: m.join(t("orders"), t("customer"), on=[("o_custkey", "c_custkey")]),
      "SELECT o.*, c.* FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
query("j01_inner_join_two_keys", lambda t: m.join(
          t("conversations").select("conv_id", "turn", "role"),
          t("conversations").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("previous_role")), on=["conv_id", "turn"]),
      "SELECT a.conv_id, a.turn, a.role, b.role AS previous_role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1")
query("j02_left_join", lambda t: m.join(t("documents").select("doc_id", "lang"), t("labels"), on="doc_id", how="left"),
      "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
query("j02_left_join_split", lambda t: m.join(t("documents").select("doc_id", "lang"), t("labels"), on="doc_id", how="left", hot="split"),
      "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
query("j03_right_join", lambda t: m.join(m.filter_rows(t("orders"), m.cmp("o_totalprice", ">", 400000)), t("customer"), on=[("o_custkey", "c_custkey")], how="right"),
      "SELECT o.*, c.* FROM (SELECT * FROM orders WHERE o_totalprice > 400000) o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey")


def _good(t: Tables) -> DataFrame:
    return m.filter_rows(labelled(t), m.isin("lang", ["en", "de"])).select("doc_id", "lang", "quality")


def _shifted(t: Tables) -> DataFrame:
    return m.with_formula(t("labels"), "doc_id", "doc_id + 5")


_OUTER = f"""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.lang, a.quality AS quality_x, b.quality AS quality_y, b.toxic
             FROM (SELECT * FROM {_LABELLED} WHERE lang IN ('en', 'de')) a FULL JOIN (SELECT doc_id + 5 AS doc_id, quality, toxic FROM labels) b ON a.doc_id = b.doc_id"""
query("j04_outer_join", lambda t: m.join(_good(t), _shifted(t), on="doc_id", how="outer"), _OUTER)
query("j04_outer_join_split", lambda t: m.join(_good(t), _shifted(t), on="doc_id", how="outer", hot="split"), _OUTER)
query("j05_missing_keys_match", lambda t: m.join(
          m.group_agg(labelled(t), ["quality"], {"docs": (None, "size")}, keep_null_keys=True),
          m.group_agg(labelled(t), ["toxic"], {"chars": ("n_chars", "sum")}, keep_null_keys=True), on=[("quality", "toxic")]),
      f"""SELECT a.quality, a.docs, b.toxic, b.chars FROM (SELECT quality, count(*) AS docs FROM {_LABELLED} GROUP BY quality) a
          JOIN (SELECT toxic, CAST(sum(n_chars) AS BIGINT) AS chars FROM {_LABELLED} GROUP BY toxic) b ON a.quality IS NOT DISTINCT FROM b.toxic""")
query("j06_right_columns", lambda t: m.join(t("customer"), t("nation"), on=[("c_nationkey", "n_nationkey")], right_columns=["n_name"]),
      "SELECT c.*, n.n_nationkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
query("j06_right_drop", lambda t: m.join(t("customer"), t("nation"), on=[("c_nationkey", "n_nationkey")], right_drop=["n_regionkey", "n_nationkey"]),
      "SELECT c.*, n.n_nationkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
query("j07_suffixes", lambda t: m.join(t("events").select("event_id", "user_id", "value"), t("events").select((F.col("event_id") + 1).alias("event_id"), "user_id", "value"),
          on="event_id", suffixes=("_now", "_before")),
      """SELECT a.event_id, a.user_id AS user_id_now, a.value AS value_now, b.user_id AS user_id_before, b.value AS value_before
         FROM events a JOIN events b ON a.event_id = b.event_id + 1""")
query("j08_common_keys", lambda t: m.join(t("documents").select("doc_id", "source"), t("labels"), on=m.common_keys(t("documents"), t("labels"))),
      "SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")

# --- sets ----------------------------------------------------------------------------------------

query("u01_concat_rows", lambda t: m.concat_rows(
          t("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), "c_mktsegment"),
          t("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("balance")),
          t("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))),
      """SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, c_mktsegment FROM customer
         UNION ALL SELECT s_suppkey, s_name, CAST(s_nationkey AS DOUBLE), NULL FROM supplier UNION ALL SELECT n_nationkey, n_name, NULL, NULL FROM nation""")
query("u02_concat_columns", lambda t: m.concat_columns(t("orders").select("o_orderkey", "o_totalprice"), t("customer").select("c_custkey", "c_acctbal"),
          order_by=[["o_totalprice", "o_orderkey"], ["c_acctbal", "c_custkey"]]),
      """SELECT o_orderkey, o_totalprice, c_custkey, c_acctbal
         FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS i FROM orders) a
         FULL JOIN (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS i FROM customer) b ON a.i = b.i""")
query("u03_distinct_rows", lambda t: m.drop_duplicates(t("lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")),
      "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
query("u03_keep_first", lambda t: m.drop_duplicates(t("orders"), ["o_custkey"], keep="first", order_by=["o_orderdate", "o_orderkey"]),
      "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
query("u03_keep_last", lambda t: m.drop_duplicates(t("orders"), ["o_custkey", "o_orderstatus"], keep="last", order_by=["o_orderdate", "o_orderkey"]),
      "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
