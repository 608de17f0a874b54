"""Text, dates, casts, reshaping, encoding and binning."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

import millrace as m
from millrace.functions.dates import ATTRIBUTES
from millrace.queries.registry import Tables, query, rounded
from millrace.queries.tables import _LABELLED, labelled

# --- text ----------------------------------------------------------------------------------------


def docs(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", "text")


def part_names(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", "p_name")


query("x01_split_text", lambda t: m.split_text(part_names(t), "p_name", " "),
      "SELECT p_partkey, p_name, split_part(p_name, ' ', 1) AS p_name_0, nullif(split_part(p_name, ' ', 2), '') AS p_name_1 FROM part")
query("x01_split_text_regex", lambda t: m.split_text(t("customer").select("c_custkey", "c_name"), "c_name", "[#]0*", regex=True, max_splits=1, n_parts=3),
      "SELECT c_custkey, c_name, regexp_split_to_array(c_name, '#0*')[1] AS c_name_0, regexp_split_to_array(c_name, '#0*')[2] AS c_name_1, CAST(NULL AS VARCHAR) AS c_name_2 FROM customer")
query("x02_lower", lambda t: m.lower(docs(t), "text", suffix="_low"), "SELECT doc_id, text, lower(text) AS text_low FROM documents")
query("x03_upper", lambda t: m.upper(t("part").select("p_partkey", "p_name", "p_brand"), ["p_name", "p_brand"]), "SELECT p_partkey, upper(p_name) AS p_name, upper(p_brand) AS p_brand FROM part")
query("x04_title", lambda t: m.title(docs(t), "text"),
      r"""SELECT doc_id, list_aggregate(list_transform(regexp_extract_all(lower(text), '(\p{L}+|\P{L}+)'), lambda w: CASE WHEN w[1] = 'ß' THEN 'Ss' ELSE upper(w[1]) END || w[2:]), 'string_agg', '') AS text FROM documents""")
query("x05_capitalize", lambda t: m.capitalize(docs(t), "text"), "SELECT doc_id, upper(text[1]) || lower(text[2:]) AS text FROM documents")
query("x06_strip", lambda t: m.strip(m.with_formula(docs(t), "text", "concat(' \t', text, '\\n  ')"), "text"),
      r"SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM documents")
query("x07_length", lambda t: m.select_columns(m.length(docs(t), "text"), ["doc_id", "text_length"]), "SELECT doc_id, length(text) AS text_length FROM documents")
query("x08_replace_text", lambda t: m.replace_text(docs(t), "text", "the", "THE"), "SELECT doc_id, replace(text, 'the', 'THE') AS text FROM documents")
query("x08_replace_text_regex", lambda t: m.replace_text(docs(t), "text", "([aeiou])([0-9])", r"\2\1", regex=True), r"SELECT doc_id, regexp_replace(text, '([aeiou])([0-9])', '\2\1', 'g') AS text FROM documents")
query("x09_slice_text", lambda t: m.slice_text(m.slice_text(m.slice_text(part_names(t), "p_name", 1, 5, into="inner"), "p_name", -4, None, into="tail"), "p_name", None, -2, into="head"),
      """SELECT p_partkey, p_name, p_name[2:5] AS "inner", right(p_name, 4) AS tail, left(p_name, greatest(length(p_name) - 2, 0)) AS head FROM part""")
query("x10_text_formula", lambda t: m.with_formula(t("nation").select("n_nationkey", "n_name"), "tag", "concat(substring(n_name, 1, 3), '/', n_nationkey)"),
      "SELECT n_nationkey, n_name, n_name[1:3] || '/' || n_nationkey AS tag FROM nation")

# --- dates ---------------------------------------------------------------------------------------

_DAY = "CAST(ts AS DATE)"
# attribute -> key and SQL over a column named ts
_DATE_SQL = {
    "year": ("d01", "year(ts)"), "quarter": ("d02", "quarter(ts)"), "month_number": ("d03", "month(ts)"), "month_name": ("d04", "monthname(ts)"),
    "week": ("d05", "week(ts)"), "dayofyear": ("d06", "dayofyear(ts)"), "dayofmonth": ("d07", "day(ts)"), "dayofweek": ("d08", "isodow(ts) - 1"),
    "weekday_name": ("d09", "dayname(ts)"), "hour": ("d10", "hour(ts)"), "minute": ("d11", "minute(ts)"), "second": ("d12", "second(ts)"),
    "microsecond": ("d13", "epoch_us(ts) % 1000000"), "nanosecond": ("d14", "0"),
    "is_leap_year": ("d15", "(year(ts) % 4 = 0 AND year(ts) % 100 <> 0) OR year(ts) % 400 = 0"),
    "is_year_start": ("d16", "month(ts) = 1 AND day(ts) = 1"), "is_year_end": ("d17", "month(ts) = 12 AND day(ts) = 31"),
    "is_quarter_start": ("d18", "month(ts) % 3 = 1 AND day(ts) = 1"), "is_quarter_end": ("d19", f"month(ts) % 3 = 0 AND last_day(ts) = {_DAY}"),
    "is_month_start": ("d20", "day(ts) = 1"), "is_month_end": ("d21", f"last_day(ts) = {_DAY}"), "timestamp": ("d22", "epoch_us(ts) // 1000000"),
}


def _date_query(name: str):
    def build(t: Tables) -> DataFrame:
        orders = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"))
        events = t("events").select(F.col("event_id").alias("id"), "ts")
        return m.date_attribute(m.concat_rows(orders, events), "ts", name)

    return build


# registered under these names before
_KEYS = {"month_number": "month", "dayofmonth": "day", "dayofweek": "weekday", "timestamp": "unix_timestamp"}
for _name in ATTRIBUTES:
    _key, _sql = _DATE_SQL[_name]
    query(f"{_key}_{_KEYS.get(_name, _name)}", _date_query(_name),
          f"SELECT id, ts, {_sql} AS ts_{_name} FROM (SELECT o_orderkey AS id, o_orderdate AS ts FROM orders UNION ALL SELECT event_id, ts FROM events)")

# --- casts ---------------------------------------------------------------------------------------


def odd_texts(t: Tables) -> DataFrame:
    """Order keys as texts of which some are fractions, words or missing."""
    text = F.expr("""CASE WHEN o_orderkey % 7 = 0 THEN concat(o_orderkey, '.6') WHEN o_orderkey % 11 = 0 THEN 'none'
                     WHEN o_orderkey % 13 = 0 THEN NULL ELSE cast(o_orderkey AS string) END""")
    return t("orders").select("o_orderkey", text.alias("s"))


_ODD = """(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey || '.6' WHEN o_orderkey % 11 = 0 THEN 'none'
            WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS s FROM orders)"""

query("b01_to_string", lambda t: m.cast_column(m.cast_column(t("orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", "string"), "o_orderdate", "string", format="%d/%m/%Y at %H:%M"),
      "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, strftime(o_orderdate, '%d/%m/%Y at %H:%M') AS o_orderdate FROM orders")
query("b02_to_int64", lambda t: m.cast_column(odd_texts(t), "s", "int64", into="n"), f"SELECT o_orderkey, s, CAST(trunc(TRY_CAST(s AS DOUBLE)) AS BIGINT) AS n FROM {_ODD}")
query("b02_bool_to_int64", lambda t: m.cast_column(m.with_formula(labelled(t), "good", "quality = 1"), "good", "int64"), f"SELECT *, CAST(quality = 1 AS BIGINT) AS good FROM {_LABELLED}")
query("b03_to_small_integers", lambda t: m.cast_column(m.cast_column(m.cast_column(t("lineitem").select("l_orderkey", "l_quantity", "l_linenumber", "l_suppkey"), "l_quantity", "int8"), "l_linenumber", "int16"), "l_suppkey", "int32"),
      "SELECT l_orderkey, CAST(l_quantity AS TINYINT) AS l_quantity, CAST(l_linenumber AS SMALLINT) AS l_linenumber, CAST(l_suppkey AS INTEGER) AS l_suppkey FROM lineitem")
query("b04_to_unsigned", lambda t: m.cast_column(m.with_formula(t("orders").select("o_orderkey"), "n", "o_orderkey - 100"), "n", "uint8"),
      "SELECT o_orderkey, CASE WHEN o_orderkey - 100 BETWEEN 0 AND 255 THEN o_orderkey - 100 END AS n FROM orders")
query("b05_to_float64", lambda t: m.cast_column(odd_texts(t), "s", "float64", into="n"), f"SELECT o_orderkey, s, TRY_CAST(s AS DOUBLE) AS n FROM {_ODD}")
query("b06_to_bool", lambda t: m.cast_column(m.cast_column(labelled(t), "quality", "bool"), "lang", "bool"), f"SELECT * REPLACE (quality <> 0 AS quality, length(lang) > 0 AS lang) FROM {_LABELLED}")
query("b07_to_category", lambda t: m.cast_column(t("customer"), "c_mktsegment", "category"), "SELECT * FROM customer")
query("b08_to_object", lambda t: m.cast_column(t("part").select("p_partkey", "p_size"), "p_size", "object"), "SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size FROM part")
query("b09_to_datetime", lambda t: m.cast_column(m.cast_column(t("orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "string", format="%d.%m.%Y", into="s"), "s", "datetime", format="%d.%m.%Y", into="back"),
      "SELECT o_orderkey, o_orderdate, strftime(o_orderdate, '%d.%m.%Y') AS s, o_orderdate AS back FROM orders")
query("b09_to_datetime_inferred", lambda t: m.cast_column(m.cast_column(t("events").select("event_id", "ts"), "ts", "string", format="%Y-%m-%d %H:%M:%S.%f", into="s"), "s", "datetime", into="back"),
      "SELECT event_id, ts, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS s, ts AS back FROM events")


def _durations(t: Tables) -> DataFrame:
    rows = m.with_formula(t("orders").select("o_orderkey"), "s", "concat(o_orderkey % 9, ' days ', lpad(o_orderkey % 24, 2, '0'), ':', lpad(o_orderkey % 60, 2, '0'), ':30')")
    spans = m.cast_column(rows, "s", "timedelta", into="d")
    return spans.select("o_orderkey", (F.unix_seconds(F.timestamp_seconds(F.lit(0)) + F.col("d"))).alias("seconds"))


query("b10_to_timedelta", _durations, "SELECT o_orderkey, (o_orderkey % 9) * 86400 + (o_orderkey % 24) * 3600 + (o_orderkey % 60) * 60 + 30 AS seconds FROM orders")
query("b11_preset_casts", lambda t: m.cast_column(m.cast_column(t("part").select("p_partkey", "p_size", "p_retailprice"), "p_retailprice", "integer"), "p_size", "float"),
      "SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, CAST(trunc(p_retailprice) AS BIGINT) AS p_retailprice FROM part")
query("b12_bulk_cast", lambda t: m.cast_columns(t("lineitem").select("l_orderkey", "l_quantity", "l_extendedprice"), m.of_type("float"), "int64", suffix="_int"),
      "SELECT l_orderkey, l_quantity, l_extendedprice, CAST(trunc(l_quantity) AS BIGINT) AS l_quantity_int, CAST(trunc(l_extendedprice) AS BIGINT) AS l_extendedprice_int FROM lineitem")

# --- reshape -------------------------------------------------------------------------------------

query("r01_pivot_wide", lambda t: m.pivot_wide(m.group_agg(t("orders"), ["o_custkey", "o_orderstatus"], {"n": (None, "size")}), "o_orderstatus", "n"),
      """SELECT o_custkey, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS "F", nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS "O", nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS "P" FROM orders GROUP BY o_custkey""")
query("r02_melt", lambda t: m.melt(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"), ["l_orderkey", "l_linenumber"]),
      """SELECT l_orderkey, l_linenumber, 'l_quantity' AS variable, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem
         UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem""")
query("r02_melt_mixed", lambda t: m.melt(t("supplier"), "s_suppkey"),
      """SELECT s_suppkey, 's_name' AS variable, s_name AS value FROM supplier UNION ALL SELECT s_suppkey, 's_nationkey', CAST(s_nationkey AS VARCHAR) FROM supplier
         UNION ALL SELECT s_suppkey, 's_acctbal', CAST(s_acctbal AS VARCHAR) FROM supplier""")
query("r03_explode_rows", lambda t: m.explode_rows(t("embeddings"), "embedding"), "SELECT vec_id, unnest(embedding) AS embedding, label FROM embeddings")
query("r03_explode_words", lambda t: m.explode_rows(docs(t).select("doc_id", F.split("text", " ").alias("word")), "word"), "SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents")

# --- encoding ------------------------------------------------------------------------------------

_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
query("n01_one_hot", lambda t: m.one_hot(t("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment"),
      "SELECT c_custkey, " + ", ".join(f"CAST(c_mktsegment = '{s}' AS INTEGER) AS c_mktsegment_{s}" for s in _SEGMENTS) + " FROM customer")
query("n01_one_hot_missing", lambda t: m.one_hot(labelled(t).select("doc_id", "quality", "toxic"), ["quality", "toxic"], drop_first=True, dummy_na=True),
      f"""SELECT doc_id, CAST(coalesce(quality = 1, false) AS INTEGER) AS quality_1, CAST(quality IS NULL AS INTEGER) AS quality_nan,
                CAST(coalesce(toxic = 1, false) AS INTEGER) AS toxic_1, CAST(toxic IS NULL AS INTEGER) AS toxic_nan FROM {_LABELLED}""")
query("n02_label_encode", lambda t: m.label_encode(labelled(t).select("doc_id", "source", "quality"), ["source", "quality"]),
      f"SELECT doc_id, source, quality, dense_rank() OVER (ORDER BY source) - 1 AS source_label, coalesce(CAST(quality AS BIGINT), -1) AS quality_label FROM {_LABELLED}")
query("n02_label_encode_frequency", lambda t: m.label_encode(t("documents").select("doc_id", "source"), "source", order="frequency"),
      "SELECT d.doc_id, d.source, f.code AS source_label FROM documents d JOIN (SELECT source, row_number() OVER (ORDER BY count(*) DESC, source) - 1 AS code FROM documents GROUP BY source) f ON d.source = f.source")
query("n02_label_encode_appearance", lambda t: m.label_encode(t("events").select("event_id", "user_id"), "user_id", order="appearance", order_by=["event_id"]),
      "SELECT e.event_id, e.user_id, f.code AS user_id_label FROM events e JOIN (SELECT user_id, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM events GROUP BY user_id) f ON e.user_id = f.user_id")

# --- binning -------------------------------------------------------------------------------------


def prices(t: Tables) -> DataFrame:
    return t("lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")


_PRICES = "SELECT l_orderkey, l_quantity, l_extendedprice"
_RANGE = "(SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)"
query("g01_bin_equal", lambda t: m.bin_equal(prices(t), "l_extendedprice", 8, labels=("asc", 0), into="bin"),
      f"{_PRICES}, greatest(CAST(ceil((l_extendedprice - lo) / ((hi - lo) / 8)) AS INTEGER) - 1, 0) AS bin FROM lineitem, {_RANGE}")
query("g02_bin_width", lambda t: m.bin_width(prices(t), "l_quantity", 10, lo=0, into="bin"),
      f"{_PRICES}, " + "CASE " + " ".join(f"WHEN l_quantity <= {b} THEN '({a}, {b}.0]'" for a, b in ((-0.001, 10), (10.0, 20), (20.0, 30), (30.0, 40), (40.0, 50))) + " END AS bin FROM lineitem")
query("g02_bin_width_default_range", lambda t: m.bin_width(prices(t), "l_extendedprice", 20000, labels=("asc", 1), into="bin"),
      f"{_PRICES}, greatest(CAST(ceil((l_extendedprice - lo) / 20000) AS INTEGER), 1) AS bin FROM lineitem, {_RANGE}")
query("g03_bin_custom", lambda t: m.bin_custom(prices(t), "l_quantity", [(0, 10, "few"), (10, 25, "some"), (40, 50, "many")], into="bin"),
      f"{_PRICES}, CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN 'few' WHEN l_quantity > 10 AND l_quantity <= 25 THEN 'some' WHEN l_quantity > 40 AND l_quantity <= 50 THEN 'many' END AS bin FROM lineitem")
_QUARTERS = "(SELECT " + ", ".join(f"quantile_cont(l_extendedprice, {q}) AS q{i}" for i, q in enumerate((0.25, 0.5, 0.75))) + " FROM lineitem)"
query("g04_quantile_bins", lambda t: m.bin_quantile(prices(t), "l_extendedprice", 4, labels=("asc", 1), into="bin"),
      f"{_PRICES}, CASE WHEN l_extendedprice <= q0 THEN 1 WHEN l_extendedprice <= q1 THEN 2 WHEN l_extendedprice <= q2 THEN 3 ELSE 4 END AS bin FROM lineitem, {_QUARTERS}")
query("g05_closed_left", lambda t: m.bin_width(prices(t), "l_quantity", 10, lo=0, hi=60, closed="left", into="bin"),
      f"{_PRICES}, '[' || CAST(floor(l_quantity / 10) * 10 AS DOUBLE) || ', ' || CAST(floor(l_quantity / 10) * 10 + 10 AS DOUBLE) || ')' AS bin FROM lineitem")
query("g06_descending_labels", lambda t: m.bin_equal(prices(t), "l_extendedprice", 5, closed="left", labels=("desc", 1), into="bin"),
      f"{_PRICES}, 5 - least(CAST(floor((l_extendedprice - lo) / ((hi - lo) / 5)) AS INTEGER), 4) AS bin FROM lineitem, {_RANGE}")
query("g06_precision_labels", lambda t: m.bin_width(prices(t), "l_quantity", 12.5, lo=0, hi=50, labels=("precision", 1), into="bin"),
      f"{_PRICES}, " + "CASE " + " ".join(f"WHEN l_quantity <= {b} THEN '({a}, {b}]'" for a, b in ((-0.1, 12.5), (12.5, 25.0), (25.0, 37.5), (37.5, 50.0))) + " END AS bin FROM lineitem")
