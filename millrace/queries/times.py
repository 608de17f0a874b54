"""Changing the frequency of a time series."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

import millrace as m
from millrace.queries.registry import Tables, query, rounded
from millrace.streaming.live import resample_stream


def events(t: Tables) -> DataFrame:
    return t("events").select("event_id", "ts", "event_type", "value")


def orders(t: Tables) -> DataFrame:
    return t("orders").select("o_orderdate", "o_totalprice")


_MIDNIGHT = "(SELECT date_trunc('day', min(ts)) FROM events)"


def _fixed(step: str, value: str, empty: str = "NULL") -> str:
    """Aggregate per step over events, with empty periods."""
    return f"""WITH b AS (SELECT *, time_bucket(INTERVAL '{step}', ts, {_MIDNIGHT}) AS k FROM events),
                    g AS (SELECT unnest(generate_series(min(k), max(k), INTERVAL '{step}')) AS k FROM b),
                    a AS (SELECT k, {value} AS v FROM b GROUP BY k)
               SELECT g.k AS ts, coalesce(a.v, {empty}) AS @ FROM g LEFT JOIN a ON g.k = a.k"""


for _unit, _every, _step in (("H", 6, "6 hours"), ("D", 1, "1 day"), ("min", 90, "90 minutes"), ("H", 7, "7 hours"), ("S", 3600, "3600 seconds"), ("ms", 43_200_000, "12 hours")):
    query(f"t01_every_{_every}_{_unit}", lambda t, u=_unit, n=_every: rounded(m.resample(events(t), "ts", n, u, "mean", columns=["value"])),
          _fixed(_step, "round(avg(value), 6)").replace("@", "value"))
query("t01_every_us", lambda t: m.resample(events(t), "ts", 86_400_000_000, "us", "size"), _fixed("1 day", "count(*)", "0").replace("@", '"count"'))

_BUSINESS = "CAST(CASE isodow(o_orderdate) WHEN 6 THEN o_orderdate - INTERVAL 1 DAY WHEN 7 THEN o_orderdate - INTERVAL 2 DAY ELSE o_orderdate END AS TIMESTAMP)"
query("t02_business_day", lambda t: m.resample(orders(t), "o_orderdate", 1, "B", "size"),
      f"""WITH b AS (SELECT {_BUSINESS} AS k FROM orders), g AS (SELECT unnest(generate_series(min(k), max(k), INTERVAL 1 DAY)) AS k FROM b), a AS (SELECT k, count(*) AS n FROM b GROUP BY k)
          SELECT g.k AS o_orderdate, coalesce(n, 0) AS "count" FROM g LEFT JOIN a ON g.k = a.k WHERE isodow(g.k) < 6""")


def _calendar(label: str, days: int = 0) -> str:
    """Totals per label; with a number of days between labels, empty periods are listed too."""
    totals = f"SELECT {label} AS o_orderdate, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1"
    if not days:
        return totals
    return f"""WITH a AS ({totals}), g AS (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL {days} DAY)) AS k FROM a)
               SELECT g.k AS o_orderdate, coalesce(o_totalprice, 0) AS o_totalprice FROM g LEFT JOIN a ON g.k = a.o_orderdate"""


_FIRST_MONTH = "(SELECT date_trunc('month', min(o_orderdate)) FROM orders)"
_LABELS = {
    "t03_week": ("W", 1, "CAST(date_trunc('week', o_orderdate) + INTERVAL 6 DAY AS TIMESTAMP)"),
    "t03_two_weeks": ("W", 2, """(SELECT CAST(date_trunc('week', min(o_orderdate)) + INTERVAL 6 DAY AS TIMESTAMP) FROM orders) + INTERVAL 14 DAY *
        CAST(ceil(date_diff('day', (SELECT CAST(date_trunc('week', min(o_orderdate)) AS TIMESTAMP) FROM orders), CAST(date_trunc('week', o_orderdate) AS TIMESTAMP)) / 14) AS INTEGER)"""),
    "t04_month_start": ("MS", 1, "CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)"),
    "t04_five_month_start": ("MS", 5, f"CAST({_FIRST_MONTH} + INTERVAL 5 MONTH * CAST(date_diff('month', {_FIRST_MONTH}, o_orderdate) // 5 AS INTEGER) AS TIMESTAMP)"),
    "t04_quarter_start": ("QS", 1, "CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP)"),
    "t04_year_start": ("AS", 1, "CAST(date_trunc('year', o_orderdate) AS TIMESTAMP)"),
    "t05_month_end": ("M", 1, "CAST(last_day(o_orderdate) AS TIMESTAMP)"),
    "t05_quarter_end": ("Q", 1, "CAST(last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) AS TIMESTAMP)"),
    "t05_year_end": ("A", 1, "CAST(last_day(date_trunc('year', o_orderdate) + INTERVAL 11 MONTH) AS TIMESTAMP)"),
    "t06_semi_month_start": ("SMS", 1, "CAST(date_trunc('month', o_orderdate) + INTERVAL 14 DAY * CAST(day(o_orderdate) >= 15 AS INTEGER) AS TIMESTAMP)"),
    "t06_semi_month_end": ("SM", 1, """CAST(CASE WHEN last_day(o_orderdate) = CAST(o_orderdate AS DATE) THEN last_day(o_orderdate) WHEN day(o_orderdate) < 15
        THEN last_day(o_orderdate - INTERVAL 1 MONTH) ELSE date_trunc('month', o_orderdate) + INTERVAL 14 DAY END AS TIMESTAMP)"""),
}
for _key, (_unit, _every, _label) in _LABELS.items():
    query(_key, lambda t, u=_unit, n=_every: rounded(m.resample(orders(t), "o_orderdate", n, u, "sum"), 2), _calendar(_label, {"W": 7 * _every}.get(_unit, 0)))

# --- fills ---------------------------------------------------------------------------------------


def sparse(t: Tables) -> DataFrame:
    """Daily totals of urgent finished orders: a series with days missing."""
    urgent = m.filter_rows(t("orders"), [m.isin("o_orderstatus", ["F"]), m.isin("o_orderpriority", ["1-URGENT"])])
    return rounded(m.group_agg(urgent, "o_orderdate", {"total": ("o_totalprice", "sum"), "orders": (None, "size")}), 2)


_SPARSE = "s AS (SELECT o_orderdate AS d, round(sum(o_totalprice), 2) AS total, count(*) AS orders FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' GROUP BY o_orderdate)"


def _grid(step: str) -> str:
    return f"WITH {_SPARSE}, g AS (SELECT unnest(generate_series(min(d), max(d), INTERVAL '{step}')) AS d FROM s)"


query("t07_asfreq", lambda t: m.resample(sparse(t), "o_orderdate", 1, "D", "asfreq"),
      f"{_grid('1 day')} SELECT g.d AS o_orderdate, total, orders FROM g LEFT JOIN s ON g.d = s.d")
query("t08_forward_fill", lambda t: m.resample(sparse(t), "o_orderdate", 1, "D", "ffill"),
      f"{_grid('1 day')} SELECT g.d AS o_orderdate, total, orders FROM g ASOF LEFT JOIN s ON g.d >= s.d")
query("t08_backward_fill", lambda t: m.resample(sparse(t), "o_orderdate", 1, "D", "bfill"),
      f"{_grid('1 day')} SELECT g.d AS o_orderdate, total, orders FROM g ASOF LEFT JOIN s ON g.d <= s.d")
query("t08_forward_fill_irregular", lambda t: m.resample(events(t), "ts", 1, "H", "ffill", order_by=["event_id"]),
      f"""WITH g AS (SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL '1 hour')) AS k FROM events)
          SELECT g.k AS ts, event_id, event_type, value FROM g ASOF LEFT JOIN events e ON g.k >= e.ts""")
query("t09_nearest", lambda t: m.resample(sparse(t), "o_orderdate", 12, "H", "nearest"),
      f"""{_grid('12 hours')}, p AS (SELECT g.d, s.d AS pd, total, orders FROM g ASOF LEFT JOIN s ON g.d >= s.d), n AS (SELECT g.d, s.d AS nd, total, orders FROM g ASOF LEFT JOIN s ON g.d <= s.d)
          SELECT p.d AS o_orderdate, CASE WHEN nd IS NULL OR p.d - pd < nd - p.d THEN p.total ELSE n.total END AS total,
                 CASE WHEN nd IS NULL OR p.d - pd < nd - p.d THEN p.orders ELSE n.orders END AS orders FROM p JOIN n ON p.d = n.d""")
query("t10_interpolate", lambda t: rounded(m.resample(sparse(t), "o_orderdate", 1, "D", "interpolate", columns=["total"]), 7),
      f"""{_grid('1 day')}, p AS (SELECT g.d, s.d AS pd, total FROM g ASOF LEFT JOIN s ON g.d >= s.d), n AS (SELECT g.d, s.d AS nd, total FROM g ASOF LEFT JOIN s ON g.d <= s.d)
          SELECT p.d AS o_orderdate, round(CASE WHEN nd = pd THEN p.total ELSE p.total + (n.total - p.total) * epoch(p.d - pd) / epoch(nd - pd) END, 7) AS total FROM p JOIN n ON p.d = n.d""")

# --- aggregates per period -----------------------------------------------------------------------

_TEN = "10 minutes"
_AGGREGATES = {
    "count": ("value", "count(value)", "0"), "size": ("count", "count(*)", "0"), "nunique": ("event_type", "count(DISTINCT event_type)", "0"),
    "sum": ("value", "round(sum(value), 4)", "0"), "mean": ("value", "round(avg(value * 0.7310585786e0), 4)", "NULL"), "median": ("value", "round(quantile_cont(value, 0.5), 4)", "NULL"),
    "min": ("value", "min(value)", "NULL"), "max": ("value", "max(value)", "NULL"), "first": ("event_type", "arg_min(event_type, (ts, event_id))", "NULL"),
    "last": ("event_type", "arg_max(event_type, (ts, event_id))", "NULL"), "std": ("value", "round(stddev_samp(value * 0.7310585786e0), 4)", "NULL"),
    "var": ("value", "round(var_samp(value * 0.7310585786e0), 4)", "NULL"), "sem": ("value", "round(stddev_samp(value * 0.7310585786e0) / sqrt(count(value)), 4)", "NULL"),
    "prod": ("value", "round(product(1 + value / 1e4), 4)", "1"),
}


# keeps rounded results away from exact halves, and products near one
_SCALED = {"prod": "1 + value / 1e4", **dict.fromkeys(("mean", "std", "var", "sem"), "value * 0.7310585786e0")}


def _per_period(how: str, column: str):
    def build(t: Tables) -> DataFrame:
        rows = events(t)
        if how in _SCALED:
            rows = m.with_formula(rows, "value", _SCALED[how])
        chosen = None if how == "size" else [column]
        return rounded(m.resample(rows, "ts", 10, "min", how, columns=chosen, order_by=["event_id"]), 4)

    return build


for _how, (_column, _sql, _empty) in _AGGREGATES.items():
    query(f"t11_{_how}", _per_period(_how, _column), _fixed(_TEN, _sql, _empty).replace("@", f'"{_column}"'))
query("t11_by_group", lambda t: rounded(m.resample(events(t), "ts", 4, "H", "mean", by="event_type", columns=["value"])),
      f"""WITH b AS (SELECT *, time_bucket(INTERVAL '4 hours', ts, {_MIDNIGHT}) AS k FROM events),
               g AS (SELECT event_type, unnest(generate_series(min(k), max(k), INTERVAL '4 hours')) AS k FROM b GROUP BY event_type)
          SELECT g.event_type, g.k AS ts, round(avg(value), 6) AS value FROM g LEFT JOIN b ON g.k = b.k AND g.event_type = b.event_type GROUP BY g.event_type, g.k""")
query("t11_stream_form", lambda t: rounded(resample_stream(events(t), "ts", {"n": (None, "size"), "total": ("value", "sum")}, 6, "H", by=["event_type"]), 4),
      "SELECT event_type, time_bucket(INTERVAL '6 hours', ts) AS ts, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
query("t12_open_high_low_close", lambda t: m.resample(events(t), "ts", 1, "D", "ohlc", columns=["value"], order_by=["event_id"]),
      """SELECT date_trunc('day', ts) AS ts, arg_min(value, (ts, event_id)) AS value_open, max(value) AS value_high, min(value) AS value_low, arg_max(value, (ts, event_id)) AS value_close
         FROM events GROUP BY 1""")


def _refused(t: Tables) -> DataFrame:
    """Filling a series with repeated times is an error; the repeated times are shown instead."""
    try:
        return m.resample(orders(t), "o_orderdate", 1, "D", "ffill")
    except ValueError:
        return m.group_agg(orders(t), "o_orderdate", {"rows": (None, "size")}).where("rows > 1")


query("t13_duplicates_refused", _refused, """SELECT o_orderdate, count(*) AS "rows" FROM orders GROUP BY o_orderdate HAVING count(*) > 1""")
