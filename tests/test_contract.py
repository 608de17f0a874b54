"""Missing values, order, names and types on small hand-made tables."""

import math

import pytest
from pyspark.sql import functions as F, types as T

import millrace as m
from millrace.contract import common_type, unique_names
from millrace.functions.casts import java_pattern
from millrace.operators.project import clean_name

NAN = float("nan")


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame(
        [(1, "a", 1.0), (2, None, 2.0), (3, "b", NAN), (4, "a", None), (5, "b", 5.0)], "id int, g string, v double"
    ).cache()


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_sorting_puts_missing_last_both_ways(nulls):
    assert [r["id"] for r in m.sort_rows(nulls, ["v", "id"]).collect()] == [1, 2, 5, 3, 4]
    assert [r["id"] for r in m.sort_rows(nulls, [("v", "desc"), "id"]).collect()] == [5, 2, 1, 3, 4]


def test_group_keys_drop_missing(nulls):
    got = {r["g"]: r["n"] for r in m.group_agg(nulls, "g", {"n": (None, "size")}).collect()}
    assert got == {"a": 2, "b": 2}
    kept = {r["g"]: r["n"] for r in m.group_agg(nulls, "g", {"n": (None, "size")}, keep_null_keys=True).collect()}
    assert kept == {"a": 2, "b": 2, None: 1}


def test_joins_match_missing_keys(nulls):
    right = nulls.select("g", F.col("id").alias("other"))
    assert m.join(nulls, right, "g").where("g is null").count() == 1
    assert m.join(nulls, right, "g", null_safe=False).where("g is null").count() == 0


@pytest.mark.parametrize("op,want", [("<", [1]), ("<=", [1, 2]), ("==", [2]), ("!=", [1, 3, 4, 5]), (">", [5]), (">=", [2, 5])])
def test_comparisons_are_two_valued(nulls, op, want):
    test = m.cmp("v", op, 2)
    assert ids(m.filter_rows(nulls, test)) == want
    assert ids(m.filter_rows(nulls, test, "drop")) == sorted({1, 2, 3, 4, 5} - set(want))
    formula = m.cmp("v", op, "id * 0 + 2")
    assert ids(m.filter_rows(nulls, formula)) == want
    assert ids(m.filter_rows(nulls, formula, "drop")) == sorted({1, 2, 3, 4, 5} - set(want))


def test_other_predicates(nulls):
    assert ids(m.filter_rows(nulls, m.isin("g", ["a", None]))) == [1, 2, 4]
    assert ids(m.filter_rows(nulls, m.not_in("g", ["a"]))) == [2, 3, 5]
    assert ids(m.filter_rows(nulls, m.is_missing("v"))) == [3, 4]
    assert ids(m.filter_rows(nulls, m.between("v", None, 2))) == [1, 2]
    assert ids(m.filter_rows(nulls, ~m.contains("g", "A"))) == [2, 3, 5]
    assert ids(m.filter_rows(nulls, m.chain(m.cmp("id", "==", 1), ("or", m.cmp("id", "==", 2)), ("and", m.is_present("g"))))) == [1]
    assert m.predicates_for(nulls.schema["g"])[0] == "isin"


def test_conditions_have_words():
    assert (m.cmp("a", ">", 1) & m.is_missing("b")).text == "(a > 1) and (b is missing)"


def test_empty_sums_and_products(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0)], "g string, v double")
    got = {r["g"]: (r["s"], r["p"], r["all"], r["any"]) for r in m.group_agg(
        df, "g", {"s": ("v", "sum"), "p": ("v", "prod"), "all": ("v", "all"), "any": ("v", "any")}).collect()}
    assert got == {"a": (0.0, 1.0, True, False), "b": (2.0, 2.0, True, True)}


def test_skew_is_bias_corrected(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 4.0, 9.0)] + [("b", 1.0), ("b", 2.0)] + [("c", 3.0)] * 3, "g string, v double")
    got = {r["g"]: r["v_skew"] for r in m.group_agg(df, "g", [("skew", ["v"])]).collect()}
    assert got["a"] == pytest.approx(1.3309, abs=1e-4) and got["b"] is None and got["c"] == 0


def test_nan_counts_as_missing(nulls):
    row = m.group_agg(nulls, [], {"n": ("v", "count"), "mean": ("v", "mean"), "max": ("v", "max"), "u": ("v", "nunique"), "md": ("v", "median")}).first()
    assert tuple(row) == (3, pytest.approx(8 / 3), 5.0, 3, 2.0)
    assert ids(m.drop_missing_rows(nulls, ["v"])) == [1, 2, 5]
    filled = {r["id"]: r["v"] for r in m.fill_missing(nulls, "v", 0).collect()}
    assert filled == {1: 1.0, 2: 2.0, 3: 0.0, 4: 0.0, 5: 5.0}
    assert m.drop_missing_columns(nulls, "any").columns == ["id"]


def test_mode_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([(1, 5), (2, 3), (3, 5), (4, 3), (5, None)], "id int, v int")
    assert {r["v"] for r in m.fill_missing(df, "v", how="mode").where("id = 5").collect()} == {3}


def test_aggregates_that_follow_order(spark):
    df = spark.createDataFrame([(3, "x", None), (1, "x", 7), (2, "x", 7), (4, "x", 2), (5, "x", 2)], "id int, g string, v int")
    spec = {"f": ("v", "first"), "l": ("v", "last"), "hi": ("v", "idxmax"), "lo": ("v", "idxmin")}
    assert tuple(m.group_agg(df, "g", spec, order_by=["id"], label="id").first())[1:] == (7, 2, 1, 4)
    named = df.withColumn("name", F.concat(F.lit("n"), "id"))
    assert m.group_agg(named, "g", {"hi": ("v", "idxmax")}, order_by=["name"], label="id").first()["hi"] == 1
    with pytest.raises(ValueError, match="label"):
        m.group_agg(df, "g", {"hi": ("v", "idxmax")}, order_by=["id"])
    with pytest.raises(ValueError, match="order_by"):
        m.group_agg(df, "g", {"f": ("v", "first")})


def test_text_order_can_be_reversed(spark):
    words = ["", "a", "ab", "abc", "b", "ba", "z", "é"]
    df = spark.createDataFrame([(w, 1) for w in words], "w string, one int")
    assert m.group_agg(df, [], {"first": ("one", "idxmax")}, order_by=["w"], label="w").first()["first"] == ""


@pytest.mark.parametrize("target,want", [
    ("int64", [1, 1, None, None, None]), ("float64", [1.0, 1.7, None, None, None]), ("bool", [True, True, True, False, None]),
    ("category", ["1", "1.7", "abc", "", None]),
])
def test_casts_of_texts(spark, target, want):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(["1", "1.7", "abc", "", None])], "i int, s string")
    assert [r["s"] for r in m.cast_column(df, "s", target).orderBy("i").collect()] == want


def test_strict_casts_raise(spark):
    df = spark.createDataFrame([("abc",)], "s string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|malformed|cannot be cast"):
        m.cast_column(df, "s", "int32").collect()
    assert m.cast_column(df, "s", "int32", errors="coerce").first()["s"] is None
    with pytest.raises(Exception, match="cannot read a date"):
        m.cast_column(df, "s", "datetime").collect()


def test_big_integers_stay_exact(spark):
    df = spark.createDataFrame([("9007199254740993",), ("18446744073709551615",)], "s string")
    assert m.cast_column(df, "s", "int64").first()["s"] == 9007199254740993
    assert [int(r["s"]) for r in m.cast_column(df, "s", "uint64").collect()] == [9007199254740993, 18446744073709551615]


@pytest.mark.parametrize("text,seconds", [
    ("1 days 02:03:04", 93784), ("02:03:04.5", 7384.5), ("-1 days", -86400), ("5 min", 300), ("3h 20s", 10820), ("nonsense", None),
])
def test_durations(spark, text, seconds):
    df = spark.createDataFrame([(text,)], "s string")
    got = m.cast_column(df, "s", "timedelta", errors="coerce").first()["s"]
    assert (got.total_seconds() if got is not None else None) == seconds


def test_date_formats(spark):
    assert java_pattern("%d/%m/%Y at %H:%M") == "dd/MM/yyyy 'at' HH:mm"
    df = spark.createDataFrame([("2024-02-29",), ("02/29/2024",), ("2024-02-29 10:11:12.5",), ("29.02.2024",), ("x",)], "s string")
    got = [r["s"] for r in m.cast_column(df, "s", "datetime", errors="coerce").collect()]
    assert [g and g.strftime("%m%d") for g in got] == ["0229"] * 4 + [None]


@pytest.mark.parametrize("name,want", [("MeanAge", "mean_age"), (" Total - Sum (USD) ", "total_sum_usd"), ("HTTPCode", "http_code"), ("a.b;c", "abc")])
def test_clean_names(name, want):
    assert clean_name(name) == want


def test_unique_names_and_types():
    assert unique_names(["a", "a", 1, "a"]) == ["a", "a_1", "1", "a_2"]
    assert common_type([T.IntegerType(), T.LongType()]) == T.LongType()
    assert common_type([T.LongType(), T.StringType()]) == T.StringType()
    assert common_type([T.NullType(), T.DateType(), T.TimestampType()]) == T.TimestampType()


def test_text_operators(spark):
    texts = ["  o'neil-smith 2nd\t", "éCOLE", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")

    def run(fn, *args, **kw):
        return [r["s"] for r in fn(df, "s", *args, **kw).orderBy("i").collect()]

    assert run(m.title)[0] == "  O'Neil-Smith 2Nd\t"
    assert run(m.capitalize)[1:] == ["École", "", None]
    assert run(m.strip)[0] == "o'neil-smith 2nd"
    for start, stop in ((None, None), (2, None), (None, 3), (-4, None), (None, -3), (1, -1), (-50, 2), (5, 2), (3, 99)):
        assert run(m.slice_text, start, stop) == [None if t is None else t[start:stop] for t in texts]
    assert run(m.replace_text, "(o)'(n)", r"\2$\1", regex=True)[0] == "  n$oeil-smith 2nd\t"
    assert run(m.replace_text, "(o)'(n)", r"\g<2>0\\7\1", regex=True)[0] == "  n0\\7oeil-smith 2nd\t"
    assert run(m.replace_text, "(?<first>o)'", r"\g<first>\n5$1\q", regex=True)[0] == "  o\n5$1\\qneil-smith 2nd\t"
    tens = "".join(f"({c})" for c in "o'neil-smi")
    assert run(m.replace_text, tens, r"\10\1", regex=True)[0] == "  ioth 2nd\t"


def test_split_renames_clashes(spark):
    df = spark.createDataFrame([("a.b.c", 1), ("d", 2), (None, 3)], "s string, s_1 int")
    out = m.split_text(df, "s", ".")
    assert out.columns == ["s", "s_1_x", "s_0", "s_1_y", "s_2"]
    assert [tuple(r)[2:] for r in out.orderBy("s_1_x").collect()] == [("a", "b", "c"), ("d", None, None), (None, None, None)]


@pytest.mark.parametrize("separator", [r"\E", r"\Q", ".*", "a|b", "[", "\n", "- #", "é", "$1"])
def test_split_takes_a_separator_as_it_is(spark, separator):
    texts = [f"x{separator}y{separator}{separator}z", "none", ""]
    out = m.split_text(spark.createDataFrame([(t,) for t in texts], "s string"), "s", separator, n_parts=4)
    assert {r[0]: [x for x in r[1:] if x is not None] for r in out.collect()} == {t: t.split(separator) for t in texts}


def test_readers_leave_the_session_as_it_is(spark, tmp_path):
    spark.range(3).write.csv(str(tmp_path / "t"), header=True)
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert m.read_csv(spark, str(tmp_path / "t")).count() == 3
        assert spark.conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
    finally:
        m.pin(spark)


def test_values(spark):
    df = spark.createDataFrame([(1, "a", True, 1.0), (2, "1", False, NAN)], "i int, s string, b boolean, f double")
    one = [tuple(r) for r in m.replace_value(df, 1, 9).orderBy("i").collect()]
    assert one[0] == (9, "a", True, 9.0) or one[1] == (9, "a", True, 9.0)
    assert m.replace_value(df, None, 0).where("i = 2").first()["f"] == 0.0
    mixed = m.set_values(df, "i", m.is_true("b"), "yes")
    assert {r["i"] for r in mixed.collect()} == {"yes", "2"}
    swapped = m.set_values(df, "s", m.cmp("i", "==", 1), F.col("f"), otherwise=None)
    assert [r["s"] for r in swapped.orderBy("i").collect()] == [1.0, None]


def test_duplicates_keep_rows_whole(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 5), (3, None, 1), (4, None, None)], "i int, k string, v int")
    first = {r["k"]: (r["i"], r["v"]) for r in m.drop_duplicates(df, ["k"], order_by=["i"]).collect()}
    assert first == {"a": (1, None), None: (3, 1)}
    last = {r["k"]: (r["i"], r["v"]) for r in m.drop_duplicates(df, ["k"], "last", order_by=["v", "i"]).collect()}
    assert last == {"a": (1, None), None: (4, None)}  # a missing order value comes last


def test_math_of_percentage_change(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 0.0), (4, 0.0), (5, 3.0), (6, 6.0)], "i int, v double")
    got = [r["v_pct_change"] for r in m.pct_change(df, "v", order_by=["i"]).orderBy("i").collect()]
    assert got[0] is None and got[1:3] == [0.0, -1.0] and got[3] is None and math.isinf(got[4]) and got[5] == 1.0


def test_cumulative_skips_missing(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "a", None), (3, "a", 4.0), (4, None, 9.0)], "i int, g string, v double")
    got = [r["v_cumsum"] for r in m.cumulative_sum(df, "v", order_by=["i"], by="g").orderBy("i").collect()]
    assert got == [2.0, None, 6.0, None]
    assert m.cumulative_product(df, "v", order_by=["i"]).where("i = 4").first()["v_cumprod"] == 72.0


def test_one_hot_sums_to_one(nulls):
    out = m.one_hot(nulls, ["g"], dummy_na=True)
    assert out.columns == ["id", "v", "g_a", "g_b", "g_nan"]
    assert {r["g_a"] + r["g_b"] + r["g_nan"] for r in out.collect()} == {1}
    with pytest.raises(ValueError, match="categories"):
        m.one_hot(nulls, ["id"], max_categories=2)


def test_melt_then_pivot_is_identity(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, None, 5.0)], "id int, a double, b double")
    back = m.pivot_wide(m.melt(df, "id"), "variable", "value")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_pivot_wide_refuses_duplicates(spark):
    df = spark.createDataFrame([(1, "a", 2), (1, "a", 3)], "id int, k string, v int")
    with pytest.raises(Exception, match="several values"):
        m.pivot_wide(df, "k", "v").collect()


def test_explode_keeps_empty_lists(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "id int, v array<int>")
    assert sorted((r["id"], r["v"] or 0) for r in m.explode_rows(df, "v").collect()) == [(1, 1), (1, 2), (2, 0), (3, 0)]


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0)], ["a.id", "my key", "v.1"])
    assert m.group_agg(df, "my key", [(["sum", "median"], ["v.1"])]).columns == ["my key", "v.1_sum", "v.1_median"]
    assert m.filter_rows(df, m.cmp("a.id", ">", 1)).count() == 1
    assert m.cumulative_sum(df, "v.1", order_by=["a.id"]).count() == 2
    assert m.pivot_table(df, "a.id", "my key", "v.1", "sum").columns == ["a.id", "a", "b"]
