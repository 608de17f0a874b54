"""Tables in: files, catalog tables and registered loaders."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from millrace.contract import as_list, need_order, quoted
from millrace.operators.rows import SEED, sample_rows, sort_rows

_SOURCES: dict[str, Callable[..., DataFrame]] = {}


def _limited(df: DataFrame, limit: int | None) -> DataFrame:
    return df.limit(limit) if limit is not None and limit > 0 else df


def read_parquet(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    return _limited(spark.read.parquet(path), limit)


def read_csv(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    decimal: str = ".",
    limit: int | None = None,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """A delimited file with a header. Types are inferred in one extra pass unless ``schema`` is given.

    With another decimal mark than a point, text columns made of such numbers only become doubles.
    """
    reader = spark.read.option("header", True).option("sep", sep)
    if schema is not None and decimal == ".":
        return _limited(reader.schema(schema).csv(path), limit)
    df = reader.option("inferSchema", True).csv(path)
    if decimal != ".":
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if wanted is not None:
            raw = reader.option("inferSchema", False).csv(path)
            df = raw.select(
                *[
                    (_number(f.name, decimal) if isinstance(f.dataType, T.NumericType) else quoted(f.name))
                    .cast(f.dataType)
                    .alias(f.name)
                    for f in wanted.fields
                ]
            )
        else:
            df = _decimals(df, decimal)
    return _limited(df, limit)


def _number(name: str, decimal: str):
    return F.replace(F.trim(quoted(name)), F.lit(decimal), F.lit("."))


def _decimals(df: DataFrame, decimal: str) -> DataFrame:
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    bad = df.agg(
        *[F.count_if(quoted(n).isNotNull() & _number(n, decimal).try_cast("double").isNull()).alias(n) for n in texts],
        *[F.count(quoted(n)).alias(f"__n_{n}") for n in texts],
    ).first()
    numbers = [n for n in texts if bad[n] == 0 and bad[f"__n_{n}"] > 0]
    return df.withColumns({n: _number(n, decimal).try_cast("double") for n in numbers}) if numbers else df


def read_table(
    spark: SparkSession,
    name: str,
    mode: str = "first",
    n: int | None = None,
    order_by: Sequence[str] | None = None,
    seed: int = SEED,
    by: Sequence[str] = (),
) -> DataFrame:
    """A catalog table (``table``, ``database.table`` or ``catalog.database.table``).

    ``n`` limits it to the first rows, a random sample (see ``sample_rows`` for ``by``), or the last rows in ``order_by``.
    """
    df = spark.table(name)
    if n is None or n <= 0:
        return df
    if mode == "first":
        return df.limit(n)
    if mode == "random":
        return sample_rows(df, n, seed, by)
    if mode == "last":
        names = need_order(df, order_by, "reading the last rows")
        return sort_rows(df, [(c, "desc") for c in as_list(names)]).limit(n)
    raise ValueError(f"mode is 'first', 'random' or 'last', not {mode!r}")


def list_catalogs(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW CATALOGS")


def list_databases(spark: SparkSession, catalog: str | None = None) -> DataFrame:
    return spark.sql(f"SHOW DATABASES IN `{catalog}`" if catalog else "SHOW DATABASES")


def list_tables(spark: SparkSession, catalog: str | None = None, database: str | None = None) -> DataFrame:
    """Names of the tables and views of a database (by default the current one)."""
    place = ".".join(f"`{p}`" for p in (catalog, database) if p)
    return spark.sql(f"SHOW TABLES IN {place}" if place else "SHOW TABLES")


def register_source(name: str) -> Callable:
    """Decorator: make a function returning a DataFrame available to ``load``."""

    def keep(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _SOURCES[name] = fn
        return fn

    return keep


def load(name: str, spark: SparkSession, **options) -> DataFrame:
    if name not in _SOURCES:
        raise ValueError(f"no source {name!r}; known: {sorted(_SOURCES)}")
    return _SOURCES[name](spark, **options)


register_source("parquet")(read_parquet)
register_source("csv")(read_csv)
register_source("table")(read_table)
