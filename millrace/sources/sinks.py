"""Tables out: files, catalog tables and named views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

# fixed values: characters a catalog name may consist of
_NAME = re.compile(r"[A-Za-z0-9_]+")


def write_csv(df: DataFrame, path: str, mode: str = "error", sep: str = ",") -> None:
    """A directory of part files, each with a header."""
    df.write.option("header", True).option("sep", sep).mode(mode).csv(path)


def checked_name(name: str, what: str) -> str:
    if not name or not _NAME.fullmatch(name):
        raise ValueError(f"a {what} name may only hold letters, digits and underscores: {name!r}")
    return name


def write_table(
    df: DataFrame,
    table: str,
    database: str | None = None,
    overwrite: bool = False,
    merge_schema: bool = False,
    overwrite_schema: bool = False,
    format: str | None = None,
) -> str:
    """Save as a catalog table; an existing one is an error unless ``overwrite``. Returns its name."""
    name = checked_name(table, "table")
    if database:
        name = f"{checked_name(database, 'database')}.{name}"
    writer = df.write.mode("overwrite" if overwrite else "error")
    if format:
        writer = writer.format(format)
    if merge_schema:
        writer = writer.option("mergeSchema", "true")
    if overwrite_schema:
        writer = writer.option("overwriteSchema", "true")
    writer.saveAsTable(name)
    return name


def register(df: DataFrame, name: str, cache: bool = False) -> DataFrame:
    """Keep a table under a name; DataFrames never change, so the copy is free."""
    kept = df.cache() if cache else df
    kept.createOrReplaceTempView(checked_name(name, "view"))
    return kept
