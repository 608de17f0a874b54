"""The stream form of period aggregation: fixed-length windows under a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from millrace.contract import quoted
from millrace.functions.aggregates import plain

LENGTHS = {"D": "day", "H": "hour", "min": "minute", "S": "second", "ms": "millisecond"}
# functions Spark can update as rows arrive
LIVE = ("size", "count", "sum", "mean", "min", "max", "std", "var", "sem", "prod")


def resample_stream(
    stream: DataFrame,
    ts: str,
    spec: dict[str, tuple[str | None, str]],
    every: int = 1,
    unit: str = "H",
    by: Sequence[str] = (),
    late: str = "1 hour",
) -> DataFrame:
    """Aggregate a stream (or a table) per ``every`` units; rows later than ``late`` are ignored."""
    if unit not in LENGTHS:
        raise ValueError(f"a stream needs a unit of fixed length: {sorted(LENGTHS)}")
    unsupported = [fn for _, fn in spec.values() if fn not in LIVE]
    if unsupported:
        raise ValueError(f"not available on a stream: {unsupported}; use one of {LIVE}")
    rows = stream.withWatermark(ts, late) if stream.isStreaming else stream
    window = F.window(quoted(ts), f"{every} {LENGTHS[unit]}")
    counted = rows.groupBy(window.alias("__w"), *[quoted(b) for b in by]).agg(
        *[plain(stream, column, fn).alias(out) for out, (column, fn) in spec.items()]
    )
    return counted.select(*[quoted(b) for b in by], F.col("__w.start").alias(ts), *[quoted(o) for o in spec])
