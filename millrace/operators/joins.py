"""Equi-joins with missing keys matching each other and clashing names getting suffixes.

Adaptive execution can split a hot key on both sides of an inner join, but only on the kept side of
an outer join. An outer join whose other side holds a hot key is therefore built as an inner join
plus the unmatched rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from millrace.contract import all_true, as_list, clean, common_type, dtype, need_batch, need_columns, quoted, same
from millrace.selectors import resolve

HOT_KEY = "millrace.hotKeyRows"
HOT_ROWS = 1_000_000
# values whose counts a summary keeps: at first, and the most that Spark allows
TRACKED = 65_536
MOST_TRACKED = 1_000_000
MERGED_BY = 256


def common_keys(left: DataFrame, right: DataFrame) -> list[str]:
    """Columns that carry the same name on both sides."""
    return [c for c in left.columns if c in right.columns]


def key_pairs(on) -> list[tuple[str, str]]:
    items = [on] if isinstance(on, (str, tuple)) else as_list(on)
    return [(i, i) if isinstance(i, str) else (i[0], i[1]) for i in items]


def _heaviest(hashes: DataFrame, tracked: int, limit: int) -> tuple[int, int, int]:
    """Rows, rows of the most frequent value as summaries count them, and by how much that may be too low.

    Each task counts at most ``tracked`` values and forgets the rarest; the summaries of the tasks are
    merged in groups, and the counts of what is frequent in a group are added up. So summaries are
    shuffled, and never the rows.
    """
    small = limit // (10 * MERGED_BY)
    parts = hashes.groupBy((F.spark_partition_id() % MERGED_BY).alias("part")).agg(
        F.expr(f"approx_top_k(__h, {tracked}, {tracked})").alias("top"), F.count(F.lit(1)).alias("n")
    )
    kept = F.filter("top", lambda x: x["count"] > small)
    # an entry without a value carries the rows of its group
    entries = parts.select(F.explode(F.concat(F.array(F.struct(F.lit(None).cast("long").alias("item"), F.col("n").alias("count"))), kept)).alias("x"))
    sums = entries.groupBy("x.item").agg(F.sum("x.count").alias("n"))
    rows, top = sums.agg(F.sum(F.when(F.col("item").isNull(), F.col("n"))), F.max(F.when(F.col("item").isNotNull(), F.col("n")))).first()
    rows = rows or 0
    return rows, top or 0, MERGED_BY * small + (6 * rows // tracked if rows > tracked else 0)


def has_hot_key(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether one key has too many rows to be read by a single task.

    Summaries of frequent items tell, and never miss such a key; of the keys a little below the limit
    (a tenth for small tables, a fifth for large ones) they may take one for hot, which costs the split
    form of the join and changes no result. Only where the finest summary is too coarse are the rows of
    all keys counted.
    """
    limit = int(df.sparkSession.conf.get(HOT_KEY, str(HOT_ROWS)))
    hashes = df.select(F.xxhash64(*[clean(df, k) for k in keys]).alias("__h"))
    tracked = TRACKED
    while True:
        rows, top, missed = _heaviest(hashes, tracked, limit)
        if rows <= limit or 5 * missed <= limit:
            return rows > limit and top + missed > limit
        finer = 60 * rows // max(limit, 1) + 1
        if finer <= tracked or finer > MOST_TRACKED:
            break
        tracked = finer
    counts = hashes.groupBy("__h").agg(F.count(F.lit(1)).alias("n"))
    return (counts.agg(F.max("n")).first()[0] or 0) > limit


def join(
    left: DataFrame,
    right: DataFrame,
    on,
    how: str = "inner",
    suffixes: tuple[str, str] = ("_x", "_y"),
    null_safe: bool = True,
    right_columns=None,
    right_drop=None,
    hot: str = "check",
) -> DataFrame:
    """Join on ``"key"`` or ``("left_key", "right_key")`` entries: inner, left, right or outer.

    Keys with the same name appear once. ``right_columns`` keeps only some right columns (keys are
    added), ``right_drop`` drops some (never keys). ``hot`` says how outer joins treat keys with
    very many rows: ``check`` looks, ``split`` always builds the split form, ``ignore`` never does.
    """
    if how not in ("inner", "left", "right", "outer"):
        raise ValueError(f"unknown join {how!r}")
    pairs = key_pairs(on)
    if not pairs:
        raise ValueError("a join needs at least one key")
    need_columns(left, [a for a, _ in pairs])
    keys = need_columns(right, [b for _, b in pairs])
    if right_columns is not None and right_drop is not None:
        raise ValueError("pass right_columns or right_drop, not both")
    if right_columns is not None:
        wanted = set(resolve(right, right_columns)) | set(keys)
        right = right.select(*[quoted(c) for c in right.columns if c in wanted])
    elif right_drop is not None:
        gone = set(resolve(right, right_drop)) - set(keys)
        right = right.select(*[quoted(c) for c in right.columns if c not in gone])

    shared = {a for a, b in pairs if a == b}
    r_out = [c for c in right.columns if c not in shared]
    clash = set(left.columns) & set(r_out)
    l_names = {c: c + suffixes[0] if c in clash else c for c in left.columns}
    r_names = {c: c + suffixes[1] if c in clash else c for c in r_out}
    names = list(l_names.values()) + list(r_names.values())
    if len(set(names)) < len(names):
        raise ValueError(f"the joined table would repeat a column name: {names}")

    lp = {c: f"__l{i}" for i, c in enumerate(left.columns)}
    rp = {c: f"__r{i}" for i, c in enumerate(right.columns)}
    a = left.toDF(*lp.values())
    b = right.toDF(*rp.values())
    sides = []
    for x, y in pairs:
        kx, ky = dtype(left, x), dtype(right, y)
        kind = common_type([kx, ky])
        # NaN and NULL are one missing key
        cx, cy = clean(a, lp[x]), clean(b, rp[y])
        sides.append((cx if kx == kind else cx.cast(kind), cy if ky == kind else cy.cast(kind)))
    condition = all_true([same(x, y, null_safe) for x, y in sides])
    l_keys = [lp[x] for x, _ in pairs]
    r_keys = [rp[y] for _, y in pairs]

    def keys_of(frame: DataFrame, names: list[str]) -> DataFrame:
        # one row per key, so that the unmatched side never meets a hot key
        return frame.groupBy(*[F.col(n) for n in names]).agg(F.lit(1).alias("__one"))

    def shape(frame: DataFrame) -> DataFrame:
        out: list[Column] = []
        have = set(frame.columns)
        for c in left.columns:
            mine = F.col(lp[c]) if lp[c] in have else F.lit(None).cast(dtype(left, c))
            if c in shared:
                other = next(y for x, y in pairs if x == c)
                other_c = F.col(rp[other]) if rp[other] in have else F.lit(None)
                mine = other_c if how == "right" else F.coalesce(mine, other_c) if how == "outer" else mine
            out.append(mine.alias(l_names[c]))
        for c in r_out:
            mine = F.col(rp[c]) if rp[c] in have else F.lit(None).cast(dtype(right, c))
            out.append(mine.alias(r_names[c]))
        return frame.select(*out)

    if how != "inner":
        need_batch(left, "an outer join")
        need_batch(right, "an outer join")
    split = hot == "split"
    if hot == "check":
        split = (how in ("left", "outer") and has_hot_key(b, r_keys)) or (
            how in ("right", "outer") and has_hot_key(a, l_keys)
        )
    if how == "inner" or not split:
        return shape(a.join(b, condition, "full" if how == "outer" else how))
    result = shape(a.join(b, condition, "inner"))
    if how in ("left", "outer"):
        result = result.unionAll(shape(a.join(keys_of(b, r_keys), condition, "left_anti")))
    if how in ("right", "outer"):
        result = result.unionAll(shape(b.join(keys_of(a, l_keys), condition, "left_anti")))
    return result
