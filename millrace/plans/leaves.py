"""Trees of single columns on one slice of rows: leaves, what folds are told by the others, errors.

A slice holds all rows of its leaves (a leaf is one feature with one value), for all targets at once. Leaves
with very many rows are worked out elsewhere; of them a slice has one marker, as their guesses may be the
nearest ones of other leaves. What depends on leaves of other slices is left open: the rows come out with the
nearest guesses within the slice, and every slice tells its first and last guess.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

FOLDS = 4
#: ``kind`` is sum, edge or open. An edge's ``lo`` is the last guess of its slice, ``hi`` the first one.
FIELDS = {
    "kind": pa.string(), "f": pa.int32(), "t": pa.int32(), "k": pa.int32(), "at": pa.int32(), "h": pa.int32(), "x": pa.float64(), "y": pa.float64(), "c": pa.string(),
    "n": pa.int64(), "err": pa.float64(), "own": pa.int64(), "said": pa.int64(), "hit": pa.int64(),
    "lo_x": pa.float64(), "lo_p": pa.float64(), "lo_c": pa.string(), "hi_x": pa.float64(), "hi_p": pa.float64(), "hi_c": pa.string(),
}
SCHEMA = ", ".join(f"{n} {({'string': 'string', 'int32': 'int', 'int64': 'bigint', 'double': 'double'})[str(t)]}" for n, t in FIELDS.items())


def _batch(size: int, **columns) -> pa.RecordBatch:
    """Rows of the columns that are given; a number fills all of its column, and an array may be a pair (values, known)."""
    made = []
    for name, kind in FIELDS.items():
        v = columns.get(name)
        if v is None:
            made.append(pa.nulls(size, kind))
        elif isinstance(v, tuple):
            made.append(pa.array(v[0], kind, mask=~v[1]))
        elif isinstance(v, (np.ndarray, list)):
            made.append(pa.array(v, kind))
        else:
            made.append(pa.array([v] * size, kind))
    return pa.RecordBatch.from_arrays(made, list(FIELDS))


class Guesses:
    """What the rows of each leaf and fold are told: ``p`` where ``known``; ``need`` says where rows ask for it."""

    def __init__(self, p: np.ndarray, known: np.ndarray, need: np.ndarray):
        self.p, self.known, self.need = p, known, need
        self.open = np.zeros_like(known)
        self.lo, self.hi = np.full(p.shape, -1), np.full(p.shape, -1)
        self.told = known.copy()  # also by neighbours

    def nearest(self, x: np.ndarray, marked: np.ndarray) -> None:
        """Fill what is needed from the nearest leaf that knows; what other slices may know better stays open."""
        place, out = np.arange(len(x)), self.p.copy()
        for k in range(FOLDS):
            if not (ask := np.nonzero(self.need[:, k])[0]).size:
                continue
            known = self.known[:, k]
            lo = np.maximum.accumulate(np.where(known, place, -1))[ask]
            hi = np.minimum.accumulate(np.where(known, place, len(x))[::-1])[::-1][ask]
            self.lo[ask, k], self.hi[ask, k] = lo, np.where(hi < len(x), hi, -1)
            inside = (lo >= 0) & (hi < len(x)) & ~marked[ask]
            a, l, h = ask[inside], lo[inside], hi[inside]
            out[a, k] = np.where(x[a] - x[l] <= x[h] - x[a], self.p[l, k], self.p[h, k])
            self.told[a, k] = True
            self.open[ask[~inside], k] = True
        self.before, self.p = self.p, out

    def near(self, side: str, leaf: np.ndarray, k: np.ndarray, x: np.ndarray, labels) -> dict:
        """The columns of the nearest known guess on one side."""
        at = (self.lo if side == "lo" else self.hi)[leaf, k]
        has = at >= 0
        p = self.before[np.maximum(at, 0), k]
        return {f"{side}_x": (x[np.maximum(at, 0)], has), **_told(side, p, has, labels)}


def _told(side: str, p: np.ndarray, has: np.ndarray, labels) -> dict:
    if labels is None:
        return {f"{side}_p": (p, has)}
    return {f"{side}_c": [labels[int(v)] if ok else None for v, ok in zip(p, has)]}


def _edges(g: Guesses, x: np.ndarray, labels, where: dict) -> Iterator[pa.RecordBatch]:
    for k in range(FOLDS):
        at = np.nonzero(g.known[:, k])[0]
        if at.size:
            one, yes = at[[0]], np.array([True])
            last = at[[-1]]
            yield _batch(1, kind="edge", k=k, lo_x=x[last], hi_x=x[one], **_told("lo", g.before[last, k], yes, labels), **_told("hi", g.before[one, k], yes, labels), **where)


def _asks(g: Guesses, x: np.ndarray, labels, h: np.ndarray, where: dict) -> Iterator[pa.RecordBatch]:
    """What leaves with markers ask."""
    leaf, k = np.nonzero(g.open & (h >= 0)[:, None])
    if leaf.size:
        yield _batch(leaf.size, kind="open", k=k, x=x[leaf], h=h[leaf], **g.near("lo", leaf, k, x, labels), **g.near("hi", leaf, k, x, labels), **where)


def slice_work(numeric: dict[int, bool], numbers: dict[int, list[int]], classes: dict[int, list[int]], whole: dict, hot: dict) -> Callable:
    """The function for ``mapInArrow``. ``numbers`` and ``classes`` list the targets of each feature; ``whole`` has the guesses
    by (feature, target) of texts without their own, ``hot`` by (leaf, target) the guesses and the needs of leaves with markers."""

    def features(table: pa.Table) -> Iterator[pa.RecordBatch]:
        at, f_all = TaskContext.get().partitionId(), table["f"].to_numpy()
        for f in map(int, np.unique(f_all)):
            own = table.filter(pa.array(f_all == f)).combine_chunks()
            if numeric[f]:
                x = own["xn"].to_numpy()
            else:
                x = pc.index_in(own["xt"], value_set=pc.unique(own["xt"])).to_numpy()
            order = np.argsort(x, kind="stable")
            ranked = x[order]
            new = np.r_[True, ranked[1:] != ranked[:-1]]
            leaf = np.empty(len(x), np.int64)
            leaf[order] = np.cumsum(new) - 1
            points = ranked[new]
            h = np.full(len(points), -1)
            marks = own["h"].fill_null(-1).to_numpy()
            h[leaf[marks >= 0]] = marks[marks >= 0]
            rows = own.filter(pa.array(marks < 0))
            leaf = leaf[marks < 0]
            k = rows["k"].to_numpy().astype(np.int64)
            for t in numbers.get(f, ()):
                yield from regress(rows, leaf, k, points, h, {"f": f, "t": t, "at": at})
            for t in classes.get(f, ()):
                yield from classify(rows, leaf, k, points, h, {"f": f, "t": t, "at": at})

    def settle(g: Guesses, points: np.ndarray, h: np.ndarray, code, f: int, t: int) -> Guesses:
        for leaf in np.nonzero(h >= 0)[0]:
            told, need = hot[int(h[leaf]), t]
            for k in range(FOLDS):
                g.known[leaf, k] = told[k] is not None
                g.p[leaf, k] = 0 if told[k] is None else code(told[k])
                g.need[leaf, k] = need[k]
        g.told = g.known.copy()
        if numeric[f]:
            g.nearest(points, h >= 0)
        else:
            g.before = g.p
            for k in range(FOLDS):
                if whole[f, t][k] is not None:
                    g.p[~g.known[:, k], k] = code(whole[f, t][k])
                    g.told[:, k] = True
        return g

    def regress(rows, leaf, k, points, h, where):
        f, t = where["f"], where["t"]
        has = rows[f"y{t}"].is_valid().to_numpy()
        y, leaf, k = rows[f"y{t}"].to_numpy()[has], leaf[has], k[has]
        size = FOLDS * len(points)
        n = np.bincount(leaf * FOLDS + k, minlength=size).reshape(-1, FOLDS)
        s = np.bincount(leaf * FOLDS + k, weights=y, minlength=size).reshape(-1, FOLDS)
        outside = n.sum(1, keepdims=True) - n
        sums = np.stack([s[:, [j for j in range(FOLDS) if j != i]].sum(1) for i in range(FOLDS)], 1)
        g = settle(Guesses(sums / np.maximum(outside, 1), outside > 0, (n > 0) & (outside == 0)), points, h, float, f, t)
        told = g.told[leaf, k]
        count = np.bincount(k[told], minlength=FOLDS)
        err = np.bincount(k[told], weights=np.abs(y[told] - g.p[leaf, k][told]), minlength=FOLDS)
        yield _batch(FOLDS, kind="sum", k=np.arange(FOLDS), n=count, err=err, **where)
        if numeric[f]:
            yield from _edges(g, points, None, where)
            yield from _asks(g, points, None, h, where)
            i = g.open[leaf, k]
            if i.any():
                a, b = leaf[i], k[i]
                yield _batch(len(a), kind="open", k=b, x=points[a], y=y[i], n=1, **g.near("lo", a, b, points, None), **g.near("hi", a, b, points, None), **where)

    def classify(rows, leaf, k, points, h, where):
        f, t = where["f"], where["t"]
        has = rows[f"l{t}"].is_valid().to_numpy()
        named, leaf, k = rows[f"l{t}"].filter(pa.array(has)), leaf[has], k[has]
        there = pc.unique(named).to_pylist()
        hints = {v for i in h[h >= 0] for v in hot[int(i), t][0]} | set(() if numeric[f] else whole[f, t])
        labels = sorted({*there, *hints} - {None})
        code = {v: i for i, v in enumerate(labels)}
        said = pc.index_in(named, value_set=pa.array(labels, pa.string())).to_numpy().astype(np.int64) if labels else np.zeros(0, np.int64)
        cells, cell = np.unique(leaf * max(1, len(labels)) + said, return_inverse=True)
        n = np.bincount(cell * FOLDS + k, minlength=FOLDS * len(cells)).reshape(-1, FOLDS)
        at, label = cells // max(1, len(labels)), cells % max(1, len(labels))
        p, known, rows_in = np.zeros((len(points), FOLDS), np.int64), np.zeros((len(points), FOLDS), bool), np.zeros((len(points), FOLDS), np.int64)
        np.add.at(rows_in, at, n)
        for i in range(FOLDS):
            outside = n.sum(1) - n[:, i]
            some = np.nonzero(outside)[0]
            order = some[np.lexsort((label[some], -outside[some], at[some]))]
            first = order[np.r_[True, at[order][1:] != at[order][:-1]]] if order.size else order
            p[at[first], i], known[at[first], i] = label[first], True
        g = settle(Guesses(p, known, (rows_in > 0) & ~known), points, h, code.__getitem__, f, t)
        for i in range(FOLDS):
            use = (n[:, i] > 0) & g.told[at, i]
            if use.any():
                guess, of, m = g.p[at[use], i], label[use], n[use, i]
                add = lambda places, weights: np.bincount(places, weights=weights, minlength=len(labels)).astype(np.int64)
                own, told, hit = add(of, m), add(guess, m), add(of, m * (of == guess))
                some = np.nonzero(own + told)[0]
                yield _batch(some.size, kind="sum", k=i, c=[labels[j] for j in some], own=own[some], said=told[some], hit=hit[some], **where)
        if numeric[f]:
            yield from _edges(g, points, labels, where)
            yield from _asks(g, points, labels, h, where)
            i, b = np.nonzero((n > 0) & g.open[at])
            if i.size:
                a = at[i]
                yield _batch(i.size, kind="open", k=b, x=points[a], c=[labels[j] for j in label[i]], n=n[i, b], **g.near("lo", a, b, points, labels), **g.near("hi", a, b, points, labels), **where)

    def work(batches):
        batches = [b for b in batches if b.num_rows]
        if batches:
            yield from features(pa.Table.from_batches(batches))

    return work
