"""Reductions over pairs of points that never make the pairs as rows: counts, distributions, best partners, extremes.

Points are dealt out by frame and slab; a task holds one slab of the left points and the right points around it, sorts both
into small cells and works through cell after cell in arrays of a bounded size.  What leaves a task is its reduction alone.
Distances are worked out in the order of ``spatial.range_join``, so results are the same to the last bit.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import geometry as g

BLOCK = 12000  # pairs in one array: it stays in the cache, and its memory is used again
SLACK = 1 + 1e-9  # cells are that much wider than the reach, as differences of coordinates are rounded
PARTS = 4  # of each side of a frame in ``extreme``


def _slabs(length: float, reach: float) -> tuple[int, int]:
    """Slabs along an axis, and how many to each side are within reach; 0 slabs: no period."""
    if not length:
        return 0, 1
    n = int(length // (reach * SLACK))
    return (n, 1) if n >= 8 else (max(1, int(2 * length // (reach * SLACK))), 2)


def _dealt(left: DataFrame, right: DataFrame, reach: float, length: float, half: bool) -> tuple[DataFrame, DataFrame]:
    n, h = _slabs(length, reach)
    slab = F.least(F.floor(g.wrap(F.col("x"), length) / (length / n)), F.lit(n - 1)) if n else F.floor(F.col("x") / (reach * SLACK))
    offsets = range(-h, 1) if half else range(-h, h + 1) if not n or 2 * h + 1 < n else range(n)
    to = F.explode(F.array(*[F.lit(o) for o in offsets])).alias("_o")
    right = right.withColumn("_slab", slab).select("*", to)
    at = F.col("_slab") + F.col("_o")
    return left.withColumn("_slab", slab), right.withColumns({"_slab": F.pmod(at, F.lit(n)) if n else at, "_same": F.col("_o") == 0}).drop("_o")


def _own(df: DataFrame) -> DataFrame:
    """With columns of its own, where both sides are made of the same table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _array(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _xyz(t: pa.Table, names: str = "xyz", prefix: str = "") -> list[np.ndarray]:
    return [_array(t, prefix + c).astype(np.float64, copy=False) for c in names]


def _image(d: np.ndarray, length: float) -> np.ndarray:
    if length:
        k = d / length
        np.rint(k, out=k)
        k *= length
        d -= k
    return d


def blocks(left: list[np.ndarray], right: list[np.ndarray], reach: float, cell: Sequence[float]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of the left, rows of the right, d2 of each with each): all right points within reach of those left points, and more.

    Each left row comes once.
    """
    n, m = len(left[0]), len(right[0])
    if not n or not m:
        return
    # half the reach, or wider where so few points lie in a cell that their number is what takes time
    span = [length or max(np.ptp(a), reach) for a, length in zip(left, cell, strict=True)]
    parts = 2 if n * (reach / 2) ** 3 >= 4 * span[0] * span[1] * span[2] / max(1.0, span[0] / reach) else 1
    width = reach * SLACK / parts
    counts = [max(1, int(length // width)) if length else 0 for length in cell]

    def cells(points: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        for c, length, k in zip(points, cell, counts, strict=True):
            at = np.minimum(np.floor((c - length * np.floor(c / length)) / (length / k)), k - 1) if k else np.floor(c / width)
            out.append(np.nan_to_num(at).astype(np.int64))
        return out

    lc, rc = cells(left), cells(right)
    low = [0 if k else int(min(a.min(), b.min())) - parts for a, b, k in zip(lc, rc, counts, strict=True)]
    size = [k or int(max(a.max(), b.max())) - lo + parts + 1 for a, b, k, lo in zip(lc, rc, counts, low, strict=True)]
    key = lambda c: ((c[0] - low[0]) * size[1] + c[1] - low[1]) * size[2] + c[2] - low[2]
    rk = key(rc)
    r_order = np.argsort(rk, kind="stable")
    rk = rk[r_order]
    lk = key(lc)
    l_order = np.argsort(lk, kind="stable")
    keys, first = np.unique(lk[l_order], return_index=True)
    last = np.append(first[1:], n)
    x, y, z = keys // (size[1] * size[2]), keys // size[2] % size[1], keys % size[2]

    def around(k: int) -> range:
        return range(-parts, parts + 1) if not k or 2 * parts + 1 < k else range(k)

    starts, stops = [], []
    for ox, oy in itertools.product(around(counts[0]), around(counts[1])):
        column = ((x + ox) % size[0] * size[1] + (y + oy) % size[1]) * size[2]
        if counts[2] and 2 * parts + 1 >= counts[2]:
            runs = [(column, column + size[2])]
        elif counts[2]:
            a, b = z - parts, z + parts + 1
            runs = [(column + np.maximum(a, 0), column + np.minimum(b, size[2])), (column + np.where(a < 0, a + size[2], 0), column + np.where(a < 0, size[2], 0)), (column, column + np.maximum(b - size[2], 0))]
        else:
            runs = [(column + z - parts, column + z + parts + 1)]
        for a, b in runs:
            starts.append(np.searchsorted(rk, a))
            stops.append(np.searchsorted(rk, b))
    starts, stops = np.array(starts).T, np.array(stops).T
    sizes = stops - starts

    right = [c[r_order] for c in right]
    # where cells are many, the image is that of the cells, and a point's own period comes off
    near = [bool(length) and k >= 2 * parts + 2 for length, k in zip(cell, counts, strict=True)]
    l_turn, r_turn = ([np.floor(c / length) if fast else None for c, length, fast in zip(points, cell, near, strict=True)] for points in (left, right))
    for u in range(len(keys)):
        some = sizes[u] > 0
        if not some.any():
            continue
        b = _flat(starts[u][some], sizes[u][some])
        rows = l_order[first[u]:last[u]]
        theirs, at = [c[b] for c in right], r_order[b]
        turns = []
        for c, q, turn, length, k, fast in zip((x, y, z), theirs, r_turn, cell, counts, near, strict=True):
            if fast:
                own = turn[b]
                own += np.rint((q - length * own - (c[u] + 0.5) * (length / k)) / length)
                turns.append(own * length)
            else:
                turns.append(None)
        step = max(1, BLOCK // len(b))
        for k in range(0, len(rows), step):
            a = rows[k:k + step]
            d2 = None
            for p, q, length, turn, mine in zip(left, theirs, cell, turns, l_turn, strict=True):
                d = q[None, :] - p[a][:, None]
                if turn is None:
                    d = _image(d, length)
                else:
                    w = mine[a] * length
                    if (w == w[0]).all():
                        d -= turn - w[0]
                    else:
                        d -= turn[None, :] - w[:, None]
                d *= d
                d2 = d if d2 is None else np.add(d2, d, out=d2)
            yield a, at, d2


def _reduced(left: DataFrame, right: DataFrame, reach: float, cell: Sequence[float], schema: str, f: Callable[[pa.Table, pa.Table], dict], half: bool = False) -> DataFrame:
    """``f`` of the left and right points of each frame and slab, as columns for the schema without the frame."""
    a, b = map(_own, _dealt(left, right, reach, cell[0], half))
    kind = left.schema["frame"].dataType.simpleString()

    def run(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        out = f(x, y) if x.num_rows and y.num_rows else {}
        size = len(next(iter(out.values()))) if out else 0
        columns = {"frame": pa.array([key[0].as_py()] * size, key[0].type), **out}
        return pa.table(columns) if size else pa.table({c: pa.array([], t) for c, t in types.items()})

    names = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "smallint": pa.int16(), "tinyint": pa.int8()}
    full = f"frame {kind}, {schema}"
    types = {c.split()[0]: names[c.split()[1]] for c in full.split(", ")}
    return a.groupBy("frame", "_slab").cogroup(b.groupBy("frame", "_slab")).applyInArrow(run, full)


def _points(df: DataFrame, *more: str) -> DataFrame:
    return df.select("frame", F.col("atom_idx").cast("long").alias("atom_idx"), *[F.col(c).cast("double").alias(c) for c in "xyz"], *more).filter("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")


def _apart(x: pa.Table, y: pa.Table) -> tuple[np.ndarray, np.ndarray] | None:
    """The atoms of both sides, if any of them are the same."""
    i, j = _array(x, "atom_idx"), _array(y, "atom_idx")
    return (i, j) if len(np.intersect1d(i, j)) else None


def chosen(points: DataFrame, reach: float, cell: Sequence[float], more: Sequence[str], f: Callable[[np.ndarray, dict, dict], np.ndarray]) -> DataFrame:
    """(frame, i, j): pairs i < j of the same points within reach for which ``f`` of d2 and both sides' columns ``more`` holds; it treats both sides alike.

    Pairs leave a task as they are found, so it holds no more of them than a batch.
    """
    n, h = _slabs(cell[0], reach)
    half = not n or 2 * h + 1 <= n
    p = _points(points, *more)
    a, b = _dealt(p, p, reach, cell[0], half)
    both = _own(a.withColumns({"_same": F.lit(True), "_left": F.lit(True)})).unionByName(_own(b.withColumn("_left", F.lit(False))))
    names = pa.schema([("frame", pa.int64()), ("i", pa.int64()), ("j", pa.int64())])

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        x, y = (t.filter(m) for m in (t.column("_left"), pc.invert(t.column("_left"))))
        if not x.num_rows or not y.num_rows:
            return
        i, j = _array(x, "atom_idx"), _array(y, "atom_idx")
        sides = [{c: _array(side, c) for c in more} for side in (x, y)]
        after = np.where(_array(y, "_same"), j, np.iinfo(np.int64).max) if half else j  # of two slabs, one sees the other
        for rows, theirs, d2 in blocks(_xyz(x), _xyz(y), reach, cell):
            r, q = np.nonzero((d2 <= reach * reach) & (i[rows][:, None] < after[theirs][None, :]))
            d2, r, q = d2[r, q], rows[r], theirs[q]
            ok = f(d2, *[{c: v[k] for c, v in side.items()} for side, k in zip(sides, (r, q), strict=True)])
            r, q = i[r[ok]], j[q[ok]]
            if len(r):
                yield pa.record_batch([pa.array(np.full(len(r), key[0].as_py(), np.int64)), pa.array(np.minimum(r, q)), pa.array(np.maximum(r, q))], schema=names)

    return both.groupBy("frame", "_slab").applyInArrow(run, "frame bigint, i bigint, j bigint")


def count_pairs(points: DataFrame, cutoff: float, cell: Sequence[float]) -> DataFrame:
    """(frame, n): pairs i < j of the same points, no further apart than the cutoff."""
    n, h = _slabs(cell[0], cutoff)
    half = not n or 2 * h + 1 <= n

    def count(x: pa.Table, y: pa.Table) -> dict:
        i, j, found = _array(x, "atom_idx"), _array(y, "atom_idx"), 0
        if half:  # of two slabs, one sees the other
            j = np.where(_array(y, "_same"), j, np.iinfo(np.int64).max)
        for a, b, d2 in blocks(_xyz(x), _xyz(y), cutoff, cell):
            found += np.count_nonzero((d2 <= cutoff * cutoff) & (i[a][:, None] < j[b][None, :]))
        return {"n": pa.array([found], pa.int64())}

    p = _points(points)
    parts = _reduced(p, p, cutoff, cell, "n bigint", count, half)
    return parts.groupBy("frame").agg(F.sum("n").alias("n")).filter("n > 0")


def count_by_group(left: DataFrame, right: DataFrame, cutoff: float, cell: Sequence[float]) -> DataFrame:
    """(frame, group_id, n): pairs i <> j of each group's points on the left with those on the right; with ``group_id`` on the right, too, those of the same group."""
    own = "group_id" in right.columns
    kind = left.schema["group_id"].dataType.simpleString()

    def count(x: pa.Table, y: pa.Table) -> dict:
        coded = pa.concat_arrays([t.column("group_id").combine_chunks() for t in ((x, y) if own else (x,))]).dictionary_encode()
        of = coded.indices.to_numpy(zero_copy_only=False)
        of, theirs = of[:x.num_rows], of[x.num_rows:]
        shared, total = _apart(x, y), np.zeros(len(coded.dictionary), np.int64)
        for a, b, d2 in blocks(_xyz(x), _xyz(y), cutoff, cell):
            near = d2 <= cutoff * cutoff
            if shared:
                near &= shared[0][a][:, None] != shared[1][b][None, :]
            if own:
                near &= of[a][:, None] == theirs[b][None, :]
            np.add.at(total, of[a], np.count_nonzero(near, axis=1))
        return {"group_id": coded.dictionary, "n": pa.array(total)}

    parts = _reduced(_points(left, "group_id"), _points(right, *(["group_id"] if own else [])), cutoff, cell, f"group_id {kind}, n bigint", count)
    return parts.groupBy("frame", "group_id").agg(F.sum("n").alias("n")).filter("n > 0")


def histogram(left: DataFrame, right: DataFrame, cell: Sequence[float], start: float, high: float, width: float, bins: int) -> DataFrame:
    """(frame, bin, n): pairs i <> j by their distance, rounded to 9 places, from ``start`` up to ``high``; the last bin takes what is beyond it."""
    reach = high + 1e-8  # what is rounded down to the last distance counts

    def count(x: pa.Table, y: pa.Table) -> dict:
        shared, total = _apart(x, y), np.zeros(bins, np.int64)
        for a, b, d2 in blocks(_xyz(x), _xyz(y), reach, cell):
            near = d2 <= reach * reach
            if shared:
                near &= shared[0][a][:, None] != shared[1][b][None, :]
            d = d2[near]
            np.sqrt(d, out=d)
            d *= 1e9
            np.rint(d, out=d)
            d /= 1e9
            d = d[(d >= start) & (d <= high)]
            d -= start
            d /= width
            total += np.bincount(np.minimum(d.astype(np.int64), bins - 1), minlength=bins)
        some = np.flatnonzero(total)
        return {"bin": pa.array(some.astype(np.int64)), "n": pa.array(total[some])}

    parts = _reduced(_points(left), _points(right), reach, cell, "bin bigint, n bigint", count)
    return parts.groupBy("frame", "bin").agg(F.sum("n").alias("n"))


def best_acceptors(donors: DataFrame, acceptors: DataFrame, reach: float, degrees: float, cell: Sequence[float]) -> DataFrame:
    """(frame, donor, hydrogen, acceptor, score): of each row (frame, atom_idx, x, y, z, hydrogen, hx, hy, hz), the acceptor of the highest score, of equal ones the least."""
    least, edge = math.radians(degrees), math.cos(math.radians(degrees))

    def best(x: pa.Table, y: pa.Table) -> dict:
        d, h, o = _xyz(x), _xyz(x, prefix="h"), _xyz(y)
        shared, names = _apart(x, y), _array(y, "atom_idx")
        u = [_image(p - q, n) for p, q, n in zip(d, h, cell, strict=True)]
        nu = np.sqrt(u[0] * u[0] + u[1] * u[1] + u[2] * u[2])
        rows, found, scores = [], [], []
        with np.errstate(divide="ignore", invalid="ignore"):
            for a, b, d2 in blocks(d, o, reach, cell):
                near = d2 <= reach * reach
                if shared:
                    near &= shared[0][a][:, None] != shared[1][b][None, :]
                i, j = np.nonzero(near)
                r, q = a[i], b[j]
                v = [_image(p[q] - c[r], n) for p, c, n in zip(o, h, cell, strict=True)]
                far = np.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
                cosine = (u[0][r] * v[0] + u[1][r] * v[1] + u[2][r] * v[2]) / (nu[r] * far)
                ok = (cosine < edge + 1e-12) & (far > 0)
                i, q, far, cosine = i[ok], q[ok], far[ok], cosine[ok]
                ok = np.arccos(np.clip(cosine, -1.0, 1.0)) > least
                i, q, far, cosine = i[ok], q[ok], far[ok], cosine[ok]
                if not len(i):
                    continue
                # only what may be the best, then the score itself
                rough = -cosine / far
                first = np.flatnonzero(np.diff(i, prepend=-1))  # rows come in order
                top = np.repeat(np.maximum.reduceat(rough, first), np.diff(first, append=len(i)))
                ok = rough >= top - 1e-8 - 1e-12 * np.abs(top)
                i, q, far, cosine = i[ok], q[ok], far[ok], cosine[ok]
                score = np.cos(math.pi - np.arccos(np.clip(cosine, -1.0, 1.0))) / far
                score = np.where(np.abs(score) < 1e6, np.rint(score * 1e9) / 1e9, score)
                order = np.lexsort((names[q], -score, i))
                _, k = np.unique(i[order], return_index=True)
                k = order[k]
                rows.append(a[i[k]])
                found.append(names[q[k]])
                scores.append(score[k])
        if not rows:
            return {}
        rows = np.concatenate(rows)
        return {"donor": pa.array(_array(x, "atom_idx")[rows]), "hydrogen": pa.array(_array(x, "hydrogen")[rows].astype(np.int64)), "acceptor": pa.array(np.concatenate(found)), "score": pa.array(np.concatenate(scores))}

    more = ("hydrogen", "hx", "hy", "hz")
    return _reduced(_points(donors, *more), _points(acceptors), reach, cell, "donor bigint, hydrogen bigint, acceptor bigint, score double", best)


# --- the least and the greatest distance ---------------------------------------------------------------------------------
def _bounds(low: np.ndarray, high: np.ndarray, length: float, largest: bool) -> np.ndarray:
    """The least or greatest distance along an axis of what differs by low to high."""
    if not length:
        return np.maximum(np.abs(low), np.abs(high)) if largest else np.maximum(0.0, np.maximum(low, -high))
    ends = [np.abs(e - length * np.rint(e / length)) for e in (low, high)]
    shift = length / 2 if largest else 0.0  # the place where the distance is the greatest or least
    inside = np.floor((high - shift) / length) >= np.ceil((low - shift) / length)
    return np.where(inside, shift, np.maximum(*ends) if largest else np.minimum(*ends))


def _boxes(points: list[np.ndarray], cell: Sequence[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Rows by cell, where each cell starts and ends, and the bounds of its points."""
    k = int(min(12, max(1, round(0.7 * len(points[0]) ** (1 / 3)))))
    wrapped = [c - n * np.floor(c / n) if n else c for c, n in zip(points, cell, strict=True)]
    key = np.zeros(len(points[0]), np.int64)
    for c in wrapped:
        lo, span = c.min(), np.ptp(c)
        key = key * k + (np.minimum(((c - lo) / span * k).astype(np.int64), k - 1) if span else 0)
    order = np.argsort(key, kind="stable")
    _, first = np.unique(key[order], return_index=True)
    return order, first, np.append(first[1:], len(key)), [np.minimum.reduceat(c[order], first) for c in wrapped], [np.maximum.reduceat(c[order], first) for c in wrapped]


def _flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run."""
    return np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())


def farthest(left: list[np.ndarray], right: list[np.ndarray], cell: Sequence[float], largest: bool) -> float:
    """The greatest or least d2 of all left with all right points; pairs of cells go by their bounds, until no other can do better."""
    sign = -1.0 if largest else 1.0  # the least of sign * d2 is looked for

    def of(i: np.ndarray, j: np.ndarray) -> float:
        d2 = None
        for p, q, n in zip(left, right, cell, strict=True):
            d = _image(q[j] - p[i], n)
            d *= d
            d2 = d if d2 is None else d2 + d
        return float((sign * d2).min())

    (lo, lf, ll, la, lb), (ro, rf, rl, ra, rb) = _boxes(left, cell), _boxes(right, cell)
    few = np.linspace(0, len(lo) - 1, min(8, len(lo))).astype(np.int64)
    best = min(of(np.full(len(ro), i), np.arange(len(ro))) for i in few)
    bound, at = [], []
    step = max(1, (1 << 19) // len(rf))
    for k in range(0, len(lf), step):
        d2 = sum(_bounds(r0[None, :] - l1[k:k + step, None], r1[None, :] - l0[k:k + step, None], n, largest) ** 2 for l0, l1, r0, r1, n in zip(la, lb, ra, rb, cell, strict=True))
        rough = sign * d2 - 1e-9 * (1 + d2)  # bounds are rounded as well
        i, j = np.nonzero(rough < best)
        bound.append(rough[i, j])
        at.append((i + k) * len(rf) + j)
    bound, at = np.concatenate(bound), np.concatenate(at)
    order = np.argsort(bound, kind="stable")
    bound, at = bound[order], at[order]
    k, many = 0, 64
    while k < len(at) and bound[k] < best:
        i, j = at[k:k + many] // len(rf), at[k:k + many] % len(rf)
        n, m = ll[i] - lf[i], rl[j] - rf[j]
        take = max(1, int(np.searchsorted(np.cumsum(n * m), 1 << 20, side="right")))
        i, j, n, m = i[:take], j[:take], n[:take], m[:take]
        rows, sizes = _flat(lf[i], n), np.repeat(m, n)  # each left row with the run of its right rows
        for c in range(0, len(rows), max(1, (1 << 20) // int(m.max()))):
            part = slice(c, c + max(1, (1 << 20) // int(m.max())))
            best = min(best, of(lo[np.repeat(rows[part], sizes[part])], ro[_flat(np.repeat(rf[j], n)[part], sizes[part])]))
        k, many = k + take, min(many * 2, 1 << 14)
    return sign * best


def extreme(left: DataFrame, right: DataFrame, cell: Sequence[float], largest: bool, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """(keys, value): the least or greatest distance of all left with all right points (keys, x, y, z) of the same keys.

    Both sides are dealt out in parts, and each part meets each: no task holds a whole frame.
    """
    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        df = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in "xyz"]).filter("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
        df = df.withColumns({own: F.pmod(F.xxhash64("x", "y", "z"), F.lit(PARTS)), other: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))})
        return _own(df)

    by = [*keys, "_l", "_r"]
    a, b = dealt(left, "_l", "_r"), dealt(right, "_r", "_l")

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        d2 = []
        if x.num_rows and y.num_rows:
            p, q = (np.array(_xyz(t)) for t in (x, y))
            odd = [~np.isfinite(t).all(axis=0) for t in (p, q)]
            if largest and (odd[0].any() or odd[1].any()):
                d2 = [math.nan]
            elif not odd[0].all() and not odd[1].all():
                d2 = [farthest(list(p[:, ~odd[0]]), list(q[:, ~odd[1]]), cell, largest)]
        head = x.slice(0, len(d2)).select(list(keys))
        return head.append_column("d2", pa.array(d2, pa.float64()))

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in a.select(*keys).schema]
    parts = a.groupBy(*by).cogroup(b.groupBy(*by)).applyInArrow(run, ", ".join([*kinds, "d2 double"]))
    return parts.groupBy(*keys).agg(F.sqrt((F.max if largest else F.min)("d2")).alias("value"))
