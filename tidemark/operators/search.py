"""Nelder-Mead search of blend weights from several starts, all of which move together: one evaluation scores the points of every start.

A round needs the average precision of up to eight blends of all rows. As rows of a table these would be exchanged twice
and sorted by comparison, so here numpy sorts them: pieces of rows become sorted runs of distinct
scores with their counts, cut at ranges of the score, and each range of a point is merged in its own task.
"""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a point in one range of the score; rows that a worker sorts at once; rows that place the bounds of the ranges, which decide only who does the work.
RANGE_ROWS, PIECE_ROWS, PLACED_BY = 1 << 19, 1 << 18, 8192


def _runs(points: list[list[float]], cuts: list[np.ndarray], piece: int):
    """Functions over Arrow batches (y, scores): counts by point and range, and sorted runs. Range 0 holds the rows without a score, which come last."""

    def pieces(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= piece:
                yield joined(held)
                held, rows = [], 0
        if rows:
            yield joined(held)

    def joined(held):
        table = pa.Table.from_batches(held)
        null = np.zeros(table.num_rows, bool)
        for c in table.columns[1:]:
            if c.null_count:
                null |= c.is_null().to_numpy()
        y, *xs = [c.to_numpy() for c in table.columns]
        keep = ~null
        return y[keep], [x[keep] for x in xs], int(null.sum()), int(y[null].sum())

    def blend(w, xs):
        with np.errstate(all="ignore"):
            return sum((v * x for v, x in zip(w, xs)), np.zeros(len(xs[0])))

    def packed(a):
        low, high = int(a.min()), int(a.max())
        kind = "b" if -128 <= low and high <= 127 else "q"
        return kind.encode() + a.astype(kind).tobytes()

    def batch(rows, schema):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    small = pa.schema([("i", pa.int32()), ("range", pa.int32()), ("n", pa.int64()), ("tp", pa.int64())])
    whole = pa.schema([("i", pa.int32()), ("range", pa.int32()), ("score", pa.binary()), ("n", pa.binary()), ("tp", pa.binary())])

    def counts(batches):
        n, tp = [np.zeros(len(c) + 2, np.int64) for c in cuts], [np.zeros(len(c) + 2, np.int64) for c in cuts]
        for y, xs, nulls, null_tp in pieces(batches):
            for i, w in enumerate(points):
                at = np.searchsorted(cuts[i], blend(w, xs), side="right") + 1
                n[i] += np.bincount(at, minlength=len(n[i]))
                np.add.at(tp[i], at[y != 0], y[y != 0])
                n[i][0] += nulls
                tp[i][0] += null_tp
        rows = [(i, r, int(n[i][r]), int(tp[i][r])) for i in range(len(points)) for r in np.flatnonzero(n[i]).tolist()]
        if rows:
            yield batch(rows, small)

    def runs(batches):
        for y, xs, nulls, null_tp in pieces(batches):
            for i, w in enumerate(points):
                rows = [(i, 0, np.zeros(1).tobytes(), packed(np.array([nulls])), packed(np.array([null_tp])))] if nulls else []
                s = blend(w, xs)
                if len(s):
                    order = np.argsort(s)
                    s, n, tp = distinct(s[order], np.ones(len(s), np.int64), y[order])
                    at = np.searchsorted(cuts[i], s, side="right") + 1
                    edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(s)]
                    rows += [(i, int(at[a]), s[a:b].tobytes(), packed(n[a:b]), packed(tp[a:b])) for a, b in zip(edges, edges[1:])]
                yield batch(rows, whole)

    def distinct(s, n, tp):
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1]))
        first = np.flatnonzero(new)
        return s[first], np.add.reduceat(n, first), np.add.reduceat(tp, first)

    def merged(ahead):
        """Gains of each (point, range), given the (rows, positives) of the ranges ahead of it; its runs come one after the other."""

        def gain(key, parts):
            s, n, tp = [np.concatenate(p) for p in zip(*parts)]
            order = np.argsort(s, kind="stable")
            _, n, tp = distinct(s[order], n[order], tp[order])
            n0, tp0 = ahead[key]
            return (*key, float(np.sum(tp * (tp0 + np.cumsum(tp[::-1])[::-1]) / (n0 + np.cumsum(n[::-1])[::-1]))))

        def run(batches):
            out = pa.schema([("i", pa.int32()), ("range", pa.int32()), ("gain", pa.float64())])
            now, parts = None, []
            for b in batches:
                for i, r, *run in zip(*[c.to_pylist() for c in b.columns]):
                    if (i, r) != now:
                        if parts:
                            yield batch([gain(now, parts)], out)
                        now, parts = (i, r), []
                    parts.append((np.frombuffer(run[0]), *[np.frombuffer(x, chr(x[0]), offset=1).astype(np.int64) for x in run[1:]]))
            if parts:
                yield batch([gain(now, parts)], out)

        return run

    return counts, runs, merged


def placing(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Some rows, by a hash of their values, from which the bounds of the ranges of any point are taken, and the number of all rows."""
    n = rows.count()
    some = rows.filter(F.pmod(F.xxhash64(*rows.columns), F.lit(1 + n // PLACED_BY)) == 0).limit(4 * PLACED_BY).collect()
    held = [r[1:] for r in some if None not in r[1:]]
    return np.array(held, float).reshape(len(held), len(rows.columns) - 1), n


def inputs(df: DataFrame, y: str, scores: tuple[str, ...]) -> DataFrame:
    return df.select(F.coalesce(F.col(y).cast("long"), F.lit(0)).alias("y"), *[F.col(c).cast("double").alias(f"s{k}") for k, c in enumerate(scores)])


def precisions(df: DataFrame, y: str, scores: tuple[str, ...], points: list[list[float]], placed: tuple[np.ndarray, int] | None = None) -> list[float]:
    """Average precision of the blend of all rows with each point's weights; 0 without positives. Ties share a rank, nulls come last.

    The rows are read twice: to count the positives and rows of each range, and to sort them.
    """
    if not points:
        return []
    rows = inputs(df, y, scores)
    some, n = placed or placing(rows)
    ranges = max(1, n // RANGE_ROWS)
    cuts = []
    for p in points:
        with np.errstate(all="ignore"):
            blend = some @ np.array(p, float)
        blend = np.sort(blend[np.isfinite(blend)])
        cuts.append(np.unique(blend[[len(blend) * k // ranges for k in range(1, ranges)]] if len(blend) else blend))
    counts, runs, merged = _runs([[float(v) for v in p] for p in points], cuts, PIECE_ROWS)
    found = rows.mapInArrow(counts, "i int, range int, n long, tp long").groupBy("i", "range").agg(F.sum("n").alias("n"), F.sum("tp").alias("tp")).collect()
    ahead, so_far = {}, defaultdict(lambda: (0, 0))
    for i, r, n_here, tp_here in sorted(found, key=lambda x: -x["range"]):
        ahead[i, r] = so_far[i]
        so_far[i] = (so_far[i][0] + n_here, so_far[i][1] + tp_here)
    packed = rows.mapInArrow(runs, "i int, range int, score binary, n binary, tp binary").repartition("i", "range").sortWithinPartitions("i", "range")
    gains = defaultdict(list)
    for i, _, gain in packed.mapInArrow(merged(ahead), "i int, range int, gain double").collect():
        gains[i].append(gain)
    return [math.fsum(gains[i]) / so_far[i][1] if so_far[i][1] else 0.0 for i in range(len(points))]


def nelder_mead(df: DataFrame, y: str, scores: tuple[str, ...], starts: int = 4, rounds: int = 12, seed: int = 42) -> tuple[list[float], float]:
    """The best weights found, and their average precision. Rounds are a bound that is documented by the caller, not a tolerance: ranks make the target flat in places.

    In each round a simplex tries the reflection of its worst corner, then what that calls for: the expansion, one of the
    contractions or nothing more. What does not improve as the method says makes it shrink towards its best corner.
    """
    n, rng = len(scores), random.Random(seed)
    simplices = []
    for k in range(starts):
        first = [1.0 / n] * n if k == 0 else [rng.random() for _ in range(n)]
        simplices.append([first] + [[v + (0.25 if i == j else 0.0) for j, v in enumerate(first)] for i in range(n)])
    placed = placing(inputs(df, y, scores))
    at = lambda points: precisions(df, y, scores, points, placed)
    flat = at([p for s in simplices for p in s])
    values = [flat[k * (n + 1) : (k + 1) * (n + 1)] for k in range(starts)]
    for _ in range(rounds):
        moved = []
        for s, v in zip(simplices, values):
            order = sorted(range(n + 1), key=lambda i: -v[i])
            s[:], v[:] = [s[i] for i in order], [v[i] for i in order]
            centre = [sum(p[j] for p in s[:-1]) / n for j in range(n)]
            moved.append(lambda t, centre=centre, w=s[-1]: [c + t * (c - b) for c, b in zip(centre, w)])
        reflected = at([m(1.0) for m in moved])
        # the expansion, the outer or the inner contraction; none for a reflection that is better than the last but one
        steps = [2.0 if r > v[0] else None if r > v[-2] else 0.5 if r > v[-1] else -0.5 for r, v in zip(reflected, values)]
        tried = iter(at([m(t) for m, t in zip(moved, steps) if t is not None]))
        shrunk = []
        for k, (s, v, m, r, t) in enumerate(zip(simplices, values, moved, reflected, steps)):
            more = next(tried) if t is not None else None
            if t is None or t == 2.0 and more <= r:
                s[-1], v[-1] = m(1.0), r
            elif t == 2.0 or t == 0.5 and more >= r or t == -0.5 and more > v[-1]:
                s[-1], v[-1] = m(t), more
            else:
                s[1:] = [[(a + b) / 2 for a, b in zip(s[0], p)] for p in s[1:]]
                shrunk.append(k)
        if shrunk:
            again = at([p for k in shrunk for p in simplices[k][1:]])
            for j, k in enumerate(shrunk):
                values[k][1:] = again[j * n : (j + 1) * n]
    best, where = max((v, (k, i)) for k, vs in enumerate(values) for i, v in enumerate(vs))
    return simplices[where[0]][where[1]], best
