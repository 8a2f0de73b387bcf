"""Measures of the pairs of a cell, taken in the task where both sides meet.

Pairs within a radius grow with the product of two densities, so as rows they
cost a copy of the outline each. Here the rows of a cell come to one task, once
per side (``grid`` splits cells with too many rows), numpy looks at their pairs
slice by slice, and what leaves is one row per outline and cell at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import shuffle_width
from . import kernels as K
from .grid import BOX, box_box_cells, box_cells, box_level, box_point_cells, split_hot_cells

#: pairs looked at in one step
SLICE = 1 << 15
#: strips that the points of a cell are sorted into, at most
STRIPS = 64
#: a gap that still rounds to a distance of 0 fits into it
SLACK = 1e-6
ENDS = ("x1", "y1", "x2", "y2")
RBOX = ("rminx", "rminy", "rmaxx", "rmaxy")


def together(left: DataFrame, right: DataFrame, keys: Sequence[str], step: Callable[[pa.Table, pa.Table], pa.Table], schema: StructType) -> DataFrame:
    """The rows that ``step`` makes of both sides of every cell."""
    none = pa.Table.from_batches([], to_arrow_schema(schema))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return step(a, b).cast(none.schema) if a.num_rows and b.num_rows else none

    # rows without a place meet nothing; a given number of partitions is not merged by size, as few bytes may be many pairs
    width = shuffle_width(left.sparkSession)
    left, right = (df.dropna(subset=list(keys)).repartition(width, *keys) for df in (left, right))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _numbers(rows: pa.Table, columns: Sequence[str]) -> list[np.ndarray]:
    return [rows.column(c).to_numpy().astype(float, copy=False) for c in columns]


def _spread(owner: np.ndarray, first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ranges of places as (owner, place) pairs, some ``SLICE`` of them at a time."""
    done = np.cumsum(count)
    cuts = np.searchsorted(done, np.arange(0, done[-1] if len(done) else 0, SLICE), "right")
    for i, j in zip(cuts, [*cuts[1:], len(done)]):
        if j > i:
            which, nth = K._places(count[i:j])
            yield owner[i:j][which], first[i:j][which] + nth


def _strip_order(px: np.ndarray, py: np.ndarray, height: float):
    """Points in order of strip and x, and a function from boxes to their (box, point) pairs in that order."""
    x0, y0 = px.min(), py.min()
    wide, tall = px.max() - x0, py.max() - y0
    strips = int(np.clip(tall / height if height > 0 else STRIPS, 1, STRIPS))
    h, jump = tall / strips if tall > 0 else 1.0, 2 * wide + 1.0

    def strip(y: np.ndarray) -> np.ndarray:
        return np.clip((y - y0) / h, 0, strips - 1).astype(np.int64)

    place = strip(py) * jump + (px - x0)
    order = np.argsort(place, kind="stable")
    place, px, py = place[order], px[order], py[order]

    def pairs(minx: np.ndarray, miny: np.ndarray, maxx: np.ndarray, maxy: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        live = np.flatnonzero(np.isfinite(minx + miny + maxx + maxy))
        low = strip(miny[live])
        which, nth = K._places(strip(maxy[live]) - low + 1)
        box, base = live[which], (low[which] + nth) * jump
        first = np.searchsorted(place, base + np.clip(minx[box] - x0, 0, wide), "left")
        last = np.searchsorted(place, base + np.clip(maxx[box] - x0, 0, wide), "right")
        for b, p in _spread(box, first, np.maximum(last - first, 0)):
            x, y = px[p], py[p]
            inside = (x >= minx[b]) & (x <= maxx[b]) & (y >= miny[b]) & (y <= maxy[b])
            yield b[inside], p[inside]

    return order, pairs


class _Totals:
    """Sums, or largest values, of a column per outline; without a value NULL."""

    def __init__(self, column: pa.ChunkedArray, largest: bool, n: int):
        self.type, self.op = column.type, np.maximum if largest else np.add
        plain = column.cast(pa.int32()) if pa.types.is_date32(column.type) else column
        kind = np.float64 if pa.types.is_floating(plain.type) else np.int64
        least = -np.inf if kind is np.float64 else np.iinfo(np.int64).min
        self.rest = kind(least if largest else 0)
        self.known = column.is_valid().to_numpy()
        self.value = np.where(self.known, plain.fill_null(0).to_numpy(), self.rest)
        self.out, self.some = np.full(n, self.rest, kind), np.zeros(n, bool)

    def add(self, first: np.ndarray, owners: np.ndarray, at: np.ndarray) -> None:
        self.out[owners] = self.op(self.out[owners], self.op.reduceat(self.value[at], first))
        self.some[owners] |= np.logical_or.reduceat(self.known[at], first)

    def column(self, rows: np.ndarray) -> pa.Array:
        found = np.where(self.some, self.out, 0)[rows]
        plain = pa.array(found.astype(np.int32) if pa.types.is_date32(self.type) else found, mask=~self.some[rows])
        return plain.cast(self.type)


def _firsts(owner: np.ndarray) -> np.ndarray:
    """Where the runs of equal owners begin."""
    return np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))


def near_totals(outlines: DataFrame, positions: DataFrame, key: str, radii: Sequence[float], largest: Sequence[str], side: float) -> DataFrame:
    """Totals of the positions around each outline, one row per outline, ring of radii and cell.

    ``positions`` has ``px, py`` and columns of whole numbers, decimals or dates,
    which are summed, or of which the largest is taken (``largest``). ``dist`` is
    the smallest of ``radii`` that holds the positions of the row.
    """
    names = [c for c in positions.columns if c not in ("px", "py")]
    reach = np.array(sorted(set(radii)), float)
    pad = float(reach[-1])
    left, right, keys = box_point_cells(outlines.select(key, *BOX, "ring"), positions, side, pad)
    schema = StructType([StructField(key, outlines.schema[key].dataType), StructField("dist", DoubleType()), *[StructField(c, positions.schema[c].dataType) for c in names]])

    def step(a: pa.Table, b: pa.Table) -> pa.Table:
        sides = K._Sides(a.column("ring"))
        px, py = _numbers(b, ("px", "py"))
        good = np.flatnonzero(np.isfinite(px + py))
        x0, y0, x1, y1 = _numbers(a, BOX)
        totals = [{} for _ in reach]
        found = np.zeros((len(reach), a.num_rows), bool)
        if len(good):
            order, pairs = _strip_order(px[good], py[good], float(np.median(y1 - y0) + 2 * pad) / 2)
            b = b.take(pa.array(good[order]))
            px, py = _numbers(b, ("px", "py"))
            totals = [{c: _Totals(b.column(c), c in largest, a.num_rows) for c in names} for _ in reach]
            for owner, at in pairs(x0 - pad, y0 - pad, x1 + pad, y1 + pad):
                band = K.point_bands(sides, owner, px[at], py[at], reach)
                for k in range(len(reach)):
                    o, p = owner[band == k], at[band == k]
                    if len(o):
                        first = _firsts(o)
                        found[k, o[first]] = True
                        for t in totals[k].values():
                            t.add(first, o[first], p)
        parts = []
        for k, t in enumerate(totals):
            rows = np.flatnonzero(found[k])
            if len(rows):
                parts.append(pa.table({key: a.column(key).take(pa.array(rows)), "dist": np.full(len(rows), reach[k]), **{c: t[c].column(rows) for c in names}}))
        return pa.concat_tables(parts) if parts else pa.Table.from_batches([], to_arrow_schema(schema))

    return together(left, right, keys, step, schema)


class _Lines:
    """Straight pieces of a cell in order of their lower edge, and which of them may reach a box in y."""

    def __init__(self, rows: pa.Table):
        low = _numbers(rows, ("rminy",))[0]
        good = np.flatnonzero(np.isfinite(sum(_numbers(rows, (*ENDS, *RBOX)))))
        self.rows = rows.take(pa.array(good[np.argsort(low[good], kind="stable")]))
        self.ends, self.box = _numbers(self.rows, ENDS), _numbers(self.rows, RBOX)
        self.tall = np.max(self.box[3] - self.box[1], initial=0.0) * (1 + 1e-12)

    def ranges(self, miny: np.ndarray, maxy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.searchsorted(self.box[1], miny - self.tall - 1e-9 * np.abs(miny), "left")
        last = np.searchsorted(self.box[1], maxy, "right")
        return first, np.where(np.isfinite(miny + maxy), np.maximum(last - first, 0), 0)


def touched(outlines: DataFrame, lines: DataFrame, key: str, radius: float, side: float) -> DataFrame:
    """Keys of the outlines with a line within ``radius``, once per cell and row.

    An outline looks at a few lines of its cell, then at twice as many, and
    stops at the first that is near enough, so dense lines cost no more.
    """
    schema = StructType([StructField(key, outlines.schema[key].dataType)])
    left, right, keys = box_box_cells(outlines.select(key, *BOX, "ring"), lines.select(*ENDS, *RBOX), side, radius)

    def step(a: pa.Table, b: pa.Table) -> pa.Table:
        sides, pieces = K._Sides(a.column("ring")), _Lines(b)
        x0, y0, x1, y1 = (v + d for v, d in zip(_numbers(a, BOX), (-radius, -radius, radius, radius)))
        at, left_ = pieces.ranges(y0, y1)
        hit, many = np.zeros(a.num_rows, bool), 8
        while len(live := np.flatnonzero(~hit & (left_ > 0))):
            now = np.minimum(left_[live], many)
            for owner, p in _spread(live, at[live], now):
                u0, v0, u1, v1 = (v[p] for v in pieces.box)
                near = (u0 <= x1[owner]) & (u1 >= x0[owner]) & (v0 <= y1[owner]) & (v1 >= y0[owner])
                owner, p = owner[near], p[near]
                gap = K.piece_gaps(sides.taken(owner), *(v[p] for v in pieces.ends))
                hit[owner[gap <= radius]] = True
            at[live] += now
            left_[live] -= now
            many *= 2
        return a.select([key]).filter(pa.array(hit))

    return together(left, right, keys, step, schema)


def first_touching(outlines: DataFrame, lines: DataFrame, key: str, line: str, value: str, side: float) -> DataFrame:
    """Per outline and cell the line with the smallest ``line`` of those that enter it (at a distance that rounds to 0), and its ``value``.

    Lines are looked at in their order, a few at first, then twice as many, and
    an outline stops at the first that enters it.
    """
    schema = StructType([StructField(key, outlines.schema[key].dataType), *[StructField(c, lines.schema[c].dataType) for c in (line, value)]])
    left, right, keys = box_box_cells(outlines.select(key, *BOX, "ring"), lines.select(line, value, *ENDS, *RBOX), side, SLACK)

    def step(a: pa.Table, b: pa.Table) -> pa.Table:
        # NULL first, as Spark orders it
        b = b.take(pc.sort_indices(b, sort_keys=[(line, "ascending")], null_placement="at_start"))
        sides, ends, pieces = K._Sides(a.column("ring")), _numbers(b, ENDS), _numbers(b, RBOX)
        box = [v + d for v, d in zip(_numbers(a, BOX), (-SLACK, -SLACK, SLACK, SLACK))]
        live, done, many = np.arange(a.num_rows), 0, 8
        first = np.full(a.num_rows, b.num_rows)
        while len(live) and done < b.num_rows:
            now = min(many, b.num_rows - done)
            for owner, p in _spread(live, np.full(len(live), done), np.full(len(live), now)):
                near = (pieces[0][p] <= box[2][owner]) & (pieces[2][p] >= box[0][owner]) & (pieces[1][p] <= box[3][owner]) & (pieces[3][p] >= box[1][owner])
                owner, p = owner[near], p[near]
                enters = K.piece_gaps(sides.taken(owner), *(v[p] for v in ends)) < 5e-7
                np.minimum.at(first, owner[enters], p[enters])
            live = live[first[live] == b.num_rows]
            done, many = done + now, many * 2
        found = np.flatnonzero(first < b.num_rows)
        of = b.take(pa.array(first[found]))
        return pa.table({key: a.column(key).take(pa.array(found)), line: of.column(line), value: of.column(value)})

    return together(left, right, keys, step, schema)


def metres_inside(outlines: DataFrame, lines: DataFrame, key: str, value: str, radius: float, side: float) -> DataFrame:
    """Metres of the lines of each ``value`` inside an outline (radius 0) or its corridor: one row per outline, value and cell."""
    schema = StructType([StructField(key, outlines.schema[key].dataType), StructField(value, lines.schema[value].dataType), StructField("metres", DoubleType())])
    left, right, keys = box_box_cells(outlines.select(key, *BOX, "ring"), lines.select(value, *ENDS, *RBOX), side, radius)

    def step(a: pa.Table, b: pa.Table) -> pa.Table:
        sides, pieces = K._Sides(a.column("ring")), _Lines(b)
        x0, y0, x1, y1 = (v + d for v, d in zip(_numbers(a, BOX), (-radius, -radius, radius, radius)))
        cx, cy = a.column("cx")[0].as_py(), a.column("cy")[0].as_py()
        width = float(side) * 2.0 ** a.column("lvl")[0].as_py()
        lown, rown = (t.column(c).to_numpy() for t, c in ((a, "lown_"), (pieces.rows, "rown_")))
        codes = pieces.rows.column(value).combine_chunks().dictionary_encode(null_encoding="encode")
        code, n = codes.indices.to_numpy().astype(np.int64), max(1, len(codes.dictionary))
        got, sums = [], []
        for owner, p in _spread(np.arange(a.num_rows), *pieces.ranges(y0, y1)):
            u0, v0, u1, v1 = (v[p] for v in pieces.box)
            ox0, oy0 = x0[owner], y0[owner]
            # a pair counts in the cell that holds the lower corner of the common box, as in box_box_pairs
            keep = (u0 <= x1[owner]) & (u1 >= ox0) & (v0 <= y1[owner]) & (v1 >= oy0) & (lown[owner] | rown[p])
            keep &= (np.floor(np.maximum(ox0, u0) / width) == cx) & (np.floor(np.maximum(oy0, v0) / width) == cy)
            owner, p = owner[keep], p[keep]
            a0, b0, a1, b1 = (v[p] for v in pieces.ends)
            meets = K.enters_box(a0, b0, a1 - a0, b1 - b0, x0[owner], y0[owner], x1[owner], y1[owner])
            owner, p = owner[meets], p[meets]
            ends = [v[p] for v in pieces.ends]
            edges = sides.taken(owner)
            share = K.union_length(*K.piece_spans(edges, *ends, np.full(len(p), float(radius)))) if radius > 0 else K.inside_shares(edges, *ends)
            metres = share * np.sqrt((ends[2] - ends[0]) ** 2 + (ends[3] - ends[1]) ** 2)
            some = metres > 0
            which, back = np.unique(owner[some] * n + code[p[some]], return_inverse=True)
            got.append(which)
            sums.append(np.bincount(back, weights=metres[some], minlength=len(which)))
        which, back = np.unique(np.concatenate(got or [np.zeros(0, np.int64)]), return_inverse=True)
        total = np.bincount(back, weights=np.concatenate(sums or [np.zeros(0)]), minlength=len(which))
        return pa.table({key: a.column(key).take(pa.array(which // n)), value: codes.dictionary.take(pa.array(which % n)), "metres": total})

    return together(left, right, keys, step, schema)


def points_near(pieces: DataFrame, points: DataFrame, key: Sequence[str], radius: float, side: float) -> DataFrame:
    """Keys of the points with a straight piece within ``radius``.

    The points of a cell meet a few of its pieces, those left over meet twice as
    many, and so on, so dense pieces cost no more.
    """
    schema = StructType([StructField(c, points.schema[c].dataType) for c in key])
    left, right, keys = box_point_cells(pieces.select(*ENDS, *BOX), points.select(*key, "px", "py"), side, radius)

    def step(a: pa.Table, b: pa.Table) -> pa.Table:
        px, py = _numbers(b, ("px", "py"))
        far = np.flatnonzero(np.isfinite(px + py))
        box = [v + d for v, d in zip(_numbers(a, BOX), (-radius, -radius, radius, radius))]
        ends = _numbers(a, ENDS)
        near, done, many = [far[:0]], 0, 64
        while len(far) and done < a.num_rows:
            now = slice(done, done + many)
            order, pairs = _strip_order(px[far], py[far], float(np.median(box[3] - box[1])) / 2)
            far = far[order]
            ax, ay, bx, by = (v[now] for v in ends)
            dx, dy = bx - ax, by - ay
            len2 = dx * dx + dy * dy
            hit = np.zeros(len(far), bool)
            for o, p in pairs(*(v[now] for v in box)):
                fresh = ~hit[p]
                o, p = o[fresh], p[fresh]
                x, y = px[far[p]], py[far[p]]
                t = np.clip(((x - ax[o]) * dx[o] + (y - ay[o]) * dy[o]) / np.where(len2[o] > 0, len2[o], 1.0), 0.0, 1.0)
                ex, ey = x - (ax[o] + t * dx[o]), y - (ay[o] + t * dy[o])
                hit[p[np.sqrt(ex * ex + ey * ey) <= radius]] = True
            near.append(far[hit])
            far, done, many = far[~hit], done + many, many * 2
        return b.select(list(key)).take(pa.array(np.concatenate(near)))

    return together(left, right, keys, step, schema)


def first_holding(outlines: DataFrame, positions: DataFrame, key: str, value: str, side: float) -> DataFrame:
    """Per outline and cell the ``value`` of the position with the smallest ``rank_`` of those inside (at a distance that rounds to 0).

    Positions (``px, py, rank_`` and the value) are looked at in order of rank, a
    few at first, then twice as many, and an outline stops once it holds one.
    """
    schema = StructType([StructField(key, outlines.schema[key].dataType), StructField("rank_", positions.schema["rank_"].dataType), StructField(value, positions.schema[value].dataType)])
    left, right, keys = box_point_cells(outlines.select(key, *BOX, "ring"), positions, side, SLACK)

    def step(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.take(pc.sort_indices(b, sort_keys=[("rank_", "ascending")], null_placement="at_start"))
        sides, (px, py) = K._Sides(a.column("ring")), _numbers(b, ("px", "py"))
        box = [v + d for v, d in zip(_numbers(a, BOX), (-SLACK, -SLACK, SLACK, SLACK))]
        height = float(np.median(box[3] - box[1]))
        live, done, many = np.arange(a.num_rows), 0, 256
        first = np.full(a.num_rows, b.num_rows)
        while len(live) and done < b.num_rows:
            now = done + np.flatnonzero(np.isfinite((px + py)[done:done + many]))
            if len(now):
                order, pairs = _strip_order(px[now], py[now], height)
                now = now[order]
                for owner, at in pairs(*(v[live] for v in box)):
                    owner, at = live[owner], now[at]
                    held = K.point_gaps(sides.taken(owner), px[at], py[at]) < 5e-7
                    np.minimum.at(first, owner[held], at[held])
            live = live[first[live] == b.num_rows]
            done, many = done + many, many * 2
        found = np.flatnonzero(first < b.num_rows)
        of = b.take(pa.array(first[found]))
        return pa.table({key: a.column(key).take(pa.array(found)), "rank_": of.column("rank_"), value: of.column(value)})

    return together(left, right, keys, step, schema)


def _united(owner: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals as disjoint ones per owner; ends are taken as they are, none is computed."""
    order = np.lexsort((lo, owner))
    ends, rank = np.unique(hi, return_inverse=True)
    owner, lo = owner[order], lo[order]
    reach = np.maximum.accumulate(owner * len(ends) + rank[order])
    fresh = np.ones(len(order), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (lo[1:] > ends[reach[:-1] % max(1, len(ends))])
    at = np.flatnonzero(fresh)
    last = np.append(at[1:], len(order)) - 1
    return owner[at], lo[at], ends[reach[last[:len(at)]] % max(1, len(ends))] if len(at) else hi


def covered_spans(pieces: DataFrame, lines: DataFrame, key: Sequence[str], radius: float, side: float) -> DataFrame:
    """Shares ``lo, hi`` of each piece within ``radius`` of any line: disjoint ones per piece and cell, for the part of the piece in that cell.

    A part meets a few lines of its cell, then twice as many, and stops once it
    is covered, so dense lines cost no more. ``pieces`` have ``rminx..rmaxy``.
    """
    schema = StructType([*[StructField(c, pieces.schema[c].dataType) for c in key], StructField("lo", DoubleType()), StructField("hi", DoubleType())])
    left, right, keys = box_box_cells(lines.select(*ENDS, *BOX), pieces.select(*key, *ENDS, *RBOX), side, radius)

    def step(a: pa.Table, b: pa.Table) -> pa.Table:
        cx, cy, width = a.column("cx")[0].as_py(), a.column("cy")[0].as_py(), float(side) * 2.0 ** a.column("lvl")[0].as_py()
        x1, y1, x2, y2 = _numbers(b, ENDS)
        start, stop = np.zeros(b.num_rows), np.ones(b.num_rows)
        for u, v, c in ((x1, x2, cx), (y1, y2, cy)):
            move, some = np.where(u != v, v - u, 1.0), u != v
            t1, t2 = (c * width - u) / move, ((c + 1) * width - u) / move
            start = np.maximum(start, np.where(some, np.minimum(t1, t2), np.where(np.floor(u / width) == c, 0.0, 2.0)))
            stop = np.minimum(stop, np.where(some, np.maximum(t1, t2), 1.0))
        own = b.column("rown_").to_numpy()
        live = np.flatnonzero((start < stop) & np.isfinite(x1 + y1 + x2 + y2))
        low = np.minimum(y1 + start * (y2 - y1), y1 + stop * (y2 - y1)) - radius
        top = np.maximum(y1 + start * (y2 - y1), y1 + stop * (y2 - y1)) + radius
        west = np.minimum(x1 + start * (x2 - x1), x1 + stop * (x2 - x1)) - radius
        east = np.maximum(x1 + start * (x2 - x1), x1 + stop * (x2 - x1)) + radius
        renamed = a.rename_columns([dict(zip(BOX, RBOX)).get(c, c) for c in a.column_names])
        renamed = renamed.take(pa.array(np.random.default_rng(7).permutation(a.num_rows)))
        kept = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        done, many, parts = 0, 16, []
        while len(live) and done < a.num_rows:
            some = _Lines(renamed.slice(done, many))
            wide = some.rows.column("lown_").to_numpy()
            got = [kept]
            for o, p in _spread(live, *some.ranges(low[live] - SLACK, top[live] + SLACK)):
                near = (some.box[0][p] <= east[o] + SLACK) & (some.box[2][p] >= west[o] - SLACK) & (some.box[3][p] >= low[o] - SLACK) & (own[o] | wide[p])
                o, p = o[near], p[near]
                pair, lo, hi = K._capsule_spans(np.arange(len(o)), *(v[p] for v in some.ends), x1[o], y1[o], (x2 - x1)[o], (y2 - y1)[o], float(radius))
                o = o[pair]
                lo, hi = np.maximum(lo, start[o]), np.minimum(hi, stop[o])
                inside = hi > lo
                got.append((o[inside], lo[inside], hi[inside]))
            kept = _united(*(np.concatenate(v) for v in zip(*got)))
            whole = kept[0][(kept[1] <= start[kept[0]]) & (kept[2] >= stop[kept[0]])]
            full = np.isin(kept[0], whole)
            parts.append(tuple(v[full] for v in kept))
            kept = tuple(v[~full] for v in kept)
            live = live[~np.isin(live, whole)]
            done, many = done + many, many * 2
        owner, lo, hi = (np.concatenate(v) for v in zip(*parts, kept))
        return pa.table({**{c: b.column(c).take(pa.array(owner)) for c in key}, "lo": lo, "hi": hi})

    return together(left, right, keys, step, schema)


def nearest_outline(outlines: DataFrame, lines: DataFrame, rank: str, of_line: Sequence[str], of_outline: Sequence[str], radius: float, side: float) -> DataFrame:
    """Per line and cell the nearest outline within ``radius``, by its distance ``gap_`` to six decimals and then the smallest ``rank``.

    Outlines are looked at in order of rank, a few at first, then twice as many;
    a line stops at the first it enters, and only lines that enter none are
    measured against all around.
    """
    schema = StructType([*[StructField(c, lines.schema[c].dataType) for c in of_line], *[StructField(c, outlines.schema[c].dataType) for c in of_outline], StructField("gap_", DoubleType())])
    left, right, keys = box_box_cells(outlines.select(*dict.fromkeys([rank, *of_outline, *BOX, "ring"])), lines.select(*dict.fromkeys([*of_line, *ENDS, *RBOX])), side, radius)

    def step(a: pa.Table, b: pa.Table) -> pa.Table:
        a = a.take(pc.sort_indices(a, sort_keys=[(rank, "ascending")], null_placement="at_start"))
        sides, ends, x = K._Sides(a.column("ring")), _numbers(b, ENDS), _numbers(b, RBOX)
        box = _numbers(a, BOX)
        lown, rown = (t.column(c).to_numpy() for t, c in ((a, "lown_"), (b, "rown_")))

        def pairs(live: np.ndarray, now: np.ndarray, pad: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Pairs of a line and one of the outlines ``now`` whose boxes meet."""
            now = now[np.isfinite(sum(v[now] for v in box))]
            now = now[np.argsort(box[1][now], kind="stable")]
            tall = np.max(box[3][now] - box[1][now], initial=0.0) + 2 * pad + SLACK
            first = np.searchsorted(box[1][now], x[1][live] - tall, "left")
            last = np.searchsorted(box[1][now], x[3][live] + pad + SLACK, "right")
            for o, p in _spread(live, first, np.where(np.isfinite(x[1][live] + x[3][live]), np.maximum(last - first, 0), 0)):
                p = now[p]
                near = (x[0][o] <= box[2][p] + pad) & (x[2][o] >= box[0][p] - pad) & (x[1][o] <= box[3][p] + pad) & (x[3][o] >= box[1][p] - pad) & (lown[p] | rown[o])
                yield o[near], p[near]

        def gaps(o: np.ndarray, p: np.ndarray) -> np.ndarray:
            return K.piece_gaps(sides.taken(p), *(v[o] for v in ends))

        best, gap = np.full(b.num_rows, a.num_rows), np.full(b.num_rows, np.inf)
        live, done, many = np.arange(b.num_rows), 0, 32
        while len(live) and done < a.num_rows:
            for o, p in pairs(live, np.arange(done, min(done + many, a.num_rows)), SLACK):
                enters = gaps(o, p) < 5e-7
                np.minimum.at(best, o[enters], p[enters])
            live = live[best[live] == a.num_rows]
            done, many = done + many, many * 2
        gap[best < a.num_rows] = 0.0
        for o, p in pairs(live, np.arange(a.num_rows), radius):
            g = gaps(o, p)
            r = np.round(g, 6)
            ok = r <= radius
            o, p, g, r = o[ok], p[ok], g[ok], r[ok]
            order = np.lexsort((p, r, o))
            at = order[_firsts(o[order])] if len(o) else order
            better = (r[at] < np.round(gap[o[at]], 6)) | (r[at] == np.round(gap[o[at]], 6)) & (p[at] < best[o[at]])
            at = at[better]
            best[o[at]], gap[o[at]] = p[at], g[at]
        found = np.flatnonzero(best < a.num_rows)
        of, line = a.take(pa.array(best[found])), b.take(pa.array(found))
        return pa.table({**{c: line.column(c) for c in of_line}, **{c: of.column(c) for c in of_outline}, "gap_": gap[found]})

    return together(left, right, keys, step, schema)


def nearest_piece(pieces: DataFrame, points: DataFrame, key: Sequence[str], piece: str, value: str, radius: float, side: float) -> DataFrame:
    """Per point and cell the nearest straight piece within ``radius``, by its distance ``gap_`` to six decimals and then the smallest ``piece``, and its ``value``."""
    schema = StructType([*[StructField(c, points.schema[c].dataType) for c in key], StructField("gap_", DoubleType()), *[StructField(c, pieces.schema[c].dataType) for c in (piece, value)]])
    left, right, keys = box_point_cells(pieces.select(piece, value, *ENDS, *BOX), points.select(*key, "px", "py"), side, radius)

    def step(a: pa.Table, b: pa.Table) -> pa.Table:
        a = a.take(pc.sort_indices(a, sort_keys=[(piece, "ascending")], null_placement="at_start"))
        x, y = _numbers(b, ("px", "py"))
        good, box = np.flatnonzero(np.isfinite(x + y)), _numbers(a, BOX)
        ax, ay, bx, by = _numbers(a, ENDS)
        dx, dy = bx - ax, by - ay
        len2 = dx * dx + dy * dy
        safe = np.where(len2 > 0, len2, 1.0)
        best, gap = np.full(len(good), a.num_rows), np.full(len(good), np.inf)
        if len(good):
            order, pairs = _strip_order(x[good], y[good], float(np.median(box[3] - box[1]) + 2 * radius) / 2)
            good = good[order]
            x, y = x[good], y[good]
            # pieces in any order, a few at first: the farther ones drop out once every point has one close by
            mixed, done, many = np.random.default_rng(7).permutation(a.num_rows), 0, 64
            while done < a.num_rows:
                some, pad = mixed[done:done + many], min(radius, gap.max()) + SLACK
                for o, p in pairs(*(v[some] + d for v, d in zip(box, (-pad, -pad, pad, pad)))):
                    o = some[o]
                    ex, ey = x[p] - ax[o], y[p] - ay[o]
                    t = np.clip((ex * dx[o] + ey * dy[o]) / safe[o], 0.0, 1.0)
                    ex -= t * dx[o]
                    ey -= t * dy[o]
                    g = np.round(np.sqrt(ex * ex + ey * ey), 6)
                    ok = np.flatnonzero((g <= radius) & ((g < gap[p]) | (g == gap[p]) & (o < best[p])))
                    o, p, g = o[ok], p[ok], g[ok]
                    order = np.lexsort((o, g, p))
                    at = order[_firsts(p[order])] if len(p) else order
                    best[p[at]], gap[p[at]] = o[at], g[at]
                done, many = done + many, many * 2
        found = np.flatnonzero(best < a.num_rows)
        of, at = a.take(pa.array(best[found])), b.take(pa.array(good[found]))
        return pa.table({**{c: at.column(c) for c in key}, "gap_": gap[found], piece: of.column(piece), value: of.column(value)})

    return together(left, right, keys, step, schema)


def along_routes(routes: DataFrame, segments: DataFrame, key: str, radius: float, cols: Sequence[str], totals: Callable[..., pa.Table], schema: StructType, side: float, enough: float) -> DataFrame:
    """Totals over the segments that each route crosses or comes near, in rows that are summed per route.

    ``routes`` has the route's straight ``pieces`` in one row and its box. A
    route comes whole to one cell, that of its lower corner among cells as wide
    as its box, so its metres on a segment are complete there and no pair is a
    row. Segments are listed under the cells of routes that can reach them; those
    of one number stay together. ``totals(route, segment, on, by, b)`` gets, for
    some routes at a time, the row of each route and of the segment in ``b``, and
    the metres on it and near it, and returns a table with the route's ``row_``.
    The metres near a segment are only measured below ``enough`` metres on it,
    else those on it stand for them.
    """
    own = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"), F.lit(1e-9)) / side)).cast("int"))
    routes = routes.select(key, "pieces", F.col("minx"), F.col("miny"), own.alias("own_"))
    outlines = segments.select("segment_id", *BOX, "ring", *cols).withColumn("own_", box_level(*(F.col(c) for c in BOX), side))

    def levels(df: DataFrame):
        return df.select("own_").distinct().agg(F.sort_array(F.collect_list("own_"))).scalar()

    def listed(df: DataFrame, others: DataFrame, low: Sequence, top: Sequence) -> DataFrame:
        up = F.explode(F.array_union(F.array("own_"), F.filter(F.col("levels_"), lambda v: v > F.col("own_"))))
        at = df.withColumn("levels_", levels(others)).withColumn("lvl", up).withColumn("width_", F.lit(float(side)) * F.pow(F.lit(2.0), F.col("lvl")))
        at = at.withColumn("cell_", F.explode(box_cells(*low, *top, F.col("width_"))))
        return at.select(*[c for c in df.columns if c != "own_"], "lvl", F.col("cell_.cx").alias("cx"), F.col("cell_.cy").alias("cy"), (F.col("lvl") == F.col("own_")).alias("is_own_"))

    corner = [F.col("minx"), F.col("miny")]
    left = listed(routes, outlines, corner, corner).drop("minx", "miny")
    far = F.col("width_") + radius + SLACK
    right = listed(outlines, routes, [F.col("minx") - far, F.col("miny") - far], [F.col("maxx") + radius + SLACK, F.col("maxy") + radius + SLACK])
    left, right, keys = split_hot_cells(left, right, F.col(key), F.col("segment_id"), cell=("lvl", "cx", "cy"))

    def step(a: pa.Table, b: pa.Table) -> pa.Table:
        low = _numbers(b, ("miny",))[0]
        b = b.take(pa.array(np.argsort(low, kind="stable")))
        x0, y0, x1, y1 = (v + d for v, d in zip(_numbers(b, BOX), (-radius, -radius, radius, radius)))
        sides, wide, of_own = K._Sides(b.column("ring")), b.column("is_own_").to_numpy(), a.column("is_own_").to_numpy()
        ids = b.column("segment_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
        row_of_id = np.zeros(ids.max() + 1, np.int64)
        row_of_id[ids[::-1]] = np.arange(b.num_rows)[::-1]
        lists = a.column("pieces").combine_chunks()
        sizes = K._lengths(lists)
        flat = lists.flatten()
        px, py, qx, qy = (flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ENDS)
        route, _ = K._places(sizes)
        west, east, south, north = np.minimum(px, qx), np.maximum(px, qx), np.minimum(py, qy), np.maximum(py, qy)
        dx, dy = qx - px, qy - py
        length = np.sqrt(dx * dx + dy * dy)
        tall = np.max(y1 - y0, initial=0.0) + SLACK
        first = np.searchsorted(y0, south - tall, "left")
        many = np.where(np.isfinite(px + py + qx + qy), np.maximum(np.searchsorted(y0, north, "right") - first, 0), 0)
        # routes are taken some at a time, each whole
        done = np.cumsum(np.bincount(route, weights=many, minlength=a.num_rows))
        cuts = np.unique(np.searchsorted(done, np.arange(0, done[-1] if len(done) else 0, 1 << 20), "right"))
        ends_ = np.cumsum(sizes)
        parts = []
        for i, j in zip(cuts, [*cuts[1:], a.num_rows]):
            these = np.arange(ends_[i] - sizes[i], ends_[j - 1]) if j > i else np.zeros(0, np.int64)
            got = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for p, s in _spread(these, first[these], many[these]):
                near = (x0[s] <= east[p]) & (x1[s] >= west[p]) & (y0[s] <= north[p]) & (y1[s] >= south[p]) & (wide[s] | of_own[route[p]])
                p, s = p[near], s[near]
                meets = K.enters_box(px[p], py[p], dx[p], dy[p], x0[s], y0[s], x1[s], y1[s])
                p, s = p[meets], s[meets]
                got.append((p, s, K.inside_shares(sides.taken(s), px[p], py[p], qx[p], qy[p]) * length[p]))
            p, s, on = (np.concatenate(v) for v in zip(*got))
            pair, back = np.unique(route[p] * len(row_of_id) + ids[s], return_inverse=True)
            on = np.bincount(back, weights=on, minlength=len(pair))
            by, far = on.copy(), on < enough
            by[far] = 0.0
            for k in np.array_split(rest := np.flatnonzero(far[back]), len(rest) // SLICE + 1):
                o, u = p[k], s[k]
                share = K.union_length(*K.piece_spans(sides.taken(u), px[o], py[o], qx[o], qy[o], np.full(len(k), float(radius))))
                by += np.bincount(back[k], weights=share * length[o], minlength=len(pair))
            if len(pair):
                parts.append(totals(pair // len(row_of_id), row_of_id[pair % len(row_of_id)], on, by, b))
        out = pa.concat_tables(parts) if parts else None
        if out is None:
            return pa.Table.from_batches([], to_arrow_schema(schema))
        return out.drop_columns(["row_"]).add_column(0, key, a.column(key).take(out.column("row_").combine_chunks()))

    return together(left, right, keys, step, schema)
