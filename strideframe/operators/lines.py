"""Lines: pieces, distance along, even samples, and measures between samples.

A line is one array value per row, so its vertices never need a sort across
tasks. Measures between samples of a route are taken in the route's row, or meet
on grid cells within the route and stop at the first hit (semi join).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from ..functions import geo
from . import kernels as K
from .cellwise import _spread, nearest_piece
from .grid import box_box_pairs, box_cells, meet
from .ordering import chunked_total, with_halo


#: width of the cells in which samples of a line meet, in radii
CELL_RADII = 4.0


def pieces(lines: DataFrame, key: Sequence[str], line: str = "line") -> DataFrame:
    """Consecutive vertex pairs in draw order."""
    return lines.select(*key, F.posexplode(geo.line_edges(F.col(line))).alias("i", "e")).select(*key, "i", "e.*")


_MEASURED = ArrayType(StructType([StructField("i", IntegerType()), *[StructField(c, DoubleType()) for c in ("x1", "y1", "x2", "y2", "len", "end_m", "start_m")]]))
_SAMPLED = ArrayType(StructType([StructField("n", LongType()), *[StructField(c, DoubleType()) for c in ("along", "px", "py", "total")]]))


class _Runs:
    """Pieces of a batch of lines: their line, ends, length and the distance at their end; a NULL line has none."""

    def __init__(self, line: pa.Array):
        line = line.combine_chunks() if isinstance(line, pa.ChunkedArray) else line
        flat = line.flatten()
        x, y = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
        size = np.nan_to_num(line.value_lengths().to_numpy(zero_copy_only=False)).astype(int)
        self.count = np.maximum(size - 1, 0)
        self.line = np.repeat(np.arange(len(size)), self.count)
        first = np.cumsum(self.count) - self.count
        self.i = np.arange(len(self.line)) - first[self.line]
        v = (np.cumsum(size) - size)[self.line] + self.i
        self.x1, self.y1, self.x2, self.y2 = x[v], y[v], x[v + 1], y[v + 1]
        self.length = np.hypot(self.x2 - self.x1, self.y2 - self.y1)
        self.end = self.length.copy()
        # summed piece by piece, for all lines that have that many pieces at once
        live, k = np.flatnonzero(self.count > 1), 1
        while len(live):
            at = first[live] + k
            self.end[at] += self.end[at - 1]
            k += 1
            live = live[self.count[live] > k]
        self.last = (first + self.count - 1)[self.count > 0]


def _as_lists(sizes: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c) for c in columns.values()], names=list(columns)))


@F.arrow_udf(_MEASURED)
def _measure(line: pa.Array) -> pa.Array:
    r = _Runs(line)
    return _as_lists(r.count, {"i": r.i.astype(np.int32), "x1": r.x1, "y1": r.y1, "x2": r.x2, "y2": r.y2, "len": r.length, "end_m": r.end, "start_m": r.end - r.length})


@F.arrow_udf(_SAMPLED)
def _sample(line: pa.Array, step: pa.Array) -> pa.Array:
    r, s = _Runs(line), np.asarray(step.to_numpy(zero_copy_only=False), float)
    # a piece holds the samples after those that the piece before it reaches; the end point comes after its line's last
    reach = np.floor(r.end / s[r.line] + 1e-9)
    if not np.isfinite(reach).all():
        raise ValueError("a line with a missing coordinate has no even samples")
    reach = reach.astype(np.int64)
    before = np.where(r.i > 0, np.concatenate([[-1], reach[:-1]])[:len(reach)], -1)
    held = reach - before
    is_end = np.zeros(len(r.line), np.int64)
    is_end[r.last] = 1
    piece = np.repeat(np.arange(len(r.line)), held + is_end)
    nth = np.arange(len(piece)) - (np.cumsum(held + is_end) - held - is_end)[piece]
    n = before[piece] + 1 + nth
    end = nth == held[piece]
    at, length = n * s[r.line[piece]], r.length[piece]
    share = np.where(length > 0, (at - (r.end[piece] - length)) / np.where(length > 0, length, 1), 0).clip(0, 1)
    total = np.zeros(len(r.count))
    total[r.line[r.last]] = r.end[r.last]
    total = total[r.line[piece]]
    px = np.where(end, r.x2[piece], r.x1[piece] + share * (r.x2[piece] - r.x1[piece]))
    py = np.where(end, r.y2[piece], r.y1[piece] + share * (r.y2[piece] - r.y1[piece]))
    sizes = np.bincount(r.line[piece], minlength=len(r.count))
    return _as_lists(sizes, {"n": n, "along": np.where(end, total, at), "px": px, "py": py, "total": total})


def measured(line: Column) -> Column:
    """Pieces of a line in draw order with their length and the distance at their start and end, as an array in its row."""
    return _measure(line)


def along(lines: DataFrame, key: Sequence[str], line: str = "line") -> DataFrame:
    """Pieces in draw order with their length and the distance at their start and end.

    Measured in the row of the line: nothing is shuffled.
    """
    return lines.select(*key, F.explode(_measure(F.col(line))).alias("e")).select(*key, "e.*")


def samples(lines: DataFrame, key: Sequence[str], step: float, line: str = "line", nested: bool = False) -> DataFrame:
    """Points every ``step`` metres from the start, plus the end point.

    Columns: key, ``n`` (0, 1, 2 ...), ``along``, ``px``, ``py``, ``total``; or
    key and all of these in one array ``samples`` per line (``nested``), for
    measures that need no other line. Measured in the row of the line: nothing
    is shuffled.
    """
    if nested:
        # a nondeterministic function is not evaluated again where its result is filtered
        return lines.select(*key, _sample.asNondeterministic()(F.col(line), F.lit(float(step))).alias("samples")).filter(F.size("samples") > 0)
    return lines.select(*key, F.explode(_sample(F.col(line), F.lit(float(step)))).alias("s")).select(*key, "s.*")


def _cells(df: DataFrame, side: float) -> DataFrame:
    return df.withColumn("cx", F.floor(F.col("px") / side)).withColumn("cy", F.floor(F.col("py") / side))


def listed_near(df: DataFrame, radius: float) -> DataFrame:
    """The row listed in the cells its radius meets: cells ``CELL_RADII`` times as wide, so some two of them and not nine."""
    x, y = F.col("px"), F.col("py")
    c = df.withColumn("c_", F.explode(box_cells(x - radius, y - radius, x + radius, y + radius, CELL_RADII * radius)))
    return c.select(*df.columns, F.col("c_.cx").alias("cx"), F.col("c_.cy").alias("cy"))


def near_any(left: DataFrame, right: DataFrame, key: Sequence[str], radius: float, extra: Column | None = None) -> DataFrame:
    """Left samples with a right sample of the same key within ``radius``.

    Right columns are prefixed ``r_`` in ``extra``. One row per left sample at
    most, however many neighbours there are.
    """
    r = _cells(right, CELL_RADII * radius).select(*[F.col(c).alias(c if c in (*key, "cx", "cy") else f"r_{c}") for c in [*right.columns, "cx", "cy"]])
    cond = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in (*key, "cx", "cy")]
    cond.append((F.col("px") - F.col("r_px")) * (F.col("px") - F.col("r_px")) + (F.col("py") - F.col("r_py")) * (F.col("py") - F.col("r_py")) <= radius * radius)
    if extra is not None:
        cond.append(extra)
    hit = listed_near(left, radius).alias("l").join(r.alias("r"), cond, "left_semi")
    return hit.drop("cx", "cy").distinct()


class _Samples:
    """Samples of a batch of lines: their line, and the columns of ``samples``."""

    def __init__(self, samples_: pa.Array):
        samples_ = samples_.combine_chunks() if isinstance(samples_, pa.ChunkedArray) else samples_
        flat = samples_.flatten()
        sizes = np.nan_to_num(samples_.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        self.lines, self.count = len(sizes), sizes
        self.line = np.repeat(np.arange(len(sizes)), sizes)
        self.n = flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
        self.along, self.px, self.py, self.total = (flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("along", "px", "py", "total"))

    def from_start(self, sx: pa.Array, sy: pa.Array) -> np.ndarray:
        """Distance of each sample from the start of its line, NaN without a start."""
        sx, sy = (v.to_numpy(zero_copy_only=False).astype(float)[self.line] for v in (sx, sy))
        return np.sqrt((self.px - sx) ** 2 + (self.py - sy) ** 2)

    def per_line(self, value: np.ndarray) -> np.ndarray:
        return np.bincount(self.line[value], minlength=self.lines)

    def near(self, ask: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a sample of ``ask`` and one of the same line that may be within ``radius``, some at a time.

        Samples are sorted into strips of the line, as high as the radius, and by x within.
        """
        low_x, low_y = np.full(self.lines, np.inf), np.full(self.lines, np.inf)
        np.minimum.at(low_x, self.line, self.px)
        np.minimum.at(low_y, self.line, self.py)
        x, strip = self.px - low_x[self.line], np.floor((self.py - low_y[self.line]) / radius).astype(np.int64)
        many = strip.max(initial=0) + 3
        code = self.line * many + strip + 1
        strips, rank = np.unique(code, return_inverse=True)
        jump = x.max(initial=0.0) + 4 * radius
        place = rank * jump + x
        order = np.argsort(place, kind="stable")
        place = place[order]
        reach = radius + 1e-15 * len(strips) * jump  # rounding of the places
        for off in (-1, 0, 1):
            at = np.minimum(np.searchsorted(strips, code[ask] + off), len(strips) - 1)
            there = np.flatnonzero(strips[at] == code[ask] + off)
            base, own = at[there] * jump, ask[there]
            first = np.searchsorted(place, base + np.maximum(x[own] - reach, -radius), "left")
            last = np.searchsorted(place, base + x[own] + reach, "right")
            for owner, p in _spread(own, first, np.maximum(last - first, 0)):
                yield owner, order[p]


def _in_rows(smp: DataFrame, key: Sequence[str], starts: DataFrame | None) -> DataFrame:
    """One row per line with its ``samples`` and start ``sx, sy``; lines of no key or no start are left out."""
    if "samples" not in smp.columns:
        smp = smp.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("n", "along", "px", "py", "total"))).alias("samples"))
    return smp.dropna(subset=list(key)) if starts is None else smp.join(starts, list(key))


def revisit_ratio(smp: DataFrame, key: Sequence[str], starts: DataFrame | None = None, near: float = 15.0, apart: float = 95.0, stub: float = 80.0) -> DataFrame:
    """Share of the later samples that come back onto ground already walked.

    A line is measured in its row: pairs of its samples are no rows. ``smp`` is
    flat, or ``nested``; without ``starts`` (one per line) its rows have ``sx, sy``.
    """

    @F.arrow_udf(StructType([StructField(c, LongType()) for c in ("n_all", "scored", "hits")] + [StructField("total", DoubleType())]))
    def measure(samples_: pa.Array, sx: pa.Array, sy: pa.Array) -> pa.Array:
        s = _Samples(samples_)
        gap = s.from_start(sx, sy)
        at_start, later = gap <= stub, s.along >= s.total * 0.18
        hit = np.zeros(len(s.line), bool)
        for p, q in s.near(np.flatnonzero(later & ~np.isnan(gap)), near):
            fresh = ~hit[p]
            p, q = p[fresh], q[fresh]
            dx, dy = s.px[p] - s.px[q], s.py[p] - s.py[q]
            hit[p[(dx * dx + dy * dy <= near * near) & (s.along[p] - s.along[q] >= apart) & ~(at_start[p] & at_start[q])]] = True
        total = np.full(s.lines, -np.inf)
        np.maximum.at(total, s.line, s.total)
        return pa.StructArray.from_arrays([pa.array(v) for v in (s.count, s.per_line(later), s.per_line(hit), total)], names=["n_all", "scored", "hits", "total"])

    m = _in_rows(smp, key, starts).select(*key, measure.asNondeterministic()("samples", "sx", "sy").alias("m_")).select(*key, "m_.*")
    ratio = F.col("hits") / F.col("scored")
    return m.select(*key, F.when((F.col("n_all") < 8) | (F.col("total") < 120) | (F.col("scored") == 0), 1.0).otherwise(ratio).alias("revisit"), "total")


def spur_measure(
    smp: DataFrame, key: Sequence[str], starts: DataFrame | None = None, near: float = 15.0, shortest: float = 60.0, longest: float = 160.0, stub: float = 80.0
) -> DataFrame:
    """Longest and total out-and-back notches of a circuit.

    A line is measured in its row, as by ``revisit_ratio``. Partners lie 2 x
    shortest to 2 x longest further along, so a sample meets a few however often
    the line comes by.
    """

    @F.arrow_udf(StructType([StructField(c, DoubleType()) for c in ("worst_spur_m", "total_spur_m")]))
    def measure(samples_: pa.Array, sx: pa.Array, sy: pa.Array) -> pa.Array:
        s = _Samples(samples_)
        live = (s.from_start(sx, sy) > stub) & (s.count[s.line] >= 10)
        late = np.flatnonzero(live & (s.n >= 2) & (s.along >= stub) & (s.along <= s.total - stub))
        early = np.flatnonzero(live & (s.along >= stub * 0.5))
        jump = s.along.max(initial=0.0) + 4 * longest
        place = s.line[early] * jump + s.along[early]
        early = early[np.argsort(place, kind="stable")]
        place = s.line[early] * jump + s.along[early]
        slack = 1e-15 * s.lines * jump  # rounding of the places
        base = s.line[late] * jump + s.along[late]
        first = np.searchsorted(place, base - 2 * longest - slack, "left")
        last = np.searchsorted(place, base - 2 * shortest + slack, "right")
        steps = s.n.max(initial=0) + 1
        code = s.line * steps + s.n
        by_code = np.argsort(code, kind="stable")
        code = code[by_code]
        found = [(np.zeros(0, np.int64),) * 2]
        for p, q in _spread(late, first, np.maximum(last - first, 0)):
            q = early[q]
            sep = s.along[p] - s.along[q]
            ok = (s.line[p] == s.line[q]) & (sep >= 2 * shortest) & (sep <= 2 * longest) & (np.sqrt((s.px[p] - s.px[q]) ** 2 + (s.py[p] - s.py[q]) ** 2) <= near)
            p, q, spur = p[ok], q[ok], sep[ok] / 2
            want = s.line[p] * steps + (s.n[p] + s.n[q]) // 2
            tip = np.minimum(np.searchsorted(code, want), len(code) - 1)
            there, tip = code[tip] == want, by_code[tip]
            away = np.sqrt((s.px[tip] - s.px[q]) ** 2 + (s.py[tip] - s.py[q]) ** 2)
            real = there & (away >= np.maximum(50.0, spur * 0.6)) & (away <= spur * 1.35)
            found.append((p[real], q[real]))
        p, q = (np.concatenate(v) for v in zip(*found))
        # of a sample's partners the last one counts
        order = np.lexsort((s.n[q], s.n[p], s.line[p]))
        p, q = p[order], q[order]
        ends = np.append((s.line[p][1:] != s.line[p][:-1]) | (s.n[p][1:] != s.n[p][:-1]), True)[:len(p)]
        p, q = p[ends], q[ends]
        spur, bucket = (s.along[p] - s.along[q]) / 2, np.floor(s.along[q] / 50)
        worst = np.zeros(s.lines)
        np.maximum.at(worst, s.line[p], spur)
        # of a bucket's spurs the first one adds up
        order = np.lexsort((s.n[p], bucket, s.line[p]))
        line, bucket = s.line[p][order], bucket[order]
        firsts = np.append(True, (line[1:] != line[:-1]) | (bucket[1:] != bucket[:-1]))[:len(p)]
        total = np.bincount(line[firsts], weights=spur[order][firsts], minlength=s.lines)
        return pa.StructArray.from_arrays([pa.array(worst), pa.array(total)], names=["worst_spur_m", "total_spur_m"])

    return _in_rows(smp, key, starts).select(*key, measure.asNondeterministic()("samples", "sx", "sy").alias("m_")).select(*key, "m_.*")


def every_kth(smp: DataFrame, key: Sequence[str], parts: int) -> DataFrame:
    """Samples thinned to about ``parts`` per line, ``size_`` before that; nested ones in their row."""
    if "samples" in smp.columns:
        k = F.greatest(F.lit(1), F.floor(F.col("size_") / parts))
        return smp.withColumn("size_", F.size("samples")).withColumn("samples", F.filter("samples", lambda s: s["n"] % k == 0))
    size = smp.groupBy(*key).agg(F.count(F.lit(1)).alias("size_"))
    k = F.greatest(F.lit(1), F.floor(F.col("size_") / parts))
    return smp.join(size, list(key)).filter(F.col("n") % k == 0)


@F.arrow_udf(LongType())
def _near_count(a: pa.Array, b: pa.Array, radius: pa.Array) -> pa.Array:
    """Points of each first list within the radius of a point of the second one."""
    out = [np.zeros(0, np.int64)]
    for k in range(0, len(a), 512):
        left, right, r = (v.slice(k, 512) for v in (a, b, radius))
        p, q, r = left.flatten(), right.flatten(), r.to_numpy(zero_copy_only=False)
        px, py, qx, qy = (v.field(c).to_numpy(zero_copy_only=False) for v in (p, q) for c in ("px", "py"))
        (row, _), sizes = K._places(K._lengths(left)), K._lengths(right)
        first = np.cumsum(sizes) - sizes
        hit = np.zeros(len(row), bool)
        for i, j in _spread(np.arange(len(row)), first[row], sizes[row]):
            hit[i[(px[i] - qx[j]) ** 2 + (py[i] - qy[j]) ** 2 <= r[row[i]] ** 2]] = True
        out.append(np.bincount(row[hit], minlength=len(left)))
    return pa.array(np.concatenate(out))


def sample_overlaps(left: DataFrame, right: DataFrame, key: str, request: str, radius: float, side: float = 2000.0) -> DataFrame:
    """For lines of one request that come near each other: share of the first line's samples within ``radius`` of one of the second's.

    Both sides are nested samples, one row per line. Lines meet by the boxes of
    their samples, which travel as arrays: a sample is no row.
    """
    other, points = f"{key}_b", F.transform("samples", lambda s: F.struct(s["px"], s["py"]))

    def boxed(df: DataFrame, name: str, array: str, pre: str) -> DataFrame:
        ends = [f(F.col("samples")[c]).alias(f"{pre}{n}") for f, c, n in ((F.array_min, "px", "minx"), (F.array_min, "py", "miny"), (F.array_max, "px", "maxx"), (F.array_max, "py", "maxy"))]
        return df.select(F.col(key).alias(name), request, points.alias(array), *ends)

    pairs = box_box_pairs(boxed(left, key, "a_", ""), boxed(right, other, "b_", "r"), side, radius, on=[request]).filter(F.col(key) != F.col(other))
    hits = pairs.withColumn("hits_", _near_count.asNondeterministic()("a_", "b_", F.lit(float(radius)))).filter("hits_ > 0")
    return hits.select(key, other, (F.col("hits_") / F.size("a_")).alias("overlap"))


def _groups(batch: pa.RecordBatch, key: Sequence[str]) -> np.ndarray:
    """Number of the group that each row of a batch is in, by equal columns ``key``; NULL equals NULL."""
    group = np.zeros(batch.num_rows, np.int64)
    for c in key:
        code = pc.dictionary_encode(batch.column(c), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        group = np.unique(group * (code.max() + 1) + code, return_inverse=True)[1]
    return group


def union_of_batch(batch: pa.RecordBatch, key: Sequence[str]) -> pa.RecordBatch:
    """Intervals ``lo, hi`` of a batch as disjoint ones per ``key``; ends are taken as they are, none is computed."""
    group = _groups(batch, key)
    lo, hi = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi"))
    order = np.lexsort((lo, group))
    ends, rank = np.unique(hi, return_inverse=True)
    reach = np.maximum.accumulate((group * len(ends) + rank)[order])
    fresh = np.ones(len(order), bool)
    fresh[1:] = (group[order][1:] != group[order][:-1]) | (lo[order][1:] > ends[reach[:-1] % len(ends)])
    at = np.flatnonzero(fresh)
    last = np.append(at[1:], len(order)) - 1
    kept = batch.take(pa.array(order[at]))
    return kept.set_column(kept.schema.get_field_index("hi"), kept.schema.field("hi"), pa.array(ends[reach[last] % len(ends)]))


def first_of_batch(batch: pa.RecordBatch, key: Sequence[str], order: Sequence[str]) -> pa.RecordBatch:
    """The first row by ``order`` (NULL before all values) of each group of a batch."""
    rows = pa.Table.from_batches([batch]).append_column("group_", pa.array(_groups(batch, key)))
    # NULL first, as Spark orders it
    at = pc.sort_indices(rows, sort_keys=[("group_", "ascending"), *[(c, "ascending") for c in order]], null_placement="at_start").to_numpy()
    group = rows.column("group_").to_numpy()[at]
    return batch.take(pa.array(at[np.append(True, group[1:] != group[:-1])]))


def in_batches(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """Rows thinned batch by batch where they are, before they are sorted or travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return df.mapInArrow(run, df.schema)


def merged_spans(intervals: DataFrame, key: Sequence[str]) -> DataFrame:
    """Intervals ``key, i, lo, hi`` merged per batch: those of a piece come one after another from a join, so few are left."""
    key = list(key)
    return in_batches(intervals.select(*key, "i", "lo", "hi"), lambda batch: union_of_batch(batch, [*key, "i"]))


def first_rows(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """At least the first row of each ``key`` by ``order``, and at most one per batch."""
    key, order = list(key), list(order)
    return in_batches(df, lambda batch: first_of_batch(batch, key, order))


def covered_metres(pieces_: DataFrame, intervals: DataFrame, key: Sequence[str]) -> DataFrame:
    """Length of the union of [lo, hi] shares per piece, summed per key.

    ``intervals`` has key, ``i``, ``lo``, ``hi``: those of ``merged_spans``, or of
    ``cover_intervals``, a few per piece and batch or cell. They are merged per
    piece with a running maximum, which streams.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*key, "i").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0.0), F.col("hi") - F.greatest(F.col("lo"), F.coalesce(F.max("hi").over(w), F.lit(0.0))))
    share = intervals.select(*key, "i", "lo", "hi").withColumn("f_", fresh).groupBy(*key, "i").agg(F.sum("f_").alias("f_"))
    length = geo.span(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return meet(pieces_.withColumn("len_", length), share, [*key, "i"], "left").groupBy(*key).agg(
        F.sum("len_").alias("length_m"), F.sum(F.coalesce("f_", F.lit(0.0)) * F.col("len_")).alias("covered_m"))


def _shifts(raw: str, firm: float, sharp: float, weak: float):
    """``side_shift`` of nested samples, as a function of their array."""

    @F.arrow_udf(ArrayType(StructType([StructField("n", LongType()), StructField(raw, DoubleType()), StructField("shift", DoubleType())])))
    def shift(samples_: pa.Array) -> pa.Array:
        samples_ = samples_.combine_chunks() if isinstance(samples_, pa.ChunkedArray) else samples_
        flat, sizes = samples_.flatten(), K._lengths(samples_)
        n = flat.field("n")
        px, py, s = (flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("px", "py", raw))
        line, nth = K._places(sizes)
        at, rest = np.arange(len(line)), sizes[line] - 1 - nth
        back, ahead = at - np.minimum(nth, 2), at + np.minimum(rest, 2)
        e1, n1, e2, n2 = px - px[back], py - py[back], px[ahead] - px, py[ahead] - py
        l1, l2 = np.sqrt(e1 * e1 + n1 * n1), np.sqrt(e2 * e2 + n2 * n2)
        short = (l1 < 1) | (l2 < 1)
        dot = np.clip((e1 * e2 + n1 * n2) / np.where(short, 1.0, l1 * l2), -1.0, 1.0)
        fade = np.maximum(0.0, 1.0 - np.where(short, 0.0, np.degrees(np.arccos(dot))) / sharp)
        some = ~np.isnan(s) & (np.round(fade, 12) > weak)
        faded = np.where(some, s * fade, 0.0)
        # a run ends at a sample without a proposal, and at the end of its line
        run = np.cumsum(~some | (nth == 0))
        up, down = (np.bincount(run, weights=some & v, minlength=run[-1] + 1 if len(run) else 1)[run] for v in (faded > 0, faded < 0))
        trust = some & (np.maximum(up, down) / np.maximum(1, up + down) >= firm) & (faded * np.where(up >= down, 1, -1) >= 0)
        guarded = np.where(trust, faded, 0.0)

        def frame(v: np.ndarray, reach: int, missing: float) -> np.ndarray:
            cols = [np.where((nth + k >= 0) & (rest - k >= 0), v[np.clip(at + k, 0, max(0, len(v) - 1))], missing) for k in range(-reach, reach + 1)]
            return np.stack(cols, axis=1)

        held = np.minimum(nth, 2) + np.minimum(rest, 2) + 1
        middle = np.sort(frame(guarded, 2, np.inf), axis=1)[at, held // 2]
        mean = frame(middle, 1, 0.0).sum(axis=1) / (np.minimum(nth, 1) + np.minimum(rest, 1) + 1)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([n, pa.array(s, from_pandas=True), pa.array(mean)], names=["n", raw, "shift"]))

    return shift


def side_shift(smp: DataFrame, key: Sequence[str], raw: str, firm: float = 0.8, sharp: float = 45.0, weak: float = 0.15) -> DataFrame:
    """Steady sideways shift of every sample of a line from raw proposals, NULL where there is none.

    Proposals fade with the turn of the line and go out in sharp ones. A run of
    proposals whose signs disagree too much is dropped, the minority signs of
    the others too. The median of five and the mean of three smooth what is
    left. Frames reach over a few samples and runs are counted in chunks, so a
    line of any length is spread. Adds ``shift`` (0 where nothing is moved).
    Nested samples (``n, px, py`` and the proposals) are shifted in their row and
    come back as ``n``, the proposals and ``shift``: nothing is shuffled.
    """
    key = list(key)
    if "samples" in smp.columns:
        shifted = _shifts(raw, firm, sharp, weak).asNondeterministic()("samples")
        return smp.select(*[c for c in smp.columns if c != "samples"], shifted.alias("samples"))
    spread, w, home = with_halo(smp, key, "n", 2, 2)

    def two_off(c: str, step: Callable) -> Column:
        return F.coalesce(step(c, 2).over(w), step(c, 1).over(w), F.col(c))

    e1, n1 = F.col("px") - two_off("px", F.lag), F.col("py") - two_off("py", F.lag)
    e2, n2 = two_off("px", F.lead) - F.col("px"), two_off("py", F.lead) - F.col("py")
    at = spread.select("*", e1.alias("e1_"), n1.alias("n1_"), e2.alias("e2_"), n2.alias("n2_")).filter(home)
    l1, l2 = geo.span(F.col("e1_"), F.col("n1_")), geo.span(F.col("e2_"), F.col("n2_"))
    dot = (F.col("e1_") * F.col("e2_") + F.col("n1_") * F.col("n2_")) / (l1 * l2)
    turn = F.when((l1 < 1) | (l2 < 1), 0.0).otherwise(F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot)))))
    fade = F.greatest(F.lit(0.0), F.lit(1.0) - turn / sharp)
    faded = at.withColumn("k_", fade).select(*smp.columns, F.when(F.round("k_", 12) > weak, F.col(raw) * F.col("k_")).alias("s_"))
    runs = chunked_total(faded, key, "n", F.col("s_").isNull().cast("long"), "stretch_")
    signs = runs.filter("s_ IS NOT NULL").groupBy(*key, "stretch_").agg(F.count_if(F.col("s_") > 0).alias("up_"), F.count_if(F.col("s_") < 0).alias("down_"))
    agreed = runs.join(signs, [*key, "stretch_"], "left")
    main = F.when(F.col("up_") >= F.col("down_"), 1).otherwise(-1)
    trust = (F.greatest("up_", "down_") / F.greatest(F.lit(1), F.col("up_") + F.col("down_")) >= firm) & (F.col("s_") * main >= 0)
    guarded = agreed.withColumn("g_", F.coalesce(F.when(trust, F.col("s_")), F.lit(0.0))).select(*smp.columns, "g_")
    spread, w, home = with_halo(guarded, key, "n", 3, 3)
    frame = F.array_sort(F.collect_list("g_").over(w.rowsBetween(-2, 2)))
    mid = spread.withColumn("l_", frame).withColumn("m_", F.element_at("l_", (F.floor(F.size("l_") / 2) + 1).cast("int")))
    return mid.withColumn("shift", F.avg("m_").over(w.rowsBetween(-1, 1))).filter(home).select(*smp.columns, "shift")


def shift_report(shifted: DataFrame, key: Sequence[str], raw: str, least: float = 0.75) -> DataFrame:
    """Per line: samples, share that looks on the road, share that is moved; lines of fewer than three samples have neither."""
    if "samples" in shifted.columns:
        look, moved = F.filter("samples", lambda x: x[raw].isNotNull()), F.filter("samples", lambda x: F.abs(F.round(x["shift"], 9)) >= least)
        out = shifted.select(*key, *[F.size(v).cast("long").alias(c) for v, c in ((F.col("samples"), "n"), (look, "look_"), (moved, "moved_"))])
        return _shares_of(out, key)
    n = F.count(F.lit(1))
    look = F.count(raw)
    out = shifted.groupBy(*key).agg(n.alias("n"), look.alias("look_"), F.count_if(F.abs(F.round("shift", 9)) >= least).alias("moved_"))
    return _shares_of(out, key)


def _shares_of(out: DataFrame, key: Sequence[str]) -> DataFrame:
    some = (F.col("n") >= 3) & (F.col("look_") > 0)
    return out.select(*key, "n", F.when(some, F.col("look_") / F.col("n")).otherwise(0.0).alias("look_share"), F.when(some, F.col("moved_") / F.col("n")).otherwise(0.0).alias("moved_share"))


def sample_class_share(smp: DataFrame, probes: DataFrame, key: Sequence[str], probe: str, is_road: str, radius: float, least: int = 3, limit: float = 0.28, side: float = 200.0) -> DataFrame:
    """Share of a line's samples whose nearest probe is a carriageway, and whether that rejects the line.

    ``probes`` are straight pieces (``probe, x1..y2``) that are a road or not; a
    sample without one in reach is unknown, and a line with fewer than ``least``
    known samples has no share and is not rejected. Ties go to the smaller probe.
    """
    key = list(key)
    boxed = probes.select(probe, is_road, "x1", "y1", "x2", "y2", F.least("x1", "x2").alias("minx"), F.least("y1", "y2").alias("miny"), F.greatest("x1", "x2").alias("maxx"), F.greatest("y1", "y2").alias("maxy"))
    near = nearest_piece(boxed, smp.select(*key, "n", "px", "py"), [*key, "n"], probe, is_road, radius, side)
    # a sample has one row per level and share of its cell
    near = first_rows(near, [*key, "n"], ["gap_", probe])
    known = near.groupBy(*key, "n").agg(F.min_by(is_road, F.struct("gap_", probe)).alias("road_"))
    per = known.groupBy(*key).agg(F.count(F.lit(1)).alias("known"), F.count_if("road_").alias("roads_"))
    lines_ = meet(smp.select(*key).distinct(), per, key, "left")
    share = F.when(F.col("known") >= least, F.col("roads_") / F.col("known"))
    return lines_.select(*key, F.coalesce("known", F.lit(0)).alias("known"), share.alias("road_share"), F.coalesce(share > limit, F.lit(False)).alias("rejected"))
