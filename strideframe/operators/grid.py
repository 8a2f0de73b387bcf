"""Spatial joins as grid-cell equi-joins.

Each feature is listed under the cells its bounding box meets, the sides meet
by equality on the cell, and an exact predicate decides. Three things keep it
even at scale: rows at the same position are aggregated before they are
shuffled (callers do this), cells that hold too many rows are split into
shares, and nearest-neighbour search compares cells before it compares rows.
Sides that grow with the input are never broadcast (``meet``).

A box much wider than a cell is listed under cells of a coarser level (a quad
tree: each level doubles the side), and the other side is listed under just the
levels that occur, so no box needs more than ``MOST_CELLS`` cells of its level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle

BOX = ("minx", "miny", "maxx", "maxy")
CELL_TARGET = 50_000
TRACT = 500.0
#: cells along the longer side of a box, at most; one more may be touched
BOX_SPAN = 8
MOST_CELLS = (BOX_SPAN + 1) ** 2


def meet(left: DataFrame, right: DataFrame, keys: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Join by a shuffle of both sides, never by broadcast.

    Spark guesses a table's size from its files: a row listed under many cells
    counts once there, outlines built from a few numbers count as those numbers,
    and files of repeated numbers are a small part of what they hold in memory.
    Sides that grow with the input would pass the broadcast limit by that guess.
    """
    return left.join(right.hint("merge"), keys if isinstance(keys, str) else list(keys), how)


def box_cells(minx: Column, miny: Column, maxx: Column, maxy: Column, side: float | Column) -> Column:
    """Cells (cx, cy) a box meets."""
    xs = F.sequence(F.floor(minx / side), F.floor(maxx / side))
    ys = F.sequence(F.floor(miny / side), F.floor(maxy / side))
    return F.flatten(
        F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy"))))
    )


def box_level(minx: Column, miny: Column, maxx: Column, maxy: Column, side: float) -> Column:
    """Level of the cells a box is listed under: 0, or the first that it spans with ``BOX_SPAN`` cells."""
    span = F.greatest(maxx - minx, maxy - miny) / (side * BOX_SPAN)
    return F.when(span <= 1, 0).otherwise(F.ceil(F.log2(span)).cast("int"))


def levels_of(df: DataFrame, side: float, pad: float = 0.0, box: Sequence[str] = BOX) -> Column:
    """The levels that the boxes of a table have, as one small array (a level per doubling of size)."""
    a, b, c, d = (F.col(x) for x in box)
    return df.select(box_level(a - pad, b - pad, c + pad, d + pad, side).alias("l_")).distinct().agg(F.sort_array(F.collect_list("l_"))).scalar()


def by_cell(df: DataFrame, side: float, pad: float = 0.0, box: Sequence[str] = BOX, levels: Column | None = None) -> DataFrame:
    """One row per feature and cell its padded box meets, at its own level (``own``) and at the coarser ones of ``levels``."""
    a, b, c, d = (F.col(x) for x in box)
    edges = (a - pad, b - pad, c + pad, d + pad)
    listed = df.withColumn("own_", box_level(*edges, side))
    if levels is None:
        listed = listed.withColumn("lvl", F.col("own_"))
    else:
        listed = listed.withColumn("levels_", levels)
        listed = listed.withColumn("lvl", F.explode(F.array_union(F.array("own_"), F.filter("levels_", lambda x: x > F.col("own_")))))
    listed = listed.withColumn("cell_", F.explode(box_cells(*edges, F.lit(float(side)) * F.pow(F.lit(2.0), F.col("lvl")))))
    return listed.select(*df.columns, "lvl", F.col("cell_.cx").alias("cx"), F.col("cell_.cy").alias("cy"), (F.col("lvl") == F.col("own_")).alias("own"))


def split_hot_cells(
    left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, target: int = CELL_TARGET, cell: Sequence[str] = ("cx", "cy")
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Spread cells with more than ``target`` rows on either side over a grid of shares.

    In a cell that is a times ``target`` on the left and b times on the right,
    a left row takes one of a shares by hash and is repeated b times, a right
    row takes one of b and is repeated a times, so each pair meets once and no
    task holds more than ``target`` rows of either side. The list of hot cells
    is at most rows/target long, and only those cells are touched.
    """
    cell = list(cell)
    cells = left.select(*cell, F.lit(1).alias("l_"), F.lit(0).alias("r_")).unionByName(right.select(*cell, F.lit(0).alias("l_"), F.lit(1).alias("r_")))
    counts = cells.groupBy(*cell).agg(F.sum("l_").alias("l_"), F.sum("r_").alias("r_"))
    hot = counts.filter((F.col("l_") > target) & (F.col("r_") > 0) | (F.col("r_") > target) & (F.col("l_") > 0)).select(
        *cell, *[F.greatest(F.lit(1), F.ceil(F.col(c) / target)).cast("int").alias(f"{c}shares") for c in ("l_", "r_")])

    def shared(df: DataFrame, key: Column, own: str, other: str) -> DataFrame:
        mine = F.coalesce(F.pmod(F.xxhash64(key), F.col(f"{own}shares")).cast("int"), F.lit(0))
        theirs = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(f"{other}shares"), F.lit(1)) - 1))
        return df.join(hot, cell, "left").withColumn(f"{own}share", mine).withColumn(f"{other}share", theirs).drop("l_shares", "r_shares")

    return shared(left, left_key, "l_", "r_"), shared(right, right_key, "r_", "l_"), [*cell, "l_share", "r_share"]


def _row_key(df: DataFrame) -> Column:
    """The plain columns of a row, to hash it by."""
    return F.struct(*[c for c, t in df.dtypes if not t.startswith(("map", "array", "struct", "variant"))])


def box_point_cells(
    areas: DataFrame, points: DataFrame, side: float, pad: float = 0.0, px: str = "px", py: str = "py", split: bool = True,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Areas and points listed by cell, and the columns that are equal where they meet.

    An area is listed at its own level only, and a point lies in one cell of
    each level that areas have, so no pair meets twice.
    """
    left = by_cell(areas, side, pad).drop("own")
    right = points.withColumn("levels_", levels_of(areas, side, pad)).withColumn("lvl", F.explode("levels_")).drop("levels_")
    width = F.lit(float(side)) * F.pow(F.lit(2.0), F.col("lvl"))
    right = right.withColumns({"cx": F.floor(F.col(px) / width), "cy": F.floor(F.col(py) / width)})
    keys = ["lvl", "cx", "cy"]
    return split_hot_cells(left, right, _row_key(left), F.struct(px, py), cell=keys) if split else (left, right, keys)


def box_point_pairs(
    areas: DataFrame,
    points: DataFrame,
    side: float,
    pad: float = 0.0,
    px: str = "px",
    py: str = "py",
    split: bool = True,
    by_point: bool = False,
) -> DataFrame:
    """Pairs of an area row and a point row inside the area's padded box.

    Pairs come area by area in a cell, or point by point (``by_point``).
    """
    left, right, keys = box_point_cells(areas, points, side, pad, px, py, split)
    inside = (
        (F.col(px) >= F.col("minx") - pad)
        & (F.col(px) <= F.col("maxx") + pad)
        & (F.col(py) >= F.col("miny") - pad)
        & (F.col(py) <= F.col("maxy") + pad)
    )
    met = meet(right, left, keys) if by_point else meet(left, right, keys)
    return met.filter(inside).drop(*keys)


def box_box_cells(
    left: DataFrame,
    right: DataFrame,
    side: float,
    pad: float = 0.0,
    lbox: Sequence[str] = BOX,
    rbox: Sequence[str] = ("rminx", "rminy", "rmaxx", "rmaxy"),
    on: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides listed by cell, whether at their own level (``lown_``, ``rown_``), and the columns that are equal where they meet."""
    a = by_cell(left, side, pad, lbox, levels_of(right, side, 0.0, rbox)).withColumnRenamed("own", "lown_")
    b = by_cell(right, side, 0.0, rbox, levels_of(left, side, pad, lbox)).withColumnRenamed("own", "rown_")
    return split_hot_cells(a, b, _row_key(a), _row_key(b), cell=("lvl", "cx", "cy", *on))


def box_box_pairs(
    left: DataFrame,
    right: DataFrame,
    side: float,
    pad: float = 0.0,
    lbox: Sequence[str] = BOX,
    rbox: Sequence[str] = ("rminx", "rminy", "rmaxx", "rmaxy"),
    on: Sequence[str] = (),
) -> DataFrame:
    """Pairs whose boxes meet once the left one is padded, and whose columns ``on`` are equal.

    Two boxes meet at the coarser of their levels, where one is at its own. Both
    may span several cells there; a pair is kept only in the cell that holds the
    lower corner of the common box, so no duplicate has to be dropped.
    """
    a, b, keys = box_box_cells(left, right, side, pad, lbox, rbox, on)
    lx0, ly0, lx1, ly1 = (F.col(c) for c in lbox)
    rx0, ry0, rx1, ry1 = (F.col(c) for c in rbox)
    touch = (rx0 <= lx1 + pad) & (rx1 >= lx0 - pad) & (ry0 <= ly1 + pad) & (ry1 >= ly0 - pad)
    width = F.lit(float(side)) * F.pow(F.lit(2.0), F.col("lvl"))
    owner = (F.col("cx") == F.floor(F.greatest(lx0 - pad, rx0) / width)) & (
        F.col("cy") == F.floor(F.greatest(ly0 - pad, ry0) / width)
    )
    return meet(a, b, keys).filter((F.col("lown_") | F.col("rown_")) & touch & owner).drop(*[k for k in keys if k not in on], "lown_", "rown_")


def _gap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    return F.greatest(lo2 - hi1, lo1 - hi2, F.lit(0.0))


def _reach(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    return F.greatest(hi2 - lo1, hi1 - lo2)


def nearest_pairs(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    max_distance: float,
    side: float,
    distance: Column,
    best: Column,
    tie: Column,
    anchor: tuple[str, str] = ("ax_", "ay_"),
    right_box: Sequence[str] = ("rminx", "rminy", "rmaxx", "rmaxy"),
    right_overhang: float = 0.0,
) -> DataFrame:
    """Nearest right row for each left row, exact, within ``max_distance``.

    ``left`` carries its box (``minx..maxy``) and one of its own points
    (``anchor``). Rows on both sides are summarised per cell first. The widest
    possible distance from a left cell's anchors to any occupied cell nearby
    bounds the true nearest distance; only right cells that can come closer
    than that bound are kept, and only those are opened up to rows. ``side``
    should give a few right rows per cell. ``right_overhang`` is how far a
    right box may reach beyond the cell of its centre.
    """
    ax, ay = anchor
    r0, r1, r2, r3 = right_box
    levels = 0
    while side * 2**levels < max_distance + right_overhang:
        levels += 1

    rights = right.withColumn("rcx", F.floor((F.col(r0) + F.col(r2)) / 2 / side)).withColumn(
        "rcy", F.floor((F.col(r1) + F.col(r3)) / 2 / side)
    )
    rcells = rights.groupBy("rcx", "rcy").agg(
        F.min(r0).alias("qx0"), F.min(r1).alias("qy0"), F.max(r2).alias("qx1"), F.max(r3).alias("qy1")
    )
    lefts = left.withColumn("lcx", F.floor(F.col(ax) / side)).withColumn("lcy", F.floor(F.col(ay) / side))
    lcells = lefts.groupBy("lcx", "lcy").agg(
        F.min("minx").alias("bx0"), F.min("miny").alias("by0"), F.max("maxx").alias("bx1"), F.max("maxy").alias("by1"),
        F.min(ax).alias("ax0"), F.min(ay).alias("ay0"), F.max(ax).alias("ax1"), F.max(ay).alias("ay1"),
    )

    # occupied right cells at every coarseness
    coarse = rcells.withColumn("lvl", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn(
        "gx", F.floor(F.col("rcx") / F.pow(F.lit(2.0), F.col("lvl")))
    ).withColumn("gy", F.floor(F.col("rcy") / F.pow(F.lit(2.0), F.col("lvl"))))
    boxes = coarse.groupBy("lvl", "gx", "gy").agg(
        F.min("qx0").alias("qx0"), F.min("qy0").alias("qy0"), F.max("qx1").alias("qx1"), F.max("qy1").alias("qy1")
    )
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    probes = (
        lcells.withColumn("lvl", F.explode(F.sequence(F.lit(0), F.lit(levels))))
        .withColumn("d_", F.explode(around))
        .withColumn("gx", F.floor(F.col("lcx") / F.pow(F.lit(2.0), F.col("lvl"))) + F.col("d_.i"))
        .withColumn("gy", F.floor(F.col("lcy") / F.pow(F.lit(2.0), F.col("lvl"))) + F.col("d_.j"))
    )
    far_x = _reach(F.col("ax0"), F.col("ax1"), F.col("qx0"), F.col("qx1"))
    far_y = _reach(F.col("ay0"), F.col("ay1"), F.col("qy0"), F.col("qy1"))
    far = F.sqrt(far_x * far_x + far_y * far_y)
    bound = (
        meet(probes, boxes, ["lvl", "gx", "gy"])
        .groupBy("lcx", "lcy")
        .agg(F.min(far).alias("u_"))
    )
    bounded = meet(lcells, bound, ["lcx", "lcy"], "left").withColumn(
        "u_", F.least(F.col("u_"), F.lit(float(max_distance)))
    )

    # right cells that can beat the bound
    grow = F.col("u_") + right_overhang
    width = F.greatest(grow, (F.col("bx1") - F.col("bx0")) / 4, (F.col("by1") - F.col("by0")) / 4, F.lit(float(side)))
    lvl = F.least(F.lit(levels), F.greatest(F.lit(0), F.ceil(F.log2(width / side)).cast("int")))
    cell = F.lit(float(side)) * F.pow(F.lit(2.0), F.col("lvl"))
    wanted = bounded.withColumn("lvl", lvl).withColumn(
        "c_",
        F.explode(
            F.flatten(
                F.transform(
                    F.sequence(F.floor((F.col("bx0") - grow) / cell), F.floor((F.col("bx1") + grow) / cell)),
                    lambda x: F.transform(
                        F.sequence(F.floor((F.col("by0") - grow) / cell), F.floor((F.col("by1") + grow) / cell)),
                        lambda y: F.struct(x.alias("gx"), y.alias("gy")),
                    ),
                )
            )
        ),
    ).withColumn("gx", F.col("c_.gx")).withColumn("gy", F.col("c_.gy"))
    near_x = _gap(F.col("bx0"), F.col("bx1"), F.col("qx0"), F.col("qx1"))
    near_y = _gap(F.col("by0"), F.col("by1"), F.col("qy0"), F.col("qy1"))
    pairs = settle(
        meet(wanted, coarse, ["lvl", "gx", "gy"])
        .filter(near_x * near_x + near_y * near_y <= F.col("u_") * F.col("u_") * (1 + 1e-9))
        .select("lcx", "lcy", "rcx", "rcy", "qx0", "qy0", "qx1", "qy1"),
        "cell-pairs",
    )
    # per left row: a first exact distance from the closest cell, then only what can beat it
    cx_gap = _gap(F.col("minx"), F.col("maxx"), F.col("qx0"), F.col("qx1"))
    cy_gap = _gap(F.col("miny"), F.col("maxy"), F.col("qy0"), F.col("qy1"))
    cell_gap = F.sqrt(cx_gap * cx_gap + cy_gap * cy_gap)
    spans = meet(lefts.select(left_id, "lcx", "lcy", "minx", "miny", "maxx", "maxy"), pairs, ["lcx", "lcy"])
    first = (
        spans.groupBy(left_id)
        .agg(F.min_by(F.struct("rcx", "rcy"), F.struct(cell_gap, F.col("rcx"), F.col("rcy"))).alias("c_"))
        .select(left_id, "c_.rcx", "c_.rcy")
    )
    probe = meet(meet(left, first, left_id), rights, ["rcx", "rcy"])
    limit = settle(
        probe.withColumn("dist_", distance).groupBy(left_id)
        .agg(F.least(F.min("dist_"), F.lit(float(max_distance))).alias("limit_")),
        "limits",
    )
    rx_gap = _gap(F.col("minx"), F.col("maxx"), F.col(r0), F.col(r2))
    ry_gap = _gap(F.col("miny"), F.col("maxy"), F.col(r1), F.col(r3))
    slack = F.col("limit_") + 1e-6
    rows = (
        meet(meet(meet(lefts, limit, left_id), pairs, ["lcx", "lcy"]).filter(cell_gap <= slack), rights, ["rcx", "rcy"])
        .filter(rx_gap * rx_gap + ry_gap * ry_gap <= slack * slack)
    )
    rows = rows.withColumn("dist_", distance).filter(F.col("dist_") <= max_distance)
    return (
        rows.groupBy(left_id)
        .agg(F.min_by(F.struct(F.col("dist_").alias("distance"), best), F.struct(F.col("dist_"), tie)).alias("n_"))
        .select(left_id, "n_.*")
    )


def cell_side(points: DataFrame, px: str, py: str, per_cell: float = 2.0, floor: float = 1.0) -> float:
    """Cell side that leaves a few distinct positions per cell, from one aggregate row.

    The area counted is that of occupied tracts of ``TRACT`` metres, so a few
    points far out, or empty land between clusters, do not widen the cells.
    """
    tract = F.struct(F.floor(F.col(px) / TRACT), F.floor(F.col(py) / TRACT))
    row = points.agg(
        F.min(px), F.max(px), F.min(py), F.max(py), F.approx_count_distinct(F.struct(px, py)), F.approx_count_distinct(tract)
    ).first()
    if row is None or row[0] is None:
        return floor
    area = min(max(1.0, row[1] - row[0]) * max(1.0, row[3] - row[2]), max(1, row[5]) * TRACT * TRACT)
    return max(floor, (area * per_cell / max(1, row[4])) ** 0.5)
