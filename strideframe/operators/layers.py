"""City layers joined onto path segments.

A segment row carries ``segment_id``, its box ``minx..maxy``, an anchor point
``x, y`` inside it and its outline ``ring``. Outlines of segments and areas may
be ``parts`` with holes instead (see ``outlined``). Point layers are aggregated by
position before they travel, so any number of copies of one point is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..session import settle
from . import kernels as K
from .cellwise import first_holding, first_touching, metres_inside, near_totals, nearest_outline, touched
from .grid import box_box_pairs, box_point_pairs, cell_side, meet, nearest_pairs
from .lines import covered_metres, merged_spans

# Fixed values of the joins, metres.
CORRIDOR_M = 25.0
LIGHT_NEAR_M, LIGHT_FAR_M, PARK_LIGHT_M, BENCH_M = 30.0, 50.0, 50.0, 50.0
FOUNTAIN_BANDS = (100, 200)
CROSSING_BANDS = (20, 50)
CRASH_YEARS = 5
#: positions wished for in a cell whose pairs are measured in one task, and how much wider it may get for them
GROUP_POINTS, GROUP_SIDES = 2000.0, 16.0
#: positions in the mean box of an outline from which on outlines look inside first, in cells of that side
HOLDING, HOLDING_SIDE = 1.0, 250.0
SHAPE = ("segment_id", "minx", "miny", "maxx", "maxy", "ring")
ANCHORED = (*SHAPE, "x", "y")


def outlined(df: DataFrame) -> DataFrame:
    """The rows with their outline in ``ring``: ``parts`` of rings with holes take its place where they are given."""
    return df.withColumn("ring", F.col("parts")).drop("parts") if "parts" in df.columns else df


def has_parts(df: DataFrame) -> bool:
    return dict(df.dtypes)["ring"].startswith("array<array")


def outline_area(df: DataFrame) -> Column:
    """Area of the outline in ``ring``, of either kind."""
    return geo.parts_area(F.col("ring")) if has_parts(df) else F.abs(geo.ring_area(F.col("ring")))


def outline_holds(df: DataFrame, px: Column, py: Column) -> Column:
    """Whether the outline in ``ring`` holds a point, of either kind."""
    return geo.in_parts(F.col("ring"), px, py) if has_parts(df) else geo.in_ring(geo.ring_edges(F.col("ring")), px, py)


def at_positions(points: DataFrame, aggs: dict[str, Column], px: str = "px", py: str = "py") -> DataFrame:
    """Points collapsed to distinct positions with their aggregates."""
    return (
        points.filter(F.col(px).isNotNull() & F.col(py).isNotNull())
        .groupBy(F.col(px).alias("px"), F.col(py).alias("py"))
        .agg(*[v.alias(k) for k, v in aggs.items()])
    )


def near_pairs(segments: DataFrame, positions: DataFrame, radius: float, side: float | None = None) -> DataFrame:
    """Segment and position pairs within ``radius`` of the outline, distance included."""
    pairs = box_point_pairs(outlined(segments).select(*SHAPE), positions, side or max(100.0, 4 * radius), radius)
    dist = K.ring_point_distance("ring", "px", "py")
    return pairs.withColumn("dist", dist).filter(F.col("dist") <= radius).drop("ring", *SHAPE[1:5])


def corridor_stats(
    segments: DataFrame, points: DataFrame, radius: float, pre: dict[str, Column], post: dict[str, Column],
    px: str = "px", py: str = "py", bands: tuple[float, ...] = (), largest: tuple[str, ...] = (),
) -> DataFrame:
    """Aggregates of the points near each segment, from one join for any number of measures.

    The aggregates ``pre`` of a position are summed over the positions near a
    segment, or the largest is taken (``largest``), in the cell where both meet
    (see ``cellwise``). ``post`` sees such totals, with the smallest of ``bands``
    and ``radius`` that holds them as ``dist``.
    """
    side = max(100.0, 4 * radius)
    side = max(side, min(GROUP_SIDES * side, cell_side(points, px, py, per_cell=GROUP_POINTS)))
    totals = near_totals(outlined(segments).select(*SHAPE), at_positions(points, pre, px, py), "segment_id", (*bands, radius), largest, side)
    return totals.groupBy("segment_id").agg(*[v.alias(k) for k, v in post.items()])


def filled(segments: DataFrame, stats: DataFrame, zeros: tuple[str, ...] = (), falses: tuple[str, ...] = ()) -> DataFrame:
    """Every segment once; counts without a match are 0, flags false."""
    out = segments.select("segment_id").join(stats, "segment_id", "left")
    for c in zeros:
        out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    for c in falses:
        out = out.withColumn(c, F.coalesce(c, F.lit(False)))
    return out


def count_within(segments: DataFrame, points: DataFrame, bands: dict[str, float], px: str = "px", py: str = "py") -> DataFrame:
    """Counts for several radii from the join of the widest one."""
    pre = {"n_": F.count(F.lit(1))}
    post = {name: F.sum(F.when(F.col("dist") <= r, F.col("n_")).otherwise(0)) for name, r in bands.items()}
    return filled(segments, corridor_stats(segments, points, max(bands.values()), pre, post, px, py, tuple(bands.values())), tuple(bands))


def nearest_point(
    segments: DataFrame, points: DataFrame, key: str, max_distance: float, side: float, out: str,
    extra: dict[str, str] | None = None, px: str = "px", py: str = "py",
) -> DataFrame:
    """Distance to the nearest point (ties to the smallest key) and columns of that point.

    ``side`` is the widest cell; denser layers get narrower ones by measure.
    Where points are so dense that most outlines hold some, those take the first
    of theirs in their cells, and only the other outlines search around.
    """
    extra = extra or {}
    pos = at_positions(points, {"best_": F.min_by(F.struct(*dict.fromkeys([key, *extra])), F.col(key))}, px, py)
    narrow = cell_side(points, px, py, per_cell=16.0)
    side = min(side, narrow)
    shapes = outlined(segments).select(*ANCHORED)
    entered, box = None, (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))
    if (segments.agg(F.avg(box)).first()[0] or 0) >= HOLDING * narrow * narrow / 16:
        shapes = shapes.filter("segment_id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
        held = first_holding(shapes, pos.select("px", "py", F.col(f"best_.{key}").alias("rank_"), "best_"), "segment_id", "best_", HOLDING_SIDE)
        entered = settle(held.groupBy("segment_id").agg(F.min_by("best_", F.struct("rank_")).alias("best_")), "entered")  # read twice
        shapes = meet(shapes, entered.select("segment_id"), "segment_id", "left_anti")
    pos = pos.select("*", *[F.col(c).alias(n) for c, n in (("px", "rminx"), ("py", "rminy"), ("px", "rmaxx"), ("py", "rmaxy"))])
    dist = F.round(K.ring_point_distance("ring", "px", "py"), 6)
    near = nearest_pairs(
        shapes, pos, "segment_id", max_distance, side, dist,
        F.col("best_").alias("best_"), F.col(f"best_.{key}"), anchor=("x", "y"),
    )
    if entered is not None:
        near = near.select("segment_id", "distance", "best_").unionByName(entered.select("segment_id", F.lit(0.0).alias("distance"), "best_"))
    return near.select("segment_id", F.col("distance").alias(out), *[F.col(f"best_.{c}").alias(n) for c, n in extra.items()])


def split_pieces(lines: DataFrame, longest: float) -> DataFrame:
    """Straight pieces cut so that none is longer than ``longest``; box columns added."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    n = F.greatest(F.lit(1), F.ceil(geo.span(x2 - x1, y2 - y1) / longest).cast("int"))
    cut = lines.withColumn("n_", n).withColumn("i_", F.explode(F.sequence(F.lit(0), F.col("n_") - 1)))
    a, b = F.col("i_") / F.col("n_"), (F.col("i_") + 1) / F.col("n_")
    cut = cut.select(
        *[c for c in lines.columns if c not in ("x1", "y1", "x2", "y2", "rminx", "rminy", "rmaxx", "rmaxy")],
        (x1 + a * (x2 - x1)).alias("x1"), (y1 + a * (y2 - y1)).alias("y1"),
        (x1 + b * (x2 - x1)).alias("x2"), (y1 + b * (y2 - y1)).alias("y2"),
    )
    return cut.select(
        "*", F.least("x1", "x2").alias("rminx"), F.least("y1", "y2").alias("rminy"),
        F.greatest("x1", "x2").alias("rmaxx"), F.greatest("y1", "y2").alias("rmaxy"),
    )


def nearest_line(segments: DataFrame, lines: DataFrame, key: str, value: str, max_distance: float, side: float) -> DataFrame:
    """Distance to the nearest line and its value; ties to the smallest key.

    Where lines are dense most segments are entered by many: the first of them
    is found in its cells, and only the other segments search around.
    """
    pieces = split_pieces(lines.select(key, value, "x1", "y1", "x2", "y2"), side)
    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    dist = F.round(K.ring_piece_distance("ring", *ends), 6)
    shapes = outlined(segments).select(*ANCHORED).filter("segment_id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    entered = first_touching(shapes, pieces, "segment_id", key, value, max(400.0, side))
    entered = settle(entered.groupBy("segment_id").agg(F.min_by(F.struct(key, value), F.struct(key)).alias("best_")), "entered")  # read twice
    near = nearest_pairs(
        meet(shapes, entered.select("segment_id"), "segment_id", "left_anti"), pieces, "segment_id", max_distance, side, dist,
        F.struct(key, value).alias("best_"), F.col(key), anchor=("x", "y"), right_overhang=side / 2 + 1e-6,
    )
    found = near.select("segment_id", "distance", "best_").unionByName(entered.select("segment_id", F.lit(0.0).alias("distance"), "best_"))
    return found.select("segment_id", F.col("distance").alias("speed_nearest_line_m"), F.col(f"best_.{value}").alias("speed_nearest_line_kmh"))


def line_pairs(segments: DataFrame, lines: DataFrame, pad: float, side: float | None = None) -> DataFrame:
    """Segment and line-piece pairs whose boxes meet within ``pad``."""
    return box_box_pairs(outlined(segments).select(*SHAPE), lines, side or max(200.0, 4 * pad), pad)


def nearest_segment(segments: DataFrame, lines: DataFrame, key: Sequence[str], radius: float, line_cols: Sequence[str] = (), cols: Sequence[str] = ()) -> DataFrame:
    """Of each line the nearest segment within ``radius`` (ties to the smallest number): its distance ``metres`` and columns of both."""
    key, picked = list(key), ["segment_id", *cols]
    best = nearest_outline(outlined(segments), lines, "segment_id", [*key, *line_cols], picked, radius, max(400.0, 4 * radius))
    gap = F.round("gap_", 6)
    found = best.groupBy(*key).agg(F.min_by(F.struct(gap.alias("metres"), *line_cols, *picked), F.struct(gap, F.col("segment_id"))).alias("b_"))
    return found.select(*key, "b_.*")


def line_metres(segments: DataFrame, lines: DataFrame, value: str, radius: float) -> DataFrame:
    """Metres of the lines of each ``value`` inside a segment (radius 0) or its corridor, in rows that are summed per cell."""
    return metres_inside(outlined(segments).select(*SHAPE), lines, "segment_id", value, radius, max(200.0, 4 * radius))


def with_line_near(segments: DataFrame, lines: DataFrame, radius: float) -> DataFrame:
    """Keys of the segments with a line within ``radius``."""
    return touched(outlined(segments).select(*SHAPE), lines, "segment_id", radius, max(400.0, 4 * radius)).distinct()


def line_length_inside(segments: DataFrame, lines: DataFrame, radius: float) -> DataFrame:
    """Metres of each line piece inside a segment (radius 0) or its corridor."""
    pairs = line_pairs(segments, lines, radius)
    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    whole = geo.span(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return pairs.withColumn("metres", K.ring_corridor_share("ring", *ends, F.lit(float(radius))) * whole).filter(F.col("metres") > 0)


def speed_zone_stats(segments: DataFrame, zones: DataFrame) -> DataFrame:
    """Corridor, overlap and nearest-line statistics of speed zones per segment."""
    zones = zones.filter(F.col("speed_limit_kmh").isNotNull())
    inside = line_metres(segments, zones, "speed_limit_kmh", CORRIDOR_M)
    by_value = inside.groupBy("segment_id", "speed_limit_kmh").agg(F.sum("metres").alias("m_"))
    corridor = by_value.groupBy("segment_id").agg(
        F.max("speed_limit_kmh").alias("speed_corridor_max_kmh"),
        F.max_by("speed_limit_kmh", F.struct(F.round("m_", 6), -F.col("speed_limit_kmh"))).alias("speed_corridor_dominant_kmh"),
        F.sum("m_").alias("speed_corridor_line_m"),
    )
    overlap = line_metres(segments, zones, "speed_limit_kmh", 0.0).groupBy("segment_id").agg(
        F.sum("metres").alias("speed_intersect_overlap_m"), F.max("speed_limit_kmh").alias("speed_intersect_max_kmh")
    )
    near = nearest_line(segments, zones, "zone_id", "speed_limit_kmh", 500.0, 250.0)
    out = segments.select("segment_id")
    for part in (corridor, overlap, near):
        out = out.join(part, "segment_id", "left")
    return out


def graffiti_stats(segments: DataFrame, graffiti: DataFrame, run_date: str) -> DataFrame:
    run = F.lit(run_date).cast("date")
    pre = {
        "n_": F.count(F.lit(1)), "off_": F.count_if(F.lower("graffiti_type") == "offensive"),
        "rec_": F.count_if(F.col("created_date") >= F.date_sub(run, 365)), "last_": F.max("created_date"),
        "dsum_": F.sum("days_to_remove"), "dn_": F.count("days_to_remove"),
    }
    post = {
        "graffiti_count_25m": F.sum("n_"), "graffiti_offensive_count_25m": F.sum("off_"),
        "graffiti_count_25m_365d": F.sum("rec_"), "graffiti_days_since_last": F.datediff(run, F.max("last_")),
        "graffiti_mean_days_to_remove": F.try_divide(F.sum("dsum_"), F.sum("dn_")),
    }
    s = corridor_stats(segments, graffiti, CORRIDOR_M, pre, post, "x", "y", largest=("last_",))
    return filled(segments, s, ("graffiti_count_25m", "graffiti_offensive_count_25m", "graffiti_count_25m_365d"))


def crash_stats(segments: DataFrame, crashes: DataFrame, run_date: str) -> DataFrame:
    """All, recent, night and recent-night counts from one join."""
    run = F.lit(run_date).cast("date")
    recent = F.coalesce(F.col("crash_date") >= F.add_months(run, -12 * CRASH_YEARS), F.lit(False))
    night = F.coalesce(F.col("night_eligible"), F.lit(False))
    pre = {
        "n_": F.count(F.lit(1)), "r_": F.count_if(recent), "d_": F.count_if(night), "b_": F.count_if(recent & night),
        "last_": F.max("crash_date"),
    }
    post = {
        "crash_ped_count_25m": F.sum("n_"), "crash_ped_count_25m_5y": F.sum("r_"), "crash_night_count_25m": F.sum("d_"),
        "crash_night_count_25m_5y": F.sum("b_"), "crash_days_since_last": F.datediff(run, F.max("last_")),
    }
    s = corridor_stats(segments, crashes, CORRIDOR_M, pre, post, "x", "y", largest=("last_",))
    return filled(segments, s, tuple(list(post)[:4]))


def banded_nearest(segments: DataFrame, points: DataFrame, key: str, max_distance: float, side: float, prefix: str, bands: tuple[int, ...]) -> DataFrame:
    """Nearest distance with within-band flags; nothing in reach counts as false."""
    name = f"{prefix}_nearest_m"
    out = filled(segments, nearest_point(segments, points, key, max_distance, side, name))
    return out.withColumns({f"{prefix}_within_{b}m": F.coalesce(F.col(name) <= b, F.lit(False)) for b in bands})


def bench_stats(segments: DataFrame, benches: DataFrame) -> DataFrame:
    near = nearest_point(segments, benches, "gisfid", 2000.0, 200.0, "bench_nearest_m")
    return count_within(segments, benches, {"bench_count_50m": BENCH_M}).join(near, "segment_id", "left")


def street_light_stats(segments: DataFrame, lights: DataFrame) -> DataFrame:
    counts = count_within(segments, lights, {"streetlight_count_30m": LIGHT_NEAR_M, "streetlight_count_50m": LIGHT_FAR_M})
    near = nearest_point(segments, lights, "light_id", 2000.0, 50.0, "streetlight_nearest_m", {"wattage_w": "streetlight_nearest_wattage_w"})
    # the wattage is only reported for a light within 500 m
    near = near.withColumn("streetlight_nearest_wattage_w", F.when(F.col("streetlight_nearest_m") <= 500, F.col("streetlight_nearest_wattage_w")))
    return counts.join(near, "segment_id", "left")


def park_light_stats(segments: DataFrame, lights: DataFrame) -> DataFrame:
    near = nearest_point(segments, lights, "gisfid", 2000.0, 200.0, "park_light_nearest_m")
    return count_within(segments, lights, {"park_light_count_50m": PARK_LIGHT_M}).join(near, "segment_id", "left")


def tree_stats(segments: DataFrame, trees: DataFrame) -> DataFrame:
    pre = {"n_": F.count(F.lit(1)), "s_": F.count_if(F.col("tree_type") == "Street Tree")}
    post = {"council_tree_count_25m": F.sum("n_"), "council_tree_street_count_25m": F.sum("s_")}
    s = filled(segments, corridor_stats(segments, trees, CORRIDOR_M, pre, post), tuple(post))
    near = nearest_point(segments, trees, "asset_number", 2000.0, 50.0, "council_tree_nearest_m")
    return s.join(near, "segment_id", "left")


def points_in_areas(points: DataFrame, areas: DataFrame, area_key: str, aggs: dict[str, Column], pre: dict[str, Column], side: float) -> DataFrame:
    """Aggregates of the points inside each area outline, for all areas in one join."""
    areas = outlined(areas)
    pairs = box_point_pairs(areas, at_positions(points, pre), side)
    return pairs.filter(outline_holds(areas, F.col("px"), F.col("py"))).groupBy(area_key).agg(*[v.alias(k) for k, v in aggs.items()])


def area_pieces(segments: DataFrame, areas: DataFrame, side: float) -> DataFrame:
    """Common area of every segment and area outline that overlap."""
    areas = outlined(areas)
    right = areas.select(*[F.col(c).alias("r" + c) for c in ("minx", "miny", "maxx", "maxy")], F.col("ring").alias("aring"),
                         *[c for c in areas.columns if c not in ("minx", "miny", "maxx", "maxy", "ring")])
    pairs = box_box_pairs(outlined(segments).select(*SHAPE), right, side)
    return pairs.withColumn("piece", K.ring_overlay_area("ring", "aring")).filter(F.col("piece") > 0)


def heat_stats(segments: DataFrame, heat: DataFrame, side: float, nearest_m: float = 50.0) -> DataFrame:
    """Area-weighted heat, cover share and dominant code; nearest centre within reach as fallback."""
    heat, segments = outlined(heat), outlined(segments)
    heat = heat.filter(F.col("uhi18_m").isNotNull()).select("area_id", "uhi18_m", "veg_pct", "minx", "miny", "maxx", "maxy", "ring")
    sized = segments.select("segment_id", outline_area(segments).alias("full_"))
    centre = geo.parts_centroid(F.col("ring")) if has_parts(heat) else F.struct(((F.col("minx") + F.col("maxx")) / 2).alias("x"), ((F.col("miny") + F.col("maxy")) / 2).alias("y"))
    stats = area_pieces(segments, heat, side).groupBy("segment_id").agg(
        (F.sum(F.col("uhi18_m") * F.col("piece")) / F.sum("piece")).alias("mean_"), F.sum("piece").alias("got_"),
        F.max_by("area_id", F.struct(F.round("piece", 6), -F.col("area_id"))).alias("code_"),
        (F.sum(F.col("veg_pct") * F.col("piece")) / F.sum("piece")).alias("veg_"),
    )
    near = nearest_point(
        segments.join(stats.select("segment_id"), "segment_id", "left_anti")
        .withColumns({"minx": F.col("x"), "maxx": F.col("x"), "miny": F.col("y"), "maxy": F.col("y")})
        .withColumn("ring", geo.box_ring("x", "y", "x", "y")),
        heat.withColumn("centre_", centre).select("area_id", "uhi18_m", F.col("centre_.x").alias("px"), F.col("centre_.y").alias("py")),
        "area_id", nearest_m, max(nearest_m, 25.0), "heat_distance", {"uhi18_m": "nu_", "area_id": "nc_"},
    )
    out = sized.join(stats, "segment_id", "left").join(near, "segment_id", "left")
    return out.select(
        # equal readings must stay equal for the rank later on, whatever the piece sizes
        "segment_id", F.round(F.coalesce("mean_", "nu_"), 9).alias("uhi18_m"), (F.col("got_") / F.col("full_") * 100).alias("uhi_overlap_pct"),
        F.coalesce("code_", "nc_").alias("uhi_mesh_block_code"), F.col("veg_").alias("per_any_veg_pct"),
        F.when(F.col("mean_").isNotNull(), "intersection").when(F.col("nu_").isNotNull(), "nearest").otherwise("missing").alias("uhi_join_method"),
    )


def canopy_stats(segments: DataFrame, density: DataFrame, side: float) -> DataFrame:
    """Share of each segment under dense, medium and sparse cover."""
    kinds = ("dense", "medium", "sparse")
    density, segments = outlined(density), outlined(segments)
    shapes = density.select(F.lower("tree_density").alias("kind"), "minx", "miny", "maxx", "maxy", "ring").filter(F.col("kind").isin(*kinds))
    sums = area_pieces(segments, shapes, side).groupBy("segment_id").agg(
        *[F.sum(F.when(F.col("kind") == k, F.col("piece")).otherwise(0.0)).alias(f"{k}_") for k in kinds])
    out = segments.select("segment_id", outline_area(segments).alias("full_")).join(sums, "segment_id", "left").select(
        "segment_id", *[F.coalesce(F.col(f"{k}_") / F.col("full_") * 100, F.lit(0.0)).alias(f"canopy_{k}_pct") for k in kinds])
    d, m, s = (F.col(f"canopy_{k}_pct") for k in kinds)
    return out.withColumns({
        "canopy_cover_pct": d + m + s,
        "canopy_class_dominant": F.when(F.greatest(d, m, s) <= 0, None).when((d >= m) & (d >= s), "dense").when(m >= s, "medium").otherwise("sparse"),
    })


def capsule_ring(x1: Column, y1: Column, x2: Column, y2: Column, r: float, quarter: int = 16) -> Column:
    """Outline of a straight piece buffered by r, arcs drawn with ``quarter`` chords per quarter turn."""
    turn = F.atan2(y2 - y1, x2 - x1)
    half = [i / (2 * quarter) * 3.141592653589793 for i in range(2 * quarter + 1)]

    def arc(cx, cy, offset):
        return [F.struct((cx + r * F.cos(turn + offset + a)).alias("x"), (cy + r * F.sin(turn + offset + a)).alias("y")) for a in half]

    return F.array(*arc(x2, y2, -1.5707963267948966), *arc(x1, y1, 1.5707963267948966))


def way_scores(ways: DataFrame, segments: DataFrame, streams: tuple[str, ...], buffer_m: float = 12.0, side: float = 200.0) -> DataFrame:
    """Ways scored from the segments around them, weighted by common area, NULL streams skipped.

    ``ways`` has one straight piece per row (``way_id, x1..y2``).
    """
    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    buf = ways.select("way_id", "x1", "y1", "x2", "y2",
                      (F.least("x1", "x2") - buffer_m).alias("minx"), (F.least("y1", "y2") - buffer_m).alias("miny"),
                      (F.greatest("x1", "x2") + buffer_m).alias("maxx"), (F.greatest("y1", "y2") + buffer_m).alias("maxy"))
    right = outlined(segments).select(*[F.col(c).alias("r" + c) for c in ("minx", "miny", "maxx", "maxy")], F.col("ring").alias("sring"), *streams)
    pairs = box_box_pairs(buf, right, side).withColumn("wring", capsule_ring(*ends, buffer_m))
    hit = pairs.withColumn("w", K.ring_overlay_area("wring", "sring")).filter(F.col("w") > 0)
    hit = hit.withColumn("run", K.ring_corridor_share("sring", *ends, F.lit(float(buffer_m))) * geo.span(ends[2] - ends[0], ends[3] - ends[1]))
    sums = hit.groupBy("way_id").agg(
        F.sum("run").alias("run_"),
        *[F.try_divide(F.sum(F.col(s) * F.col("w")), F.sum(F.when(F.col(s).isNotNull(), F.col("w")))).alias(s) for s in streams])
    length = ways.groupBy("way_id").agg(F.sum(geo.span(ends[2] - ends[0], ends[3] - ends[1])).alias("length_m"))
    return length.join(sums, "way_id", "left").select(
        "way_id", "length_m", *streams,
        F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("run_"), F.col("length_m")), F.lit(0.0))).alias("score_coverage"))


def bent_way_scores(ways: DataFrame, segments: DataFrame, streams: tuple[str, ...], buffer_m: float = 12.0, side: float = 200.0) -> DataFrame:
    """Ways with bends scored from the segments around them, weighted by common area, NULL streams skipped.

    ``ways`` has a ``line`` per row (``way_id, line``). The area is that of the
    whole way's buffer inside the outline: ground on both sides of a bend counts
    once. ``score_coverage`` is the share of the way's length within the buffer
    of any segment, stretches near several counted once.
    """
    edges = geo.line_edges(F.col("line"))
    pieces = ways.select("way_id", "line", F.posexplode(edges).alias("i", "e")).select("way_id", "line", "i", "e.*")
    boxed = pieces.select("*", F.least("x1", "x2").alias("minx"), F.least("y1", "y2").alias("miny"), F.greatest("x1", "x2").alias("maxx"), F.greatest("y1", "y2").alias("maxy"))
    right = outlined(segments).select("segment_id", *[F.col(c).alias("r" + c) for c in ("minx", "miny", "maxx", "maxy")], F.col("ring").alias("sring"), *streams)
    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]

    def meets(e: Column) -> Column:
        """Whether the box of a piece, padded, meets that of the segment, by the arithmetic of ``box_box_pairs``."""
        return ((F.col("rminx") <= F.greatest(e["x1"], e["x2"]) + buffer_m) & (F.col("rmaxx") >= F.least(e["x1"], e["x2"]) - buffer_m)
                & (F.col("rminy") <= F.greatest(e["y1"], e["y2"]) + buffer_m) & (F.col("rmaxy") >= F.least(e["y1"], e["y2"]) - buffer_m))

    # the first of a way's pieces that meets a segment measures the whole way in it: no pair has to travel
    first = ~F.exists(F.slice(edges, F.lit(1), F.col("i")), meets)
    again = segments.groupBy(F.col("segment_id").alias("again_")).agg(F.count(F.lit(1)).alias("c_")).filter("c_ > 1").hint("merge")
    repeated = F.col("segment_id").eqNullSafe(F.col("again_"))
    once = box_box_pairs(boxed, right.join(again, repeated, "left_anti"), side, buffer_m).filter(first).select("way_id", "line", "sring", *streams)
    # rows of one segment number count once for a way, so they have to meet
    met = box_box_pairs(boxed.drop("line"), right.join(again, repeated, "left_semi"), side, buffer_m).groupBy("way_id", "segment_id").agg(F.any_value("sring").alias("sring"), *[F.any_value(c).alias(c) for c in streams])
    pairs = once.unionByName(met.join(ways.select("way_id", "line"), "way_id").select(*once.columns))
    hit = pairs.withColumn("w", K.buffered_line_area("line", "sring", F.lit(float(buffer_m)))).filter(F.col("w") > 1e-9)
    sums = hit.groupBy("way_id").agg(*[F.try_divide(F.sum(F.col(s) * F.col("w")), F.sum(F.when(F.col(s).isNotNull(), F.col("w")))).alias(s) for s in streams], F.sum("w").alias("common_m2"))
    near = box_box_pairs(boxed.drop("line"), right, side, buffer_m)
    spans = near.select("way_id", "i", F.explode(K.corridor_spans("sring", *ends, F.lit(float(buffer_m)))).alias("s")).select("way_id", "i", "s.lo", "s.hi")
    covered = covered_metres(pieces.drop("line"), merged_spans(spans, ["way_id"]), ["way_id"])
    return covered.join(sums, "way_id", "left").select(
        "way_id", "length_m", *streams, F.coalesce("common_m2", F.lit(0.0)).alias("common_m2"), F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("covered_m"), F.col("length_m")), F.lit(0.0))).alias("score_coverage"))
