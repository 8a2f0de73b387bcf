"""Layer joins with outlines of several parts and holes.

An area is two blocks, each with a rectangular hole; a segment is a frame
around a hole. The check SQL adds and subtracts the rectangles one by one.
Rings of the areas turn differently on purpose.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import layers as L
from .bindings import cte, layer, zone_lines
from .registry import query

#: rectangles of an area: part, sign, and offsets from its lower left corner
BLOCKS = ((0, 1, 0, 0, 900, 2000), (0, -1, 300, 500, 600, 1500), (1, 1, 1100, 100, 2000, 1900), (1, -1, 1300, 700, 1900, 1100))
#: share of a segment's box that its hole leaves at each side
FRAME = 0.25

_AREA_RECTS = "ar AS (" + " UNION ALL ".join(
    f"SELECT area_id, uhi18_m, veg_pct, lower(tree_density) AS kind, {p} AS part, {s} AS sign, minx+{a} AS ax0, miny+{b} AS ay0, minx+{c} AS ax1, miny+{d} AS ay1 FROM areas" for p, s, a, b, c, d in BLOCKS) + ")"
_SEG_RECTS = f"""sr AS (SELECT segment_id, 1 AS ssign, minx AS sx0, miny AS sy0, maxx AS sx1, maxy AS sy1 FROM segments
 UNION ALL SELECT segment_id, -1, minx+{FRAME}*(maxx-minx), miny+{FRAME}*(maxy-miny), maxx-{FRAME}*(maxx-minx), maxy-{FRAME}*(maxy-miny) FROM segments)"""
_FULL = "fl AS (SELECT segment_id, sum(ssign*(sx1-sx0)*(sy1-sy0)) AS full_ FROM sr GROUP BY 1)"
_OV = f"""{_AREA_RECTS}, {_SEG_RECTS}, {_FULL}, ov AS (SELECT segment_id, area_id, any_value(uhi18_m) AS uhi18_m, any_value(veg_pct) AS veg_pct, any_value(kind) AS kind,
  sum(sign*ssign*greatest(0,least(sx1,ax1)-greatest(sx0,ax0))*greatest(0,least(sy1,ay1)-greatest(sy0,ay0))) AS piece
 FROM sr JOIN ar ON sx0<ax1 AND sx1>ax0 AND sy0<ay1 AND sy1>ay0 GROUP BY 1, 2 HAVING piece>1e-9)"""
_CENTRE = """ce AS (SELECT area_id, any_value(uhi18_m) AS u, sum(sign*(ax1-ax0)*(ay1-ay0)*(ax0+ax1)/2)/sum(sign*(ax1-ax0)*(ay1-ay0)) AS gx, sum(sign*(ax1-ax0)*(ay1-ay0)*(ay0+ay1)/2)/sum(sign*(ax1-ax0)*(ay1-ay0)) AS gy
 FROM ar WHERE uhi18_m IS NOT NULL GROUP BY 1)"""


def _rect(x0, y0, x1, y1, clockwise: bool):
    corners = [(x0, y0), (x0, y1), (x1, y1), (x1, y0)] if clockwise else [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners])


def area_parts(spark, sf):
    """Areas as two blocks with a hole each."""
    x, y = F.col("minx"), F.col("miny")
    rings = {p: [] for p, *_ in BLOCKS}
    for k, (p, _, a, b, c, d) in enumerate(BLOCKS):
        rings[p].append(_rect(x + a, y + b, x + c, y + d, clockwise=k in (0, 1)))
    out = layer(spark, sf, "areas").withColumn("parts", F.array(*[F.array(*r) for r in rings.values()]))
    return out.withColumns(geo.parts_bounds(F.col("parts")))


def segment_frames(spark, sf):
    """Segments as frames around a hole; the anchor stays, in the hole."""
    w, h = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    outer = _rect(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"), False)
    hole = _rect(F.col("minx") + FRAME * w, F.col("miny") + FRAME * h, F.col("maxx") - FRAME * w, F.col("maxy") - FRAME * h, False)
    return layer(spark, sf, "segments").withColumn("parts", F.array(F.array(outer, hole)))


@query("jn_03_point_in_parts", cte("areas", "lights") + f""", {_AREA_RECTS}, hit AS (SELECT area_id, light_id, sum(sign) AS inside, any_value(px) FROM lights JOIN ar ON px>=ax0 AND px<ax1 AND py>=ay0 AND py<ay1 GROUP BY area_id, light_id, px, py HAVING sum(sign)>0),
 dup AS (SELECT light_id, px, py, count(*) AS c FROM lights GROUP BY ALL), u AS (SELECT DISTINCT area_id, light_id FROM hit)
SELECT area_id, sum(c)::BIGINT AS n FROM (SELECT area_id, d.light_id, c FROM dup d JOIN areas a ON px>=a.minx AND px<a.minx+2000 AND py>=a.miny AND py<a.miny+2000 JOIN u USING (area_id, light_id)) GROUP BY 1""")
def jn_03(spark, sf):
    """Lights inside the blocks and outside their holes."""
    return L.points_in_areas(layer(spark, sf, "lights"), area_parts(spark, sf).select("area_id", "minx", "miny", "maxx", "maxy", "parts"), "area_id", {"n": F.sum("n_")}, {"n_": F.count(F.lit(1))}, 1000.0)


_HEAT = f"""{_OV}, {_CENTRE}, ho AS (SELECT segment_id, sum(uhi18_m*piece)/sum(piece) AS m, sum(piece) AS got, arg_max(area_id,(round(piece,6),-area_id)) AS code, sum(veg_pct*piece)/sum(piece) AS veg FROM ov WHERE uhi18_m IS NOT NULL GROUP BY 1),
 hn AS (SELECT segment_id, u, area_id AS c FROM (SELECT s.segment_id, u, area_id, sqrt(power(s.x-gx,2)+power(s.y-gy,2)) AS d, row_number() OVER (PARTITION BY segment_id ORDER BY round(sqrt(power(s.x-gx,2)+power(s.y-gy,2)),6), area_id) AS rn FROM segments s, ce) WHERE rn=1 AND d<={{r}})
SELECT segment_id, round(coalesce(m,u),7) AS uhi18_m, round(got/full_*100,6) AS uhi_overlap_pct, coalesce(code,CASE WHEN m IS NULL THEN c END) AS uhi_mesh_block_code, round(veg,7) AS per_any_veg_pct,
 CASE WHEN m IS NOT NULL THEN 'intersection' WHEN u IS NOT NULL THEN 'nearest' ELSE 'missing' END AS uhi_join_method FROM segments JOIN fl USING (segment_id) LEFT JOIN ho USING (segment_id) LEFT JOIN hn USING (segment_id)"""


def _heat(spark, sf, nearest_m):
    h = L.heat_stats(segment_frames(spark, sf), area_parts(spark, sf), 1000.0, nearest_m)
    return h.select("segment_id", F.round("uhi18_m", 7).alias("uhi18_m"), F.round("uhi_overlap_pct", 6).alias("uhi_overlap_pct"), "uhi_mesh_block_code", F.round("per_any_veg_pct", 7).alias("per_any_veg_pct"), "uhi_join_method")


@query("jn_09_overlay_of_parts", cte("segments", "areas") + f", {_HEAT.format(r=50)}")
def jn_09(spark, sf):
    """Area-weighted heat of framed segments over blocks with holes."""
    return _heat(spark, sf, 50.0)


@query("jn_10_centroid_of_parts", cte("segments", "areas") + f", {_HEAT.format(r=900)}")
def jn_10(spark, sf):
    """Segments that lie wholly in a hole or between blocks take the nearest centre of gravity."""
    return _heat(spark, sf, 900.0)


@query("jn_11_cover_of_parts", cte("segments", "areas") + f""", {_OV}, p AS (SELECT segment_id, {', '.join(f"coalesce(sum(piece) FILTER (WHERE kind='{k}')/max(full_)*100,0) AS {k}" for k in ('dense', 'medium', 'sparse'))} FROM fl LEFT JOIN ov USING (segment_id) GROUP BY 1)
SELECT segment_id, round(dense,6) AS canopy_dense_pct, round(medium,6) AS canopy_medium_pct, round(sparse,6) AS canopy_sparse_pct, round(dense+medium+sparse,6) AS canopy_cover_pct FROM p""")
def jn_11(spark, sf):
    """Shares of framed segments under blocks with holes."""
    c = L.canopy_stats(segment_frames(spark, sf), area_parts(spark, sf), 1000.0)
    return c.select("segment_id", *[F.round(f"canopy_{k}_pct", 6).alias(f"canopy_{k}_pct") for k in ("dense", "medium", "sparse", "cover")])


def _clip(lo: str, hi: str, at: str, to: str) -> tuple[str, str]:
    """Range of t for which at + t (to - at) lies between lo and hi."""
    d = f"({to}-{at})"
    return (f"CASE WHEN {d}=0 THEN CASE WHEN {at}>={lo} AND {at}<={hi} THEN 0.0 ELSE 2.0 END ELSE least(({lo}-{at})/{d},({hi}-{at})/{d}) END",
            f"CASE WHEN {d}=0 THEN CASE WHEN {at}>={lo} AND {at}<={hi} THEN 1.0 ELSE -1.0 END ELSE greatest(({lo}-{at})/{d},({hi}-{at})/{d}) END")


_TX, _TY = _clip("ax0", "ax1", "x1", "x2"), _clip("ay0", "ay1", "y1", "y2")


@query("jn_07_line_length_in_parts", cte("speed_zones", "areas") + f""", {_AREA_RECTS}, c AS (SELECT area_id, zone_id, speed_limit_kmh, sign*greatest(0,least(1.0,{_TX[1]},{_TY[1]})-greatest(0.0,{_TX[0]},{_TY[0]}))*sqrt(power(x2-x1,2)+power(y2-y1,2)) AS m
 FROM speed_zones JOIN ar ON least(x1,x2)<=ax1 AND greatest(x1,x2)>=ax0 AND least(y1,y2)<=ay1 AND greatest(y1,y2)>=ay0 WHERE speed_limit_kmh IS NOT NULL),
 z AS (SELECT area_id, zone_id, speed_limit_kmh, sum(m) AS m FROM c GROUP BY ALL HAVING sum(m)>1e-6) SELECT area_id, round(sum(m),4) AS line_m, max(speed_limit_kmh) AS max_kmh, count(*) AS zones FROM z GROUP BY 1""")
def jn_07(spark, sf):
    """Metres of speed zones inside blocks and outside their holes."""
    areas = area_parts(spark, sf).withColumnRenamed("area_id", "segment_id")
    inside = L.line_length_inside(areas, zone_lines(spark, sf).filter("speed_limit_kmh IS NOT NULL"), 0.0).filter("metres > 1e-6")
    out = inside.groupBy("segment_id").agg(F.round(F.sum("metres"), 4).alias("line_m"), F.max("speed_limit_kmh").alias("max_kmh"), F.count(F.lit(1)).alias("zones"))
    return out.withColumnRenamed("segment_id", "area_id")


_TO_RECT = "sqrt(power(greatest(ax0-px,px-ax1,0),2)+power(greatest(ay0-py,py-ay1,0),2))"
_OUT_OF = "CASE WHEN px>ax0 AND px<ax1 AND py>ay0 AND py<ay1 THEN least(px-ax0,ax1-px,py-ay0,ay1-py) ELSE 0 END"


@query("jn_04_nearest_to_parts", cte("areas", "fountains") + f""", {_AREA_RECTS}, d AS (SELECT area_id, gisfid, min(d) AS d FROM (SELECT area_id, gisfid, part, px, py, max(CASE WHEN sign=1 THEN {_TO_RECT} ELSE {_OUT_OF} END) AS d FROM fountains, ar GROUP BY ALL) GROUP BY ALL)
SELECT area_id, d AS nearest_m, gisfid AS fountain_id FROM (SELECT area_id, gisfid, round(d,6) AS d, row_number() OVER (PARTITION BY area_id ORDER BY round(d,6), gisfid) AS rn FROM d WHERE d<=3000) WHERE rn=1""")
def jn_04(spark, sf):
    """The nearest fountain of each area; one in a hole is as far as the hole's nearest side."""
    areas = area_parts(spark, sf).withColumnsRenamed({"area_id": "segment_id"}).withColumns({"x": F.col("minx"), "y": F.col("miny")})
    near = L.nearest_point(areas, layer(spark, sf, "fountains"), "gisfid", 3000.0, 500.0, "nearest_m", {"gisfid": "fountain_id"})
    return near.withColumnRenamed("segment_id", "area_id")
