"""Layer joins checked against brute-force SQL on the same coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import grid as G
from ..operators import kernels as K
from ..operators import layers as L
from .bindings import RUN_DATE, cte, layer, segment_shapes, table, zone_lines
from .registry import query

# Distance of a point from an axis-parallel rectangle, the check form.
RECT = "sqrt(power(greatest(minx-{x},{x}-maxx,0),2)+power(greatest(miny-{y},{y}-maxy,0),2))"


def near_sql(layer_name: str, r: float, x: str = "px", y: str = "py") -> str:
    d = RECT.format(x=f"p.{x}", y=f"p.{y}")
    return (f"SELECT s.segment_id, p.*, {d} AS d FROM segments s JOIN {layer_name} p ON p.{x} BETWEEN minx-{r} AND maxx+{r} "
            f"AND p.{y} BETWEEN miny-{r} AND maxy+{r} WHERE {d} <= {r}").replace("p.*, ", "p.* EXCLUDE (px, py), " if x == "px" else "p.* EXCLUDE (x, y), ")


@query("jn_01_counts_within_radius", cte("segments", "lights") + f""", n AS ({near_sql('lights', 50)})
SELECT segment_id, coalesce(n30,0) AS streetlight_count_30m, coalesce(n50,0) AS streetlight_count_50m FROM segments LEFT JOIN
 (SELECT segment_id, count(*) FILTER (WHERE d<=30) AS n30, count(*) AS n50 FROM n GROUP BY 1) USING (segment_id)""")
def jn_01(spark, sf):
    return L.count_within(segment_shapes(spark, sf), layer(spark, sf, "lights"), {"streetlight_count_30m": 30.0, "streetlight_count_50m": 50.0})


@query("jn_02_filtered_corridor_counts", cte("segments", "trees") + f""", n AS ({near_sql('trees', 25)})
SELECT segment_id, coalesce(a,0) AS council_tree_count_25m, coalesce(b,0) AS council_tree_street_count_25m FROM segments LEFT JOIN
 (SELECT segment_id, count(*) AS a, count(*) FILTER (WHERE tree_type='Street Tree') AS b FROM n GROUP BY 1) USING (segment_id)""")
def jn_02(spark, sf):
    segs = segment_shapes(spark, sf)
    pre = {"n_": F.count(F.lit(1)), "s_": F.count_if(F.col("tree_type") == "Street Tree")}
    post = {"council_tree_count_25m": F.sum("n_"), "council_tree_street_count_25m": F.sum("s_")}
    return L.filled(segs, L.corridor_stats(segs, layer(spark, sf, "trees"), 25.0, pre, post), tuple(post))


@query("jn_03_point_in_polygon", cte("areas", "lights") + """SELECT area_id, count(*) AS n, count(DISTINCT light_id) AS n_ids FROM lights JOIN areas ON px>=minx AND px<maxx AND py>=miny AND py<maxy GROUP BY 1""")
def jn_03(spark, sf):
    areas = layer(spark, sf, "areas").withColumn("ring", geo.box_ring("minx", "miny", "maxx", "maxy"))
    pts = layer(spark, sf, "lights").groupBy("px", "py", "light_id").agg(F.count(F.lit(1)).alias("c"))
    pairs = G.box_point_pairs(areas.select("area_id", *G.BOX, "ring"), pts, 2000.0)
    hit = pairs.filter(geo.in_ring(geo.ring_edges(F.col("ring")), F.col("px"), F.col("py")))
    return hit.groupBy("area_id").agg(F.sum("c").alias("n"), F.countDistinct("light_id").alias("n_ids"))


def nearest_sql(layer_name: str, key: str, r: float, cols: str, x: str = "px", y: str = "py") -> str:
    d = RECT.format(x=x, y=y)
    return (f"SELECT segment_id, d, {cols} FROM (SELECT s.segment_id, p.*, round({d},6) AS d, row_number() OVER (PARTITION BY s.segment_id ORDER BY round({d},6), {key}) AS rn "
            f"FROM segments s JOIN {layer_name} p ON p.{x} BETWEEN minx-{r} AND maxx+{r} AND p.{y} BETWEEN miny-{r} AND maxy+{r} WHERE {d}<={r}) WHERE rn=1"
            ).replace("p.*, ", "p.* EXCLUDE (px, py), ")


@query("jn_04_nearest_point", cte("segments", "fountains") + f"SELECT segment_id, d AS fountain_nearest_m, gisfid AS fountain_id FROM ({nearest_sql('fountains','gisfid',2000,'gisfid')})")
def jn_04(spark, sf):
    return L.nearest_point(segment_shapes(spark, sf), layer(spark, sf, "fountains"), "gisfid", 2000.0, 500.0, "fountain_nearest_m", {"gisfid": "fountain_id"})


@query("jn_04_nearest_dense_points", cte("segments", "lights") + f""" , l1 AS (SELECT light_id, min(px) AS px, min(py) AS py, count(*) AS copies FROM lights GROUP BY 1)
SELECT segment_id, d AS streetlight_nearest_m, light_id AS nearest_light FROM ({nearest_sql('l1','light_id',500,'light_id')})""")
def jn_04b(spark, sf):
    return L.nearest_point(segment_shapes(spark, sf), layer(spark, sf, "lights"), "light_id", 500.0, 50.0, "streetlight_nearest_m", {"light_id": "nearest_light"})


# Distance of a rectangle from a straight piece: 0 when the piece enters it, else the best of
# end to rectangle and corner to piece.
def _corner(cx: str, cy: str) -> str:
    t = f"least(1,greatest(0,CASE WHEN len2>0 THEN (({cx}-x1)*(x2-x1)+({cy}-y1)*(y2-y1))/len2 ELSE 0 END))"
    return f"sqrt(power({cx}-(x1+{t}*(x2-x1)),2)+power({cy}-(y1+{t}*(y2-y1)),2))"


def _slab(lo: str, hi: str, a: str, b: str) -> tuple[str, str]:
    d = f"({b}-{a})"
    return (f"(CASE WHEN {d}<>0 THEN least(({lo}-{a})/{d},({hi}-{a})/{d}) WHEN {a} BETWEEN {lo} AND {hi} THEN 0 ELSE 2 END)",
            f"(CASE WHEN {d}<>0 THEN greatest(({lo}-{a})/{d},({hi}-{a})/{d}) WHEN {a} BETWEEN {lo} AND {hi} THEN 1 ELSE -1 END)")


def rect_clip(gx: str = "0", gy: str = "0") -> tuple[str, str]:
    """t range of the piece inside the rectangle grown by gx, gy."""
    x, y = _slab(f"(minx-{gx})", f"(maxx+{gx})", "x1", "x2"), _slab(f"(miny-{gy})", f"(maxy+{gy})", "y1", "y2")
    return f"greatest({x[0]},{y[0]},0)", f"least({x[1]},{y[1]},1)"


_in0, _in1 = rect_clip()
RECT_PIECE = (f"CASE WHEN {_in0}<={_in1} THEN 0 ELSE least({RECT.format(x='x1', y='y1')},{RECT.format(x='x2', y='y2')},"
              + ",".join(_corner(a, b) for a in ("minx", "maxx") for b in ("miny", "maxy")) + ") END")


def line_pairs_sql(src: str, key: str, r: float, seg: str = "segments") -> str:
    return (f"SELECT s.segment_id, s.minx, s.miny, s.maxx, s.maxy, z.{key}, z.x1, z.y1, z.x2, z.y2, power(z.x2-z.x1,2)+power(z.y2-z.y1,2) AS len2 "
            f"FROM {seg} s JOIN {src} z ON least(z.x1,z.x2)<=s.maxx+{r} AND greatest(z.x1,z.x2)>=s.minx-{r} AND least(z.y1,z.y2)<=s.maxy+{r} AND greatest(z.y1,z.y2)>=s.miny-{r}")


@query("jn_05_nearest_line", cte("segments", "speed_zones") + f""", p AS ({line_pairs_sql('speed_zones', 'zone_id, z.speed_limit_kmh', 500)} WHERE z.speed_limit_kmh IS NOT NULL),
 d AS (SELECT segment_id, zone_id, speed_limit_kmh, round({RECT_PIECE},6) AS d FROM p)
SELECT segment_id, d AS speed_nearest_line_m, speed_limit_kmh AS speed_nearest_line_kmh FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY d, zone_id) AS rn FROM d WHERE d<=500) WHERE rn=1""")
def jn_05(spark, sf):
    z = layer(spark, sf, "speed_zones").filter("speed_limit_kmh IS NOT NULL")
    return L.nearest_line(segment_shapes(spark, sf), z, "zone_id", "speed_limit_kmh", 500.0, 250.0)


# The corridor of a rectangle is convex: two grown rectangles and four corner discs.
def _disc(cx: str, cy: str, r: float, end: int) -> str:
    b = f"((x1-{cx})*(x2-x1)+(y1-{cy})*(y2-y1))"
    disc = f"({b}*{b}-len2*(power(x1-{cx},2)+power(y1-{cy},2)-{r * r}))"
    lo, hi = f"(-{b}-sqrt(greatest({disc},0)))/len2", f"(-{b}+sqrt(greatest({disc},0)))/len2"
    ok = f"len2>0 AND {disc}>=0 AND {hi}>=0 AND {lo}<=1"
    return f"CASE WHEN {ok} THEN greatest({lo},0) END" if end == 0 else f"CASE WHEN {ok} THEN least({hi},1) END"


def corridor_sql(r: float) -> str:
    """Share of the piece inside the corridor of the rectangle."""
    a, b = rect_clip(str(r), "0"), rect_clip("0", str(r))
    los = [f"CASE WHEN {a[0]}<={a[1]} THEN {a[0]} END", f"CASE WHEN {b[0]}<={b[1]} THEN {b[0]} END"]
    his = [f"CASE WHEN {a[0]}<={a[1]} THEN {a[1]} END", f"CASE WHEN {b[0]}<={b[1]} THEN {b[1]} END"]
    for cx in ("minx", "maxx"):
        for cy in ("miny", "maxy"):
            los.append(_disc(cx, cy, r, 0))
            his.append(_disc(cx, cy, r, 1))
    return f"coalesce(greatest({','.join(his)})-least({','.join(los)}),0)"


_ZP = f"zp AS ({line_pairs_sql('speed_zones', 'zone_id, z.speed_limit_kmh', 25)} WHERE z.speed_limit_kmh IS NOT NULL)"
_COR = f"""{_ZP}, zl AS (SELECT segment_id, speed_limit_kmh, {corridor_sql(25)}*sqrt(len2) AS m FROM zp),
 zv AS (SELECT segment_id, speed_limit_kmh, sum(m) AS m FROM zl WHERE m>0 GROUP BY 1,2),
 zc AS (SELECT segment_id, max(speed_limit_kmh) AS speed_corridor_max_kmh, arg_max(speed_limit_kmh, (round(m,6), -speed_limit_kmh)) AS speed_corridor_dominant_kmh, sum(m) AS speed_corridor_line_m FROM zv GROUP BY 1)"""


@query("jn_06_line_length_in_corridor", cte("segments", "speed_zones") + f", {_COR} SELECT segment_id, speed_corridor_max_kmh, speed_corridor_dominant_kmh, round(speed_corridor_line_m,5) AS speed_corridor_line_m FROM zc")
def jn_06(spark, sf):
    z = zone_lines(spark, sf).filter("speed_limit_kmh IS NOT NULL")
    m = L.line_metres(segment_shapes(spark, sf), z, "speed_limit_kmh", 25.0)
    v = m.groupBy("segment_id", "speed_limit_kmh").agg(F.sum("metres").alias("m"))
    return v.groupBy("segment_id").agg(
        F.max("speed_limit_kmh").alias("speed_corridor_max_kmh"),
        F.max_by("speed_limit_kmh", F.struct(F.round("m", 6), -F.col("speed_limit_kmh"))).alias("speed_corridor_dominant_kmh"),
        F.round(F.sum("m"), 5).alias("speed_corridor_line_m"))


_INT = f"""zi AS (SELECT segment_id, max(speed_limit_kmh) AS speed_intersect_max_kmh, sum(m) AS speed_intersect_overlap_m FROM
 (SELECT segment_id, speed_limit_kmh, greatest({_in1}-{_in0},0)*sqrt(len2) AS m FROM zp) WHERE m>0 GROUP BY 1)"""


@query("jn_07_line_length_in_polygon", cte("segments", "speed_zones") + f", {_ZP}, {_INT} SELECT segment_id, speed_intersect_max_kmh, round(speed_intersect_overlap_m,5) AS speed_intersect_overlap_m FROM zi")
def jn_07(spark, sf):
    z = zone_lines(spark, sf).filter("speed_limit_kmh IS NOT NULL")
    m = L.line_metres(segment_shapes(spark, sf), z, "speed_limit_kmh", 0.0)
    return m.groupBy("segment_id").agg(F.max("speed_limit_kmh").alias("speed_intersect_max_kmh"), F.round(F.sum("metres"), 5).alias("speed_intersect_overlap_m"))


_NL = f"""np AS ({line_pairs_sql('speed_zones', 'zone_id, z.speed_limit_kmh', 500)} WHERE z.speed_limit_kmh IS NOT NULL),
 nd AS (SELECT segment_id, zone_id, speed_limit_kmh, round({RECT_PIECE},6) AS d FROM np),
 nl AS (SELECT segment_id, d AS speed_nearest_line_m, speed_limit_kmh AS speed_nearest_line_kmh FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY d, zone_id) AS rn FROM nd WHERE d<=500) WHERE rn=1)"""


@query("jn_08_speed_bundle", cte("segments", "speed_zones") + f""", {_COR}, {_INT}, {_NL}
SELECT segment_id, speed_corridor_max_kmh, speed_corridor_dominant_kmh, round(speed_corridor_line_m,5) AS speed_corridor_line_m, round(speed_intersect_overlap_m,5) AS speed_intersect_overlap_m,
 speed_intersect_max_kmh, speed_nearest_line_m, speed_nearest_line_kmh FROM segments LEFT JOIN zc USING (segment_id) LEFT JOIN zi USING (segment_id) LEFT JOIN nl USING (segment_id)""")
def jn_08(spark, sf):
    s = L.speed_zone_stats(segment_shapes(spark, sf), zone_lines(spark, sf))
    return s.withColumns({c: F.round(c, 5) for c in ("speed_corridor_line_m", "speed_intersect_overlap_m")})


@query("jn_12_graffiti_recency", cte("segments", "graffiti") + f""", n AS ({near_sql('graffiti', 25, 'x', 'y')}), a AS (SELECT segment_id, count(*) AS n, count(*) FILTER (WHERE graffiti_type='Offensive') AS o,
 count(*) FILTER (WHERE created_date >= DATE '{RUN_DATE}' - INTERVAL 365 DAY) AS r, CAST(date_diff('day', max(created_date), DATE '{RUN_DATE}') AS INTEGER) AS last, avg(days_to_remove) AS mean FROM n GROUP BY 1)
SELECT segment_id, coalesce(n,0) AS graffiti_count_25m, coalesce(o,0) AS graffiti_offensive_count_25m, coalesce(r,0) AS graffiti_count_25m_365d, last AS graffiti_days_since_last, round(mean,6) AS graffiti_mean_days_to_remove
FROM segments LEFT JOIN a USING (segment_id)""")
def jn_12(spark, sf):
    g = L.graffiti_stats(segment_shapes(spark, sf), layer(spark, sf, "graffiti"), RUN_DATE)
    return g.withColumn("graffiti_mean_days_to_remove", F.round("graffiti_mean_days_to_remove", 6))


@query("jn_13_crash_variants", cte("segments", "crashes") + f""", n AS ({near_sql('crashes', 25, 'x', 'y')}), a AS (SELECT segment_id, count(*) AS n, count(*) FILTER (WHERE crash_date>=DATE '1996-08-01') AS r,
 count(*) FILTER (WHERE night_eligible) AS d, count(*) FILTER (WHERE night_eligible AND crash_date>=DATE '1996-08-01') AS b, CAST(date_diff('day', max(crash_date), DATE '{RUN_DATE}') AS INTEGER) AS last FROM n GROUP BY 1)
SELECT segment_id, coalesce(n,0) AS crash_ped_count_25m, coalesce(r,0) AS crash_ped_count_25m_5y, coalesce(d,0) AS crash_night_count_25m, coalesce(b,0) AS crash_night_count_25m_5y, last AS crash_days_since_last FROM segments LEFT JOIN a USING (segment_id)""")
def jn_13(spark, sf):
    return L.crash_stats(segment_shapes(spark, sf), layer(spark, sf, "crashes"), RUN_DATE)


@query("jn_14_threshold_flags", cte("segments", "school_crossings") + f""", n AS ({nearest_sql('school_crossings','gisfid',1000,'gisfid')})
SELECT segment_id, d AS school_crossing_nearest_m, coalesce(d<=20,false) AS school_crossing_within_20m, coalesce(d<=50,false) AS school_crossing_within_50m FROM segments LEFT JOIN n USING (segment_id)""")
def jn_14(spark, sf):
    return L.banded_nearest(segment_shapes(spark, sf), layer(spark, sf, "school_crossings"), "gisfid", 1000.0, 500.0, "school_crossing", (20, 50))


@query("jn_15_light_and_tree_bundles", cte("segments", "lights", "park_lights", "trees") + f""", l AS ({near_sql('lights', 50)}), lc AS (SELECT segment_id, count(*) FILTER (WHERE d<=30) AS a, count(*) AS b FROM l GROUP BY 1),
 p AS ({near_sql('park_lights', 50)}), pc AS (SELECT segment_id, count(*) AS c FROM p GROUP BY 1), pn AS ({nearest_sql('park_lights','gisfid',2000,'gisfid')}), t AS ({near_sql('trees', 25)}),
 tc AS (SELECT segment_id, count(*) AS t, count(*) FILTER (WHERE tree_type='Street Tree') AS s FROM t GROUP BY 1)
SELECT segment_id, coalesce(a,0) AS streetlight_count_30m, coalesce(b,0) AS streetlight_count_50m, coalesce(c,0) AS park_light_count_50m, pn.d AS park_light_nearest_m, coalesce(t,0) AS council_tree_count_25m, coalesce(tc.s,0) AS council_tree_street_count_25m
FROM segments LEFT JOIN lc USING (segment_id) LEFT JOIN pc USING (segment_id) LEFT JOIN pn USING (segment_id) LEFT JOIN tc USING (segment_id)""")
def jn_15(spark, sf):
    segs = segment_shapes(spark, sf)
    lights = L.street_light_stats(segs, layer(spark, sf, "lights")).select("segment_id", "streetlight_count_30m", "streetlight_count_50m")
    parks = L.park_light_stats(segs, layer(spark, sf, "park_lights"))
    trees = L.tree_stats(segs, layer(spark, sf, "trees")).drop("council_tree_nearest_m")
    return lights.join(parks, "segment_id", "left").join(trees, "segment_id", "left")


_EXPORT = """export AS (SELECT c_custkey AS segment_id, CASE WHEN c_custkey%19=0 THEN NULL ELSE c_custkey%1900 END AS t1key, 0.55e0+(c_custkey%50)*0.05e0 AS width_m, CASE c_custkey%3 WHEN 0 THEN 'Concrete' WHEN 1 THEN NULL ELSE 'Gravel' END AS surface_material FROM customer)"""


def _export(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("segment_id"), F.when(k % 19 == 0, None).otherwise(k % 1900).alias("t1key"), (0.55 + (k % 50) * 0.05).alias("width_m"),
        F.when(k % 3 == 0, "Concrete").when(k % 3 == 1, None).otherwise("Gravel").alias("surface_material"))


@query("jn_23_null_aware_anti", cte("segments") + f", {_EXPORT} SELECT segment_id, t1key FROM export WHERE t1key IS NOT NULL AND t1key NOT IN (SELECT t1key FROM segments WHERE t1key IS NOT NULL)")
def jn_23(spark, sf):
    keys = layer(spark, sf, "segments").filter("t1key IS NOT NULL").select("t1key")
    return _export(spark, sf).filter("t1key IS NOT NULL").join(keys, "t1key", "left_anti").select("segment_id", "t1key")


@query("jn_26_crosswalk", cte("segments") + f""", {_EXPORT}, j AS (SELECT s.t1key, abs(coalesce(s.width_m,0)-coalesce(f.width_m,0))>0.1 AS w, coalesce(s.surface_material,'')<>coalesce(f.surface_material,'') AS m, f.walk_path_class<>'shared_use' AS c
 FROM export s JOIN segments f ON s.t1key=f.t1key)
SELECT count(DISTINCT t1key) AS keys_in_both, count(DISTINCT CASE WHEN w THEN t1key END) AS width_differs, count(DISTINCT CASE WHEN m THEN t1key END) AS surface_differs, count(*) FILTER (WHERE c) AS class_differs FROM j""")
def jn_26(spark, sf):
    """One pass: rows per key and side are reduced to distinct (key, width, surface, class) with counts first."""
    s = _export(spark, sf).filter("t1key IS NOT NULL").groupBy("t1key", "width_m", "surface_material").agg(F.count(F.lit(1)).alias("ns"))
    f = layer(spark, sf, "segments").filter("t1key IS NOT NULL").groupBy(
        "t1key", F.col("width_m").alias("fw"), F.col("surface_material").alias("fm"), "walk_path_class").agg(F.count(F.lit(1)).alias("nf"))
    j = s.join(f, "t1key")
    w = F.abs(F.coalesce("width_m", F.lit(0.0)) - F.coalesce("fw", F.lit(0.0))) > 0.1
    m = F.coalesce("surface_material", F.lit("")) != F.coalesce("fm", F.lit(""))
    c = F.col("walk_path_class") != "shared_use"
    per_key = j.groupBy("t1key").agg(F.max(w).alias("w"), F.max(m).alias("m"), F.sum(F.when(c, F.col("ns") * F.col("nf")).otherwise(0)).alias("c"))
    return per_key.agg(F.count(F.lit(1)).alias("keys_in_both"), F.count_if("w").alias("width_differs"), F.count_if("m").alias("surface_differs"), F.sum("c").alias("class_differs"))


@query("jn_24_distance_anti", cte("segments", "speed_zones") + f", p AS ({line_pairs_sql('speed_zones', 'zone_id', 30)}) SELECT segment_id FROM segments WHERE segment_id NOT IN (SELECT segment_id FROM p WHERE {RECT_PIECE} <= 30)")
def jn_24(spark, sf):
    segs, z = segment_shapes(spark, sf), zone_lines(spark, sf)
    return segs.select("segment_id").join(L.with_line_near(segs, z, 30.0), "segment_id", "left_anti")


_OD = """od AS (SELECT s_suppkey AS od_id, ((s_suppkey*3571)%100003)/10 AS x1, ((s_suppkey*2741+29)%99991)/10 AS y1, ((s_suppkey*3571)%100003)/10+(s_suppkey%21-10)*150 AS x2, ((s_suppkey*2741+29)%99991)/10+(s_suppkey%17-8)*170 AS y2 FROM supplier)"""


def od_lines(spark, sf):
    k = F.col("s_suppkey")
    x, y = ((k * 3571) % 100003) / 10, ((k * 2741 + 29) % 99991) / 10
    return table(spark, sf, "supplier").select(k.alias("od_id"), x.alias("x1"), y.alias("y1"), (x + (k % 21 - 10) * 150).alias("x2"), (y + (k % 17 - 8) * 170).alias("y2"))


@query("jn_25_od_corridor", cte("segments", "speed_zones") + f""", {_OD}, p AS ({line_pairs_sql('od', 'od_id', 40)}), hit AS (SELECT DISTINCT od_id, segment_id FROM p WHERE {RECT_PIECE} <= 40),
 zp AS ({line_pairs_sql('speed_zones', 'zone_id', 60)}), known AS (SELECT DISTINCT segment_id FROM zp WHERE {RECT_PIECE.replace('x','x')} <= 60)
SELECT od_id, count(*) AS n, round(sum(length_m),2) AS length_m, count(*) FILTER (WHERE k.segment_id IS NULL) AS n_orphan,
 round(sum(CASE WHEN k.segment_id IS NULL THEN length_m ELSE 0 END)/sum(length_m),6) AS orphan_share FROM hit JOIN segments USING (segment_id) LEFT JOIN known k USING (segment_id) GROUP BY 1""")
def jn_25(spark, sf):
    """Straight OD lines cut to cell size, so a long diagonal does not claim its whole box."""
    segs = segment_shapes(spark, sf)
    pieces = L.split_pieces(od_lines(spark, sf), 200.0)
    p = L.line_pairs(segs, pieces, 40.0)
    d = K.ring_piece_distance("ring", "x1", "y1", "x2", "y2")
    hit = p.filter(d <= 40.0).select("od_id", "segment_id").distinct()
    known = L.with_line_near(segs, zone_lines(spark, sf), 60.0).withColumn("known", F.lit(True))
    full = G.meet(hit, segs.select("segment_id", "length_m"), "segment_id").join(known, "segment_id", "left")
    lost = F.col("known").isNull()
    return full.groupBy("od_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("length_m"), 2).alias("length_m"), F.count_if(lost).alias("n_orphan"),
        F.round(F.sum(F.when(lost, F.col("length_m")).otherwise(0.0)) / F.sum("length_m"), 6).alias("orphan_share"))


@query("jn_27_metadata_lookup", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey=n_nationkey LEFT JOIN region ON n_regionkey=r_regionkey")
def jn_27(spark, sf):
    """Small lookups join plainly: Spark broadcasts them when their measured size allows it."""
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select("c_custkey", "n_name", "r_name")


@query("jn_28_nearest_node", cte("crashes", "segments") + """SELECT crash_id, node_id, d AS metres FROM (SELECT crash_id, segment_id AS node_id, round(sqrt(power(c.x-s.x,2)+power(c.y-s.y,2)),6) AS d,
 row_number() OVER (PARTITION BY crash_id ORDER BY round(sqrt(power(c.x-s.x,2)+power(c.y-s.y,2)),6), segment_id) AS rn FROM crashes c JOIN segments s ON s.x BETWEEN c.x-600 AND c.x+600 AND s.y BETWEEN c.y-600 AND c.y+600) WHERE rn=1 AND d<=600""")
def jn_28(spark, sf):
    c = layer(spark, sf, "crashes").select("crash_id", "x", "y", F.col("x").alias("minx"), F.col("y").alias("miny"), F.col("x").alias("maxx"), F.col("y").alias("maxy"))
    nodes = layer(spark, sf, "segments").select(F.col("segment_id").alias("node_id"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    nodes = nodes.groupBy("nx", "ny").agg(F.min("node_id").alias("node_id")).select(
        "*", F.col("nx").alias("rminx"), F.col("ny").alias("rminy"), F.col("nx").alias("rmaxx"), F.col("ny").alias("rmaxy"))
    d = F.round(geo.span(F.col("x") - F.col("nx"), F.col("y") - F.col("ny")), 6)
    near = G.nearest_pairs(c, nodes, "crash_id", 600.0, min(300.0, G.cell_side(nodes, "nx", "ny", per_cell=4.0)), d, F.col("node_id"), F.col("node_id"), anchor=("x", "y"))
    return near.select("crash_id", "node_id", F.col("distance").alias("metres"))


@query("jn_31_layer_by_area", cte("areas", "lights", "segments", "crashes") + """, l AS (SELECT area_id, count(*) AS lights, round(avg(wattage_w),6) AS mean_wattage FROM lights JOIN areas ON px>=minx AND px<maxx AND py>=miny AND py<maxy GROUP BY 1),
 s AS (SELECT area_id, count(*) AS segments FROM segments s JOIN areas a ON s.minx<=a.maxx AND s.maxx>=a.minx AND s.miny<=a.maxy AND s.maxy>=a.miny GROUP BY 1)
SELECT area_id, coalesce(lights,0) AS lights, mean_wattage, coalesce(segments,0) AS segments FROM areas LEFT JOIN l USING (area_id) LEFT JOIN s USING (area_id)""")
def jn_31(spark, sf):
    areas = layer(spark, sf, "areas").withColumn("ring", geo.box_ring("minx", "miny", "maxx", "maxy")).select("area_id", *G.BOX, "ring")
    pre = {"n_": F.count(F.lit(1)), "w_": F.sum("wattage_w"), "wn_": F.count("wattage_w")}
    aggs = {"lights": F.sum("n_"), "mean_wattage": F.round(F.sum("w_") / F.sum("wn_"), 6)}
    li = L.points_in_areas(layer(spark, sf, "lights"), areas, "area_id", aggs, pre, 2000.0)
    segs = segment_shapes(spark, sf).select("segment_id", *[F.col(c).alias("r" + c) for c in G.BOX], F.col("ring").alias("sring"))
    pairs = G.box_box_pairs(areas, segs, 2000.0)
    e1 = geo.ring_edges(F.col("ring"))
    meets = F.exists(geo.ring_edges(F.col("sring")), lambda e: geo.ring_piece_distance(e1, e["x1"], e["y1"], e["x2"], e["y2"]) == 0)
    s = pairs.filter(meets).groupBy("area_id").agg(F.count(F.lit(1)).alias("segments"))
    return areas.select("area_id").join(li, "area_id", "left").join(s, "area_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("lights", "segments")})
