"""Queries for projections, filters, quality flags, plain aggregates, top-k and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import geo
from ..operators import aggregates as A
from ..operators import ordering as O
from ..operators import quality as Q
from .bindings import EVENTS_RUN_DATE, RUN_DATE, cte, layer, segment_shapes, table
from .registry import query

# --- projections -------------------------------------------------------------


@query("prj_01_safe_cast", """
SELECT event_id, try_cast(props->>'$.k' AS DOUBLE) AS k_value, try_cast(event_type AS INTEGER) AS bad_cast,
       try_cast(substr(CAST(ts AS VARCHAR),1,10) AS DATE) AS event_date FROM events""")
def prj_01(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        "event_id",
        F.get_json_object("props", "$.k").try_cast("double").alias("k_value"),
        F.col("event_type").try_cast("int").alias("bad_cast"),
        F.substring(F.col("ts").cast("string"), 1, 10).try_cast("date").alias("event_date"),
    )


@query("prj_02_default_zero", """
SELECT event_id, coalesce(try_cast(CASE WHEN event_id%7=0 THEN 'x' ELSE props->>'$.k' END AS INTEGER), 0) AS k_count FROM events""")
def prj_02(spark, sf):
    e = table(spark, sf, "events")
    raw = F.when(F.col("event_id") % 7 == 0, "x").otherwise(F.get_json_object("props", "$.k"))
    return e.select("event_id", F.coalesce(raw.try_cast("int"), F.lit(0)).alias("k_count"))


@query("prj_03_digits_from_text", """
SELECT s_suppkey, try_cast(nullif(regexp_replace(s_name,'[^0-9]','','g'),'') AS INTEGER) AS digits,
       try_cast(nullif(regexp_replace(n_name,'[^0-9]','','g'),'') AS INTEGER) AS nation_digits
FROM supplier JOIN nation ON s_nationkey=n_nationkey""")
def prj_03(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        "s_suppkey", Q.digits("s_name").alias("digits"), Q.digits("n_name").alias("nation_digits")
    )


@query("prj_04_path_class", cte("segments") + "SELECT segment_id, walk_path_class AS path_class FROM segments")
def prj_04(spark, sf):
    return layer(spark, sf, "segments").select("segment_id", Q.path_class("feature_type").alias("path_class"))


@query("prj_05_severity", cte("crashes") + """
SELECT crash_id, CASE upper(trim(severity_raw)) WHEN 'FATAL ACCIDENT' THEN 'fatal' WHEN 'SERIOUS INJURY ACCIDENT' THEN 'serious'
  WHEN 'OTHER INJURY ACCIDENT' THEN 'minor' WHEN 'NON INJURY ACCIDENT' THEN 'no_injury' ELSE lower(trim(severity_raw)) END AS injury_severity
FROM crashes""")
def prj_05(spark, sf):
    return layer(spark, sf, "crashes").select("crash_id", Q.severity("severity_raw").alias("injury_severity"))


_LIGHT_SQL = """CASE WHEN light_condition IS NULL OR trim(light_condition)='' THEN 'missing'
 WHEN lower(trim(light_condition)) IN ('day','daylight') THEN 'daylight'
 WHEN light_condition ILIKE '%dawn%' OR light_condition ILIKE '%dusk%' THEN 'dawn_dusk'
 WHEN light_condition ILIKE '%lights on%' OR (light_condition ILIKE '%lighted%' AND light_condition NOT ILIKE '%not%') THEN 'dark_lighted'
 WHEN light_condition ILIKE '%not lighted%' OR light_condition ILIKE '%lights off%' OR light_condition ILIKE '%no street lights%'
   OR light_condition ILIKE '%lights unknown%' OR light_condition ILIKE '%dark%' THEN 'dark_not_lighted' ELSE 'other' END"""


@query("prj_06_light_category", cte("crashes") + f"SELECT crash_id, {_LIGHT_SQL} AS light_category FROM crashes")
def prj_06(spark, sf):
    return layer(spark, sf, "crashes").select("crash_id", Q.light_category("light_condition").alias("light_category"))


@query("prj_07_reproject", cte("crashes") + """
SELECT crash_id, round(longitude,7) AS lng_back, round(latitude,7) AS lat_back FROM crashes
WHERE latitude BETWEEN -40 AND -30 AND longitude BETWEEN 140 AND 150""")
def prj_07(spark, sf):
    c = layer(spark, sf, "crashes").filter("latitude BETWEEN -40 AND -30 AND longitude BETWEEN 140 AND 150")
    c = c.withColumn("m", geo.to_metric("longitude", "latitude"))
    c = c.withColumn("b", geo.to_lonlat("m.x", "m.y"))
    return c.select("crash_id", F.round("b.lng", 7).alias("lng_back"), F.round("b.lat", 7).alias("lat_back"))


@query("prj_08_point_from_text", """
SELECT o_orderkey, try_cast(CASE WHEN o_orderkey%9=0 THEN 'n/a' ELSE CAST(o_orderkey%360 AS VARCHAR) END AS DOUBLE) AS px,
  try_cast(o_orderstatus AS DOUBLE) AS py FROM orders""")
def prj_08(spark, sf):
    o = table(spark, sf, "orders")
    lon = F.when(F.col("o_orderkey") % 9 == 0, "n/a").otherwise((F.col("o_orderkey") % 360).cast("string"))
    pt = F.struct(lon.try_cast("double").alias("x"), F.col("o_orderstatus").try_cast("double").alias("y"))
    return o.select("o_orderkey", pt.alias("p")).select("o_orderkey", F.col("p.x").alias("px"), F.col("p.y").alias("py"))


@query("prj_09_night_eligible", cte("crashes") + f"SELECT crash_id, ({_LIGHT_SQL}) IN ('dark_lighted','dark_not_lighted') AS night_index_eligible FROM crashes")
def prj_09(spark, sf):
    return layer(spark, sf, "crashes").select(
        "crash_id", Q.light_category("light_condition").isin(*Q.NIGHT_LIGHT_CATEGORIES).alias("night_index_eligible")
    )


@query("prj_10_score_eligible", cte("segments") + "SELECT segment_id, suburb IS NULL OR suburb NOT IN ('Brand#2') AS score_eligible FROM segments")
def prj_10(spark, sf):
    return layer(spark, sf, "segments").select(
        "segment_id", F.coalesce(~F.col("suburb").isin("Brand#2"), F.lit(True)).alias("score_eligible")
    )


@query("prj_11_provenance", """
SELECT p_partkey AS segment_id, '1.1' AS methodology_version, '{"corridor_m":25,"crash_years":5,"exclude_suburbs":["Brand#2"]}' AS join_params,
  DATE '2001-08-01' AS harmonised_at FROM part""")
def prj_11(spark, sf):
    params = F.struct(
        F.lit(25).alias("corridor_m"), F.lit(5).alias("crash_years"), F.array(F.lit("Brand#2")).alias("exclude_suburbs")
    )
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("segment_id"), F.lit("1.1").alias("methodology_version"),
        F.to_json(params).alias("join_params"), F.lit(RUN_DATE).cast("date").alias("harmonised_at"),
    )


def require_columns(df, required):
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


@query("prj_12_keep_known_columns", cte("segments") + "SELECT segment_id, walk_path_class, suburb, length_m FROM segments")
def prj_12(spark, sf):
    df = require_columns(layer(spark, sf, "segments"), ["segment_id", "walk_path_class", "suburb"])
    keep = ["segment_id", "walk_path_class", "suburb", "day_index_score", "length_m"]
    return df.select([c for c in keep if c in df.columns])


@query("prj_13_hectares", "SELECT doc_id, round(try_cast(n_chars AS DOUBLE)/10000, 2) AS area_ha FROM documents")
def prj_13(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.round(F.col("n_chars").cast("string").try_cast("double") / 10000, 2).alias("area_ha")
    )


@query("prj_14_explode_parts", """
SELECT conv_id, turn, CAST(part_no AS INTEGER) AS part_no, part FROM (
  SELECT conv_id, turn, unnest(string_split(text, '.')) AS part, unnest(range(len(string_split(text,'.')))) AS part_no FROM conversations
  ) WHERE trim(part) <> ''""")
def prj_14(spark, sf):
    c = table(spark, sf, "conversations")
    parts = c.select("conv_id", "turn", F.posexplode(F.split("text", "\\.", -1)).alias("part_no", "part"))
    return parts.filter(F.trim("part") != "")


@query("prj_16_drop_empty_geometry", cte("speed_zones") + """
SELECT zone_id FROM speed_zones WHERE NOT (abs(x1-x2)<1e-9 AND abs(y1-y2)<1e-9)""")
def prj_16(spark, sf):
    z = layer(spark, sf, "speed_zones")
    flat = (F.abs(F.col("x1") - F.col("x2")) < 1e-9) & (F.abs(F.col("y1") - F.col("y2")) < 1e-9)
    a = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))
    b = F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    line = F.when(~flat, F.array(a, b)).otherwise(F.slice(F.array(a), 1, 0))
    return z.withColumn("line", line).filter(F.size("line") > 0).select("zone_id")


# --- filters -----------------------------------------------------------------


@query("flt_01_area_and_positive", "SELECT o_orderkey, o_custkey FROM orders JOIN customer ON o_custkey=c_custkey WHERE upper(trim(c_mktsegment))='MACHINERY' AND coalesce(nullif(o_custkey%4,0),0)>0")
def flt_01(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    ok = (F.upper(F.trim("c_mktsegment")) == "MACHINERY") & (F.coalesce(F.nullif(F.col("o_custkey") % 4, F.lit(0)), F.lit(0)) > 0)
    return o.join(c, o.o_custkey == c.c_custkey).filter(ok).select("o_orderkey", "o_custkey")


@query("flt_02_envelope_clip", cte("segments", "speed_zones") + """
, env AS (SELECT min(minx)+3000 AS ex0, min(miny)+3000 AS ey0, max(maxx)-3000 AS ex1, max(maxy)-3000 AS ey1 FROM segments),
 d AS (SELECT zone_id, x1,y1,x2-x1 AS dx,y2-y1 AS dy, ex0,ey0,ex1,ey1 FROM speed_zones, env),
 t AS (SELECT zone_id,
   CASE WHEN dx<>0 THEN least((ex0-x1)/dx,(ex1-x1)/dx) WHEN x1 BETWEEN ex0 AND ex1 THEN 0e0 ELSE 2e0 END AS tx0,
   CASE WHEN dx<>0 THEN greatest((ex0-x1)/dx,(ex1-x1)/dx) WHEN x1 BETWEEN ex0 AND ex1 THEN 1e0 ELSE -1e0 END AS tx1,
   CASE WHEN dy<>0 THEN least((ey0-y1)/dy,(ey1-y1)/dy) WHEN y1 BETWEEN ey0 AND ey1 THEN 0e0 ELSE 2e0 END AS ty0,
   CASE WHEN dy<>0 THEN greatest((ey0-y1)/dy,(ey1-y1)/dy) WHEN y1 BETWEEN ey0 AND ey1 THEN 1e0 ELSE -1e0 END AS ty1 FROM d)
SELECT zone_id FROM t WHERE greatest(tx0,ty0,0e0) <= least(tx1,ty1,1e0)""")
def flt_02(spark, sf):
    """Envelope of the master layer, shrunk so that it cuts; lines that meet it stay."""
    env = layer(spark, sf, "segments").agg(
        F.struct((F.min("minx") + 3000).alias("x0"), (F.min("miny") + 3000).alias("y0"),
                 (F.max("maxx") - 3000).alias("x1"), (F.max("maxy") - 3000).alias("y1")).alias("e")
    ).scalar()
    z = layer(spark, sf, "speed_zones").withColumn("e", env)
    edges = geo.ring_edges(geo.box_ring("e.x0", "e.y0", "e.x1", "e.y1"))
    box = (F.least("x1", "x2") <= F.col("e.x1")) & (F.greatest("x1", "x2") >= F.col("e.x0")) & (
        F.least("y1", "y2") <= F.col("e.y1")) & (F.greatest("y1", "y2") >= F.col("e.y0"))
    meets = geo.ring_piece_distance(edges, F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")) == 0
    return z.filter(box).filter(meets).select("zone_id")


@query("flt_03_array_any_match", """
SELECT doc_id FROM documents WHERE (doc_id%9=0) OR len(list_filter(string_split(source||';'||lang,';'), lambda x: x ILIKE '%en%')) > 0""")
def flt_03(spark, sf):
    d = table(spark, sf, "documents")
    tags = F.when(F.col("doc_id") % 9 == 0, None).otherwise(F.split(F.concat_ws(";", "source", "lang"), ";"))
    hit = F.col("tags").isNull() | F.exists("tags", lambda x: F.lower(x).contains("en"))
    return d.withColumn("tags", tags).filter(hit).select("doc_id")


@query("flt_04_area_polygon_with_margin", cte("areas", "lights") + """
SELECT light_id, count(*) AS n FROM lights, (SELECT minx,miny,maxx,maxy FROM areas WHERE area_id=7) a
WHERE sqrt(power(greatest(minx-px,px-maxx,0),2)+power(greatest(miny-py,py-maxy,0),2)) <= 200.05 GROUP BY light_id""")
def flt_04(spark, sf):
    """Points inside one area polygon or within a margin of it. One area row is a one-row side."""
    area = layer(spark, sf, "areas").filter("area_id = 7").select(
        F.struct("minx", "miny", "maxx", "maxy").alias("b")).limit(1).scalar()
    pts = layer(spark, sf, "lights").select("light_id", "px", "py").withColumn("b", area)
    box = F.col("px").between(F.col("b.minx") - 200.05, F.col("b.maxx") + 200.05) & F.col("py").between(
        F.col("b.miny") - 200.05, F.col("b.maxy") + 200.05)
    edges = geo.ring_edges(geo.box_ring("b.minx", "b.miny", "b.maxx", "b.maxy"))
    near = geo.ring_point_distance(edges, F.col("px"), F.col("py")) <= 200.05
    return pts.filter(box).filter(near).groupBy("light_id").agg(F.count(F.lit(1)).alias("n"))


@query("flt_05_coordinate_window", cte("segments") + "SELECT segment_id FROM segments WHERE minx<=6000 AND maxx>=2000 AND miny<=7000 AND maxy>=1500")
def flt_05(spark, sf):
    return layer(spark, sf, "segments").filter("minx<=6000 AND maxx>=2000 AND miny<=7000 AND maxy>=1500").select("segment_id")


@query("flt_06_point_in_box", cte("crashes") + "SELECT crash_id FROM crashes WHERE longitude BETWEEN 145.18 AND 145.42 AND latitude BETWEEN -38.25 AND -37.95")
def flt_06(spark, sf):
    return layer(spark, sf, "crashes").filter(
        F.col("longitude").between(145.18, 145.42) & F.col("latitude").between(-38.25, -37.95)
    ).select("crash_id")


def match_filter(df, suburb: str, path_class: str):
    """Suburb and class filter where "all" lets everything through."""
    if suburb != "all":
        df = df.filter(F.col("suburb") == suburb)
    if path_class != "all":
        df = df.filter(F.col("walk_path_class") == path_class)
    return df


@query("flt_07_match_count_bounds", cte("segments") + " " + " UNION ALL ".join(
    f"SELECT '{s}' AS suburb_arg, '{p}' AS class_arg, count(*) AS n, round(min(minx),4) AS west, round(min(miny),4) AS south, "
    f"round(max(maxx),4) AS east, round(max(maxy),4) AS north FROM segments WHERE "
    + ("true" if s == "all" else f"suburb='{s}'") + " AND " + ("true" if p == "all" else f"walk_path_class='{p}'")
    for s, p in (("all", "all"), ("Brand#3", "all"), ("all", "shared_use"), ("Brand#3", "footpath"))))
def flt_07(spark, sf):
    segs = segment_shapes(spark, sf)
    segs = segs.withColumns({f"b_{k}": v for k, v in geo.coord_bounds(F.col("ring")).items()})
    out = None
    for s, p in (("all", "all"), ("Brand#3", "all"), ("all", "shared_use"), ("Brand#3", "footpath")):
        part = match_filter(segs, s, p).agg(
            F.count(F.lit(1)).alias("n"), F.round(F.min("b_minx"), 4).alias("west"), F.round(F.min("b_miny"), 4).alias("south"),
            F.round(F.max("b_maxx"), 4).alias("east"), F.round(F.max("b_maxy"), 4).alias("north"),
        ).select(F.lit(s).alias("suburb_arg"), F.lit(p).alias("class_arg"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query("flt_08_caseless_match", cte("segments") + "SELECT segment_id FROM segments WHERE lower(coalesce(suburb,''))=lower('BRAND#4')")
def flt_08(spark, sf):
    return layer(spark, sf, "segments").filter(
        F.lower(F.coalesce("suburb", F.lit(""))) == F.lower(F.lit("BRAND#4"))).select("segment_id")


@query("flt_09_eligible_only", "SELECT o_orderkey FROM orders WHERE coalesce(CASE WHEN o_orderkey%5=0 THEN NULL ELSE o_orderstatus='F' END, false)")
def flt_09(spark, sf):
    flag = F.when(F.col("o_orderkey") % 5 == 0, None).otherwise(F.col("o_orderstatus") == "F")
    return table(spark, sf, "orders").filter(F.coalesce(flag, F.lit(False))).select("o_orderkey")


@query("flt_10_repeatable_sample", cte("lights") + "SELECT light_id, wattage_w FROM lights ORDER BY md5('42:'||light_id), light_id, wattage_w NULLS FIRST LIMIT 8000")
def flt_10(spark, sf):
    """n rows by hash order of the seed and key: the same rows on every run and engine, kept by a top-n, not a full sort."""
    t = layer(spark, sf, "lights").select("light_id", "wattage_w")
    return t.orderBy(F.md5(F.concat(F.lit("42:"), F.col("light_id").cast("string"))), "light_id", "wattage_w").limit(8000)


@query("flt_11_every_kth_by_hash", cte("segments") + "SELECT segment_id FROM segments WHERE ('0x'||substr(md5(segment_id::VARCHAR),1,7))::BIGINT % 3 = 0")
def flt_11(spark, sf):
    share = F.conv(F.substring(F.md5(F.col("segment_id").cast("string")), 1, 7), 16, 10).cast("bigint")
    return layer(spark, sf, "segments").filter(share % 3 == 0).select("segment_id")


@query("flt_12_class_filter_with_fallback", cte("segments") + """
SELECT segment_id, walk_path_class FROM segments WHERE walk_path_class='shared_use'
UNION ALL SELECT segment_id, 'any' FROM segments WHERE (SELECT count(*) FROM segments WHERE walk_path_class='bridleway')=0""")
def flt_12(spark, sf):
    """Keep a class, or all rows when the class is absent; the test is an EXISTS subquery."""
    segs = layer(spark, sf, "segments").select("segment_id", "walk_path_class")

    def keep_or_all(cls):
        n = segs.filter(F.col("walk_path_class") == cls).limit(1).agg(F.count(F.lit(1))).scalar()
        return segs.filter((n == 0) | (F.col("walk_path_class") == cls))

    return keep_or_all("shared_use").unionByName(
        keep_or_all("bridleway").select("segment_id", F.lit("any").alias("walk_path_class")))


_ROUTES_SQL = """routes AS (SELECT l_orderkey AS od_id, l_partkey AS route_id, l_extendedprice/40 AS distance_m,
  l_extendedprice/52 AS duration_s FROM lineitem)"""


@query("flt_13_detour_filter", f"""
WITH {_ROUTES_SQL}, m AS (SELECT od_id, min(distance_m) AS shortest FROM routes GROUP BY od_id)
SELECT r.od_id, r.route_id, round(distance_m,6) AS distance_m FROM routes r JOIN m USING (od_id) WHERE distance_m <= shortest*1.3""")
def flt_13(spark, sf):
    r = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("od_id"), F.col("l_partkey").alias("route_id"), (F.col("l_extendedprice") / 40).alias("distance_m"))
    w = O.group_min(r, ["od_id"], [F.min("distance_m").alias("shortest")])
    return w.filter(F.col("distance_m") <= F.col("shortest") * 1.3).select("od_id", "route_id", F.round("distance_m", 6).alias("distance_m"))


# --- quality flags -----------------------------------------------------------


def _case(*rules, default="ok"):
    return "CASE " + " ".join(f"WHEN {c} THEN '{l}'" for c, l in rules) + f" ELSE '{default}' END"


@query("qa_01_width", cte("segments") + f"""SELECT segment_id, {_case(('width_m IS NULL','missing'),('width_m=0','zero'),
 ('width_m<0.5','too_narrow'),('width_m>6','too_wide'))} AS width_qa_flag FROM segments""")
def qa_01(spark, sf):
    return layer(spark, sf, "segments").select("segment_id", Q.width_flag().alias("width_qa_flag"))


@query("qa_02_speed", cte("speed_zones") + f""", f AS (SELECT zone_id,
 {_case(('speed_limit_kmh IS NULL','missing_limit'),('speed_limit_kmh<10','below_range'),('speed_limit_kmh>110','above_range'))} AS speed_qa_flag,
 {_case(('zone_length_m IS NULL','missing_length'),('zone_length_m<=0','invalid_length'))} AS length_qa_flag FROM speed_zones)
SELECT *, CASE WHEN speed_qa_flag<>'ok' THEN speed_qa_flag WHEN length_qa_flag<>'ok' THEN length_qa_flag ELSE 'ok' END AS qa_flag FROM f""")
def qa_02(spark, sf):
    z = Q.with_flags(layer(spark, sf, "speed_zones"), Q.speed_flags(), {"qa_flag": ("speed_qa_flag", "length_qa_flag")})
    return z.select("zone_id", "speed_qa_flag", "length_qa_flag", "qa_flag")


@query("qa_03_graffiti", cte("graffiti") + f""", f AS (SELECT record_id,
 {_case(('graffiti_type IS NULL','missing_type'),("graffiti_type NOT IN ('Offensive','Non-Offensive')",'unknown_type'))} AS type_qa_flag,
 {_case(('created_date IS NULL','missing_created_date'),('days_to_remove<0','completed_before_created'))} AS date_qa_flag,
 {_case(('area_removed_m2 IS NULL','missing_area'),('area_removed_m2<0','invalid_area'),('area_removed_m2>500','high_area'))} AS area_qa_flag FROM graffiti)
SELECT *, CASE WHEN type_qa_flag<>'ok' THEN type_qa_flag WHEN date_qa_flag<>'ok' THEN date_qa_flag WHEN area_qa_flag<>'ok' THEN area_qa_flag ELSE 'ok' END AS qa_flag FROM f""")
def qa_03(spark, sf):
    g = layer(spark, sf, "graffiti").withColumn("completed_date", F.date_add("created_date", F.col("days_to_remove")))
    g = Q.with_flags(g, Q.graffiti_flags("graffiti_type", "area_removed_m2", "created_date", "completed_date"),
                     {"qa_flag": ("type_qa_flag", "date_qa_flag", "area_qa_flag")})
    return g.select("record_id", "type_qa_flag", "date_qa_flag", "area_qa_flag", "qa_flag")


_WATT_SQL = _case(("wattage_w IS NULL", "missing_wattage"), ("wattage_w=0", "zero_wattage"), ("wattage_w>400", "high_wattage"))


@query("qa_04_duplicate_lights", cte("lights") + f"""
SELECT light_id, wattage_w, {_WATT_SQL} AS wattage_qa_flag,
 CASE WHEN count(*) OVER (PARTITION BY light_id)>1 THEN 'duplicate_light_id' ELSE {_WATT_SQL} END AS qa_flag FROM lights""")
def qa_04(spark, sf):
    li = layer(spark, sf, "lights").select("light_id", "wattage_w").withColumn("wattage_qa_flag", Q.wattage_flag("wattage_w"))
    return Q.duplicate_key_flag(li, "light_id", "duplicate_light_id", "wattage_qa_flag", "qa_flag")


@query("qa_05_park_light_text", cte("park_lights") + f"""SELECT gisfid, {_case(('luminwatt IS NULL','missing_wattage'),
 ('try_cast(luminwatt AS DOUBLE)=0','zero_wattage'),('try_cast(luminwatt AS DOUBLE)>400','high_wattage'))} AS qa_flag FROM park_lights""")
def qa_05(spark, sf):
    return layer(spark, sf, "park_lights").select("gisfid", Q.text_wattage_flag("luminwatt").alias("qa_flag"))


@query("qa_06_crash", cte("crashes") + f""", f AS (SELECT crash_id,
 {_case(('latitude IS NULL OR longitude IS NULL','missing_coords'),('latitude=0 AND longitude=0','zero_coords'),
   ('latitude NOT BETWEEN -39.2 AND -33.9 OR longitude NOT BETWEEN 140.9 AND 149.9','out_of_vic_bounds'))} AS coord_qa_flag,
 {_case(('crash_date IS NULL','missing_date'))} AS date_qa_flag,
 CASE ({_LIGHT_SQL}) WHEN 'missing' THEN 'missing_light' WHEN 'other' THEN 'unknown_light' ELSE 'ok' END AS light_qa_flag FROM crashes)
SELECT *, CASE WHEN coord_qa_flag<>'ok' THEN coord_qa_flag WHEN date_qa_flag<>'ok' THEN date_qa_flag WHEN light_qa_flag<>'ok' THEN light_qa_flag ELSE 'ok' END AS qa_flag FROM f""")
def qa_06(spark, sf):
    c = Q.with_flags(layer(spark, sf, "crashes"), Q.crash_flags("latitude", "longitude", "crash_date", "light_condition"),
                     {"qa_flag": ("coord_qa_flag", "date_qa_flag", "light_qa_flag")})
    return c.select("crash_id", "coord_qa_flag", "date_qa_flag", "light_qa_flag", "qa_flag")


@query("qa_07_council_tree", cte("trees") + f""", f AS (SELECT asset_number,
 CASE WHEN coalesce(canopy_ew_width_m,0)=0 AND coalesce(canopy_ns_width_m,0)=0 THEN 'canopy_width_unpopulated' ELSE 'canopy_width_present' END AS canopy_qa_flag,
 {_case(('tree_height_m IS NULL','missing_height'),('tree_height_m=0','zero_height'))} AS height_qa_flag,
 {_case(("tree_age IS NULL OR trim(tree_age)=''",'missing_age'),("lower(trim(tree_age)) IN ('to be determined','not applicable','not appliable')",'placeholder_age'))} AS age_qa_flag FROM trees)
SELECT *, CASE WHEN height_qa_flag<>'ok' THEN height_qa_flag WHEN age_qa_flag NOT IN ('ok','placeholder_age') THEN age_qa_flag ELSE 'ok' END AS qa_flag FROM f""")
def qa_07(spark, sf):
    t = Q.with_flags(layer(spark, sf, "trees"), Q.tree_flags("canopy_ew_width_m", "canopy_ns_width_m", "tree_height_m", "tree_age"))
    t = t.withColumn("qa_flag", C.composite_flag("height_qa_flag", F.nullif(F.col("age_qa_flag"), F.lit("placeholder_age"))))
    return t.select("asset_number", "canopy_qa_flag", "height_qa_flag", "age_qa_flag", "qa_flag")


@query("qa_08_tree_density", cte("areas") + f""", a AS (SELECT area_id, CASE WHEN area_id%8=7 THEN ' ' ELSE tree_density END AS cls,
  CASE WHEN area_id%9=0 THEN NULL WHEN area_id%10=3 THEN 0e0 ELSE (maxx-minx)*(maxy-miny) END AS area_m2 FROM areas)
SELECT area_id, {_case(("cls IS NULL OR trim(cls)=''",'missing_density'),("lower(trim(cls)) NOT IN ('dense','medium','sparse')",'invalid_density'))} AS density_qa_flag,
 {_case(('area_m2 IS NULL OR area_m2<=0','invalid_area'))} AS area_qa_flag,
 CASE WHEN cls IS NULL OR trim(cls)='' THEN 'missing_density' WHEN lower(trim(cls)) NOT IN ('dense','medium','sparse') THEN 'invalid_density'
  WHEN area_m2 IS NULL OR area_m2<=0 THEN 'invalid_area' ELSE 'ok' END AS qa_flag FROM a""")
def qa_08(spark, sf):
    a = layer(spark, sf, "areas").withColumn("cls", F.when(F.col("area_id") % 8 == 7, " ").otherwise(F.col("tree_density")))
    size = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))
    a = a.withColumn("area_m2", F.when(F.col("area_id") % 9 == 0, None).when(F.col("area_id") % 10 == 3, 0.0).otherwise(size))
    a = Q.with_flags(a, Q.density_flags("cls", "area_m2"), {"qa_flag": ("density_qa_flag", "area_qa_flag")})
    return a.select("area_id", "density_qa_flag", "area_qa_flag", "qa_flag")


@query("qa_09_urban_heat", f"""SELECT event_id, {_case(('v IS NULL','missing_uhi'),('v < -10 OR v > 20','outlier_uhi'))} AS qa_flag
 FROM (SELECT event_id, CASE WHEN event_id%13=0 THEN NULL ELSE value-20 END AS v FROM events)""")
def qa_09(spark, sf):
    e = table(spark, sf, "events").withColumn("v", F.when(F.col("event_id") % 13 == 0, None).otherwise(F.col("value") - 20))
    return e.select("event_id", Q.heat_flag("v").alias("qa_flag"))


_PLACE = "('to be determined','not applicable','not appliable')"


@query("qa_10_fountain", cte("fountains") + f""", f AS (SELECT gisfid,
 {_case(("condition IS NULL OR trim(condition)=''",'missing_condition'),(f"lower(trim(condition)) IN {_PLACE}",'placeholder_condition'))} AS condition_qa_flag,
 {_case(("dftype IS NULL OR trim(dftype)=''",'missing_type'),("lower(trim(dftype)) IN ('to be determined','not applicable')",'placeholder_type'))} AS type_qa_flag FROM fountains)
SELECT *, CASE WHEN condition_qa_flag='placeholder_condition' THEN condition_qa_flag WHEN type_qa_flag<>'ok' THEN type_qa_flag ELSE 'ok' END AS qa_flag FROM f""")
def qa_10(spark, sf):
    f = Q.with_flags(layer(spark, sf, "fountains"), Q.fountain_flags("condition", "dftype"))
    f = f.withColumn("qa_flag", C.composite_flag(F.nullif(F.col("condition_qa_flag"), F.lit("missing_condition")), "type_qa_flag"))
    return f.select("gisfid", "condition_qa_flag", "type_qa_flag", "qa_flag")


@query("qa_11_bench", cte("benches") + f"""SELECT gisfid,
 {_case(("quantity IS NULL OR trim(quantity)=''",'missing_quantity'),('try_cast(quantity AS INTEGER)=0','zero_quantity'))} AS quantity_qa_flag,
 {_case(("capacity IS NULL OR trim(capacity)=''",'missing_capacity'),("lower(trim(capacity))='tbd'",'placeholder_capacity'))} AS capacity_qa_flag,
 {_case(('furncap IS NULL','missing_furncap'),('furncap=0','zero_furncap'))} AS furncap_qa_flag, 'ok' AS qa_flag FROM benches""")
def qa_11(spark, sf):
    b = layer(spark, sf, "benches")
    flags = Q.bench_flags("quantity", "capacity", "furncap")
    return b.select("gisfid", *[v.alias(k) for k, v in flags.items()])


@query("qa_12_school_crossing", cte("school_crossings") + f""", f AS (SELECT gisfid,
 {_case(("name_of_school IS NULL OR trim(name_of_school)=''",'missing_school'))} AS school_qa_flag,
 {_case(("streetname IS NULL OR trim(streetname)=''",'missing_street'))} AS street_qa_flag FROM school_crossings)
SELECT *, CASE WHEN school_qa_flag<>'ok' THEN school_qa_flag WHEN street_qa_flag<>'ok' THEN street_qa_flag ELSE 'ok' END AS qa_flag FROM f""")
def qa_12(spark, sf):
    s = Q.with_flags(layer(spark, sf, "school_crossings"), {
        "school_qa_flag": Q.missing_text_flag("name_of_school", "missing_school"),
        "street_qa_flag": Q.missing_text_flag("streetname", "missing_street"),
    }, {"qa_flag": ("school_qa_flag", "street_qa_flag")})
    return s.select("gisfid", "school_qa_flag", "street_qa_flag", "qa_flag")


@query("qa_13_toilets_dog_bags", """
WITH t AS (SELECT s_suppkey AS gisfid, CASE s_suppkey%4 WHEN 0 THEN NULL WHEN 1 THEN s_name||' - Not a Public Toilet' WHEN 2 THEN ' ' ELSE s_name END AS name,
  CASE WHEN s_suppkey%3=0 THEN NULL ELSE 'bin' END AS description, CASE WHEN s_suppkey%2=0 THEN NULL ELSE 'type' END AS wcptype FROM supplier)
SELECT gisfid, CASE WHEN name IS NULL OR trim(name)='' THEN 'missing_name' WHEN name ILIKE '%not a public toilet%' THEN 'not_public_toilet' ELSE 'ok' END AS toilet_flag,
 CASE WHEN description IS NULL AND wcptype IS NULL THEN 'missing_type' ELSE 'ok' END AS dog_bag_flag FROM t""")
def qa_13(spark, sf):
    k = F.col("s_suppkey")
    t = table(spark, sf, "supplier").select(
        k.alias("gisfid"),
        F.when(k % 4 == 0, None).when(k % 4 == 1, F.concat("s_name", F.lit(" - Not a Public Toilet"))).when(k % 4 == 2, " ").otherwise(F.col("s_name")).alias("name"),
        F.when(k % 3 == 0, None).otherwise("bin").alias("description"), F.when(k % 2 == 0, None).otherwise("type").alias("wcptype"),
    )
    toilet = C.first_label([(C.blank("name"), "missing_name"), (F.lower("name").contains("not a public toilet"), "not_public_toilet")])
    bags = C.first_label([(F.col("description").isNull() & F.col("wcptype").isNull(), "missing_type")])
    return t.select("gisfid", toilet.alias("toilet_flag"), bags.alias("dog_bag_flag"))


# --- aggregates --------------------------------------------------------------


@query("agg_01_value_counts", cte("crashes") + f"SELECT {_LIGHT_SQL} AS value, count(*) AS n FROM crashes GROUP BY 1")
def agg_01(spark, sf):
    return A.value_counts(layer(spark, sf, "crashes"), Q.light_category("light_condition"))


@query("agg_02_top_values", cte("segments") + "SELECT coalesce(suburb,'(null)') AS value, count(*) AS n FROM segments GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def agg_02(spark, sf):
    return A.top_values(layer(spark, sf, "segments"), "suburb", 10)


@query("agg_03_count_by_year", cte("crashes") + "SELECT CAST(year(crash_date) AS INTEGER) AS yr, count(*) AS n FROM crashes GROUP BY 1")
def agg_03(spark, sf):
    return layer(spark, sf, "crashes").groupBy(F.year("crash_date").alias("yr")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_04_min_max", cte("graffiti") + "SELECT min(created_date) AS first_date, max(created_date) AS last_date, min(area_removed_m2) AS min_area, max(area_removed_m2) AS max_area FROM graffiti")
def agg_04(spark, sf):
    return layer(spark, sf, "graffiti").agg(
        F.min("created_date").alias("first_date"), F.max("created_date").alias("last_date"),
        F.min("area_removed_m2").alias("min_area"), F.max("area_removed_m2").alias("max_area"))


@query("agg_05_measure_summary", cte("trees") + """SELECT tree_type, round(min(tree_height_m),4) AS min, round(max(tree_height_m),4) AS max,
 round(quantile_cont(tree_height_m,0.5),4) AS median, round(avg(tree_height_m),4) AS mean, count(*) FILTER (WHERE tree_height_m IS NULL) AS null_count, count(*) AS n FROM trees GROUP BY 1""")
def agg_05(spark, sf):
    s = A.score_summary(layer(spark, sf, "trees").select("tree_type", "tree_height_m"), "tree_height_m", ["tree_type"])
    return s.select("tree_type", *[F.round(c, 4).alias(c) for c in ("min", "max", "median", "mean")], "null_count", "n")


@query("agg_06_length_km", cte("segments") + "SELECT walk_path_class, round(sum(coalesce(CASE WHEN segment_id%7=0 THEN NULL ELSE length_m END,0))/1000,1) AS length_km FROM segments GROUP BY 1")
def agg_06(spark, sf):
    le = F.when(F.col("segment_id") % 7 == 0, None).otherwise(F.col("length_m"))
    return layer(spark, sf, "segments").groupBy("walk_path_class").agg(
        F.round(F.sum(F.coalesce(le, F.lit(0.0))) / 1000, 1).alias("length_km"))


@query("agg_07_area_by_class", cte("segments") + "SELECT walk_path_class, round(sum((maxx-minx)*(maxy-miny)),2) AS area_m2 FROM segments GROUP BY 1")
def agg_07(spark, sf):
    return segment_shapes(spark, sf).groupBy("walk_path_class").agg(F.round(F.sum(geo.ring_area(F.col("ring"))), 2).alias("area_m2"))


@query("agg_08_count_distinct", cte("lights") + "SELECT provider, count(DISTINCT light_id) AS n_lights FROM lights GROUP BY 1")
def agg_08(spark, sf):
    return layer(spark, sf, "lights").groupBy("provider").agg(F.countDistinct("light_id").alias("n_lights"))


@query("agg_09_filtered_aggregates", cte("crashes") + """SELECT count(*) AS n, count(*) FILTER (WHERE night_eligible) AS n_night,
 count(*) FILTER (WHERE crash_date >= DATE '1996-08-01') AS n_5y, min(crash_date) FILTER (WHERE night_eligible) AS first_night FROM crashes""")
def agg_09(spark, sf):
    return layer(spark, sf, "crashes").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("night_eligible").alias("n_night"),
        F.count_if(F.col("crash_date") >= F.add_months(F.lit(RUN_DATE).cast("date"), -60)).alias("n_5y"),
        F.min(F.when(F.col("night_eligible"), F.col("crash_date"))).alias("first_night"))


@query("agg_10_null_rates", cte("segments") + "SELECT 'width_m' AS column_name, avg((width_m IS NULL)::INT) AS null_rate FROM segments UNION ALL SELECT 'suburb', avg((suburb IS NULL)::INT) FROM segments UNION ALL SELECT 't1key', avg((t1key IS NULL)::INT) FROM segments UNION ALL SELECT 'length_m', avg((length_m IS NULL)::INT) FROM segments")
def agg_10(spark, sf):
    return A.null_rates(layer(spark, sf, "segments"), ["width_m", "suburb", "t1key", "length_m"])


@query("agg_11_score_distribution", """WITH s AS (SELECT CASE WHEN o_orderkey%9=0 THEN NULL ELSE o_totalprice/5000 END AS score FROM orders WHERE o_orderstatus='F')
SELECT round(quantile_cont(score,0.5),6) AS median, round(avg(score),6) AS mean, round(min(score),6) AS min, round(max(score),6) AS max, count(*) FILTER (WHERE score IS NULL) AS null_count, count(*) AS n FROM s""")
def agg_11(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(
        F.when(F.col("o_orderkey") % 9 == 0, None).otherwise(F.col("o_totalprice") / 5000).alias("score"))
    s = A.score_summary(o, "score")
    return s.select(*[F.round(c, 6).alias(c) for c in ("median", "mean", "min", "max")], "null_count", "n")


@query("agg_12_weighted_mean", """WITH s AS (SELECT l_suppkey, CASE WHEN l_partkey%5=0 THEN NULL ELSE l_discount*1000 END AS score, l_quantity AS w FROM lineitem)
SELECT l_suppkey, round(sum(score*w)/nullif(sum(CASE WHEN score IS NOT NULL THEN w END),0),6) AS mean_score FROM s GROUP BY 1""")
def agg_12(spark, sf):
    s = table(spark, sf, "lineitem").select(
        "l_suppkey", F.when(F.col("l_partkey") % 5 == 0, None).otherwise(F.col("l_discount") * 1000).alias("score"), F.col("l_quantity").alias("w"))
    return s.groupBy("l_suppkey").agg(F.round(C.weighted_mean("score", "w"), 6).alias("mean_score"))


@query("agg_13_mode_with_fallback", """WITH s AS (SELECT l_suppkey, CASE WHEN l_suppkey%10=0 THEN NULL ELSE l_returnflag END AS conf FROM lineitem),
 c AS (SELECT l_suppkey, conf, count(*) AS n FROM s WHERE conf IS NOT NULL GROUP BY 1,2),
 r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, conf) AS rn FROM c)
SELECT k.l_suppkey, coalesce(r.conf,'reduced') AS confidence FROM (SELECT DISTINCT l_suppkey FROM lineitem) k LEFT JOIN r ON r.l_suppkey=k.l_suppkey AND rn=1""")
def agg_13(spark, sf):
    s = table(spark, sf, "lineitem").select(
        "l_suppkey", F.when(F.col("l_suppkey") % 10 == 0, None).otherwise(F.col("l_returnflag")).alias("conf"))
    return A.frequent_value(s, ["l_suppkey"], "conf", "confidence", "reduced")


@query("agg_14_arg_best", """SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS biggest, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS smallest FROM orders GROUP BY 1""")
def agg_14(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.max_by(k, F.struct("o_totalprice", -k)).alias("biggest"), F.min_by(k, F.struct("o_totalprice", k)).alias("smallest"))


@query("agg_15_dissolve_bounds", cte("segments") + """SELECT suburb, min(ward) AS ward, count(*) AS parts, round(min(minx),4) AS west, round(min(miny),4) AS south, round(max(maxx),4) AS east, round(max(maxy),4) AS north
 FROM segments WHERE suburb IS NOT NULL GROUP BY suburb""")
def agg_15(spark, sf):
    return layer(spark, sf, "segments").filter("suburb IS NOT NULL").groupBy("suburb").agg(
        F.min("ward").alias("ward"), F.count(F.lit(1)).alias("parts"), F.round(F.min("minx"), 4).alias("west"),
        F.round(F.min("miny"), 4).alias("south"), F.round(F.max("maxx"), 4).alias("east"), F.round(F.max("maxy"), 4).alias("north"))


@query("agg_16_reporting_levels", cte("segments") + """SELECT CASE grouping(suburb,ward) WHEN 1 THEN 'small' WHEN 2 THEN 'large' ELSE 'whole' END AS level, suburb, ward,
 count(*) AS n, round(sum(length_m)/1000,1) AS length_km, round(avg(width_m),6) AS mean_width, count(*) FILTER (WHERE walk_path_class='shared_use') AS shared_use
 FROM segments GROUP BY GROUPING SETS ((suburb),(ward),()) HAVING grouping(suburb,ward)=3 OR (grouping(suburb,ward)=1 AND suburb IS NOT NULL) OR (grouping(suburb,ward)=2 AND ward IS NOT NULL)""")
def agg_16(spark, sf):
    return A.reporting_levels(layer(spark, sf, "segments"), "suburb", "ward", [
        F.count(F.lit(1)).alias("n"), F.round(F.sum("length_m") / 1000, 1).alias("length_km"),
        F.round(F.avg("width_m"), 6).alias("mean_width"), F.count_if(F.col("walk_path_class") == "shared_use").alias("shared_use")])


@query("agg_17_percentile_pair", """SELECT round(quantile_cont(l_extendedprice,0.1),6) AS p10, round(quantile_cont(l_extendedprice,0.9),6) AS p90,
 'price' AS stream FROM lineitem UNION ALL SELECT round(quantile_cont(l_discount,0.1),6), round(quantile_cont(l_discount,0.9),6), 'discount' FROM lineitem""")
def agg_17(spark, sf):
    li = table(spark, sf, "lineitem")
    streams = {"price": "l_extendedprice", "discount": "l_discount"}
    long = li.select(F.explode(F.create_map(*[x for k, v in streams.items() for x in (F.lit(k), F.col(v))])).alias("stream", "v"))
    q = O.exact_quantiles(long, "v", {"p10": 0.1, "p90": 0.9}, ["stream"])
    return q.select("stream", F.round("p10", 6).alias("p10"), F.round("p90", 6).alias("p90"))


@query("agg_18_envelope", cte("segments") + "SELECT round(min(minx),4) AS west, round(min(miny),4) AS south, round(max(maxx),4) AS east, round(max(maxy),4) AS north FROM segments")
def agg_18(spark, sf):
    s = segment_shapes(spark, sf).withColumns({f"b_{k}": v for k, v in geo.coord_bounds(F.col("ring")).items()})
    return s.agg(F.round(F.min("b_minx"), 4).alias("west"), F.round(F.min("b_miny"), 4).alias("south"),
                 F.round(F.max("b_maxx"), 4).alias("east"), F.round(F.max("b_maxy"), 4).alias("north"))


@query("agg_20_win_tally", """WITH r AS (SELECT l_orderkey AS od_id, CASE WHEN l_linenumber=1 THEN 'challenger' ELSE 'control' END AS engine, round(l_discount*100) AS score FROM lineitem),
 m AS (SELECT od_id, max(score) FILTER (WHERE engine='control') AS c, max(score) FILTER (WHERE engine='challenger') AS h FROM r GROUP BY 1 HAVING c IS NOT NULL AND h IS NOT NULL)
SELECT CASE WHEN abs(h-c)<0.05 THEN 'tie' WHEN h>c THEN 'challenger' ELSE 'control' END AS winner, count(*) AS n, round(avg(h-c),6) AS mean_delta FROM m GROUP BY 1""")
def agg_20(spark, sf):
    li = table(spark, sf, "lineitem")
    r = li.select(F.col("l_orderkey").alias("od_id"), (F.col("l_linenumber") == 1).alias("ch"), F.round(F.col("l_discount") * 100).alias("score"))
    m = r.groupBy("od_id").agg(F.max(F.when(~F.col("ch"), F.col("score"))).alias("c"), F.max(F.when(F.col("ch"), F.col("score"))).alias("h"))
    d = F.col("h") - F.col("c")
    m = m.filter("c IS NOT NULL AND h IS NOT NULL").withColumn(
        "winner", F.when(F.abs(d) < 0.05, "tie").when(d > 0, "challenger").otherwise("control"))
    return m.groupBy("winner").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(d), 6).alias("mean_delta"))


@query("agg_21_style_stats", cte("segments") + """SELECT 'width_m' AS column_name, round(min(width_m),4) AS min, round(max(width_m),4) AS max, round(quantile_cont(width_m,0.5),4) AS median, CAST(NULL AS VARCHAR) AS categories FROM segments
UNION ALL SELECT 'walk_path_class', NULL, NULL, NULL, string_agg(DISTINCT walk_path_class, ',' ORDER BY walk_path_class) FROM segments""")
def agg_21(spark, sf):
    s = layer(spark, sf, "segments")
    num = A.score_summary(s.select("width_m"), "width_m").select(
        F.lit("width_m").alias("column_name"), F.round("min", 4).alias("min"), F.round("max", 4).alias("max"), F.round("median", 4).alias("median"))
    cat = s.groupBy("walk_path_class").agg(F.count(F.lit(1)).alias("n")).agg(
        F.array_join(F.array_sort(F.collect_set("walk_path_class")), ",").alias("categories")).select(F.lit("walk_path_class").alias("column_name"), "categories")
    return num.unionByName(cat, allowMissingColumns=True)


@query("agg_22_bands_and_flags", """WITH r AS (SELECT o_orderkey AS od_id, (o_totalprice%1000)/1000 AS m1, (o_totalprice%777)/777 AS m3, CASE WHEN o_orderkey%7=0 THEN NULL ELSE (o_totalprice%900)/600 END AS m4 FROM orders),
 b AS (SELECT *, CASE WHEN m1>=0.85 THEN 'strong' WHEN m1>=0.70 THEN 'ok' ELSE 'weak' END AS m1_band,
  concat_ws(';', CASE WHEN m1<0.70 THEN 'low_path_cover' END, CASE WHEN m3<0.85 THEN 'off_network' END, CASE WHEN m4>1.25 THEN 'much_longer' END, CASE WHEN m4<0.85 THEN 'much_shorter' END) AS flags FROM r)
SELECT m1_band, flags, count(*) AS n FROM b GROUP BY 1,2""")
def agg_22(spark, sf):
    p = F.col("o_totalprice")
    r = table(spark, sf, "orders").select(
        (p % 1000 / 1000).alias("m1"), (p % 777 / 777).alias("m3"), F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(p % 900 / 600).alias("m4"))
    from ..operators.reports import fitness_band, fitness_flags
    b = r.select(fitness_band("m1").alias("m1_band"), fitness_flags("m1", "m3", "m4").alias("flags"))
    return b.groupBy("m1_band", "flags").agg(F.count(F.lit(1)).alias("n"))


@query("agg_23_distinct_suburbs", cte("segments") + "SELECT DISTINCT suburb FROM segments WHERE suburb IS NOT NULL AND trim(suburb)<>''")
def agg_23(spark, sf):
    return layer(spark, sf, "segments").filter(~C.blank("suburb")).select("suburb").distinct().orderBy("suburb")


@query("agg_24_corridor_extract", cte("segments") + """, ids AS (SELECT p_partkey AS segment_id, p_size AS corridor_id FROM part WHERE p_partkey%6=1)
SELECT corridor_id, count(*) AS n, round(sum(length_m),2) AS length_m, count(*) FILTER (WHERE walk_path_class='shared_use') AS shared_use, round(quantile_cont(width_m,0.5),4) AS median_width
FROM ids JOIN segments USING (segment_id) GROUP BY 1""")
def agg_24(spark, sf):
    ids = table(spark, sf, "part").filter("p_partkey%6=1").select(F.col("p_partkey").alias("segment_id"), F.col("p_size").alias("corridor_id"))
    hit = ids.join(layer(spark, sf, "segments"), "segment_id")
    base = hit.groupBy("corridor_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("length_m"), 2).alias("length_m"),
                                          F.count_if(F.col("walk_path_class") == "shared_use").alias("shared_use"))
    med = O.exact_quantiles(hit, "width_m", {"m": 0.5}, ["corridor_id"]).select("corridor_id", F.round("m", 4).alias("median_width"))
    return base.join(med, "corridor_id", "left")


# --- windows -----------------------------------------------------------------


@query("win_01_repeat_count", cte("lights") + "SELECT light_id, count(*) AS n FROM lights GROUP BY 1 HAVING count(*)>1")
def win_01(spark, sf):
    return layer(spark, sf, "lights").groupBy("light_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("win_02_percentile_rank", """WITH e AS (SELECT o_orderkey, CASE WHEN o_orderkey%8=0 THEN NULL ELSE floor(o_totalprice/100) END AS v, o_orderstatus='F' AS ok FROM orders),
 r AS (SELECT o_orderkey, (rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v)-1)/2)/count(*) OVER () AS pct FROM e WHERE ok AND v IS NOT NULL)
SELECT e.o_orderkey, round(coalesce(pct,0.5),9) AS pct FROM e LEFT JOIN r USING (o_orderkey)""")
def win_02(spark, sf):
    e = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 8 == 0, None).otherwise(F.floor(F.col("o_totalprice") / 100).cast("double")).alias("v"),
        (F.col("o_orderstatus") == "F").alias("ok"))
    return O.percentile_rank(e, "v", "pct", F.col("ok")).select("o_orderkey", F.round("pct", 9).alias("pct"))


@query("win_03_latest_per_key", """SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn=1""")
def win_03(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"))
    return A.latest_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("win_04_ratio_to_shortest", f"WITH {_ROUTES_SQL} SELECT od_id, route_id, round(distance_m/min(distance_m) OVER (PARTITION BY od_id),6) AS detour FROM routes")
def win_04(spark, sf):
    r = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("od_id"), F.col("l_partkey").alias("route_id"), (F.col("l_extendedprice") / 40).alias("d"))
    w = O.group_min(r, ["od_id"], [F.min("d").alias("s")])
    return w.select("od_id", "route_id", F.round(F.col("d") / F.col("s"), 6).alias("detour"))


# --- top-k -------------------------------------------------------------------


@query("top_01_outlier_sample", cte("segments") + f""", f AS (SELECT segment_id, width_m, suburb, {_case(('width_m IS NULL','missing'),('width_m=0','zero'),
 ('width_m<0.5','too_narrow'),('width_m>6','too_wide'))} AS width_qa_flag FROM segments)
SELECT * FROM f WHERE width_qa_flag<>'ok' ORDER BY CASE width_qa_flag WHEN 'too_wide' THEN 1 WHEN 'zero' THEN 2 WHEN 'too_narrow' THEN 3 ELSE 4 END, width_m DESC NULLS LAST, segment_id LIMIT 50""")
def top_01(spark, sf):
    s = layer(spark, sf, "segments").select("segment_id", "width_m", "suburb", Q.width_flag().alias("width_qa_flag"))
    f = F.col("width_qa_flag")
    order = F.when(f == "too_wide", 1).when(f == "zero", 2).when(f == "too_narrow", 3).otherwise(4)
    return s.filter(f != "ok").orderBy(order, F.desc_nulls_last("width_m"), "segment_id").limit(50)


@query("top_02_smallest_delta", "SELECT o_orderkey, round(o_totalprice-250000,2) AS delta FROM orders ORDER BY o_totalprice-250000, o_orderkey LIMIT 15")
def top_02(spark, sf):
    d = F.col("o_totalprice") - 250000
    return table(spark, sf, "orders").orderBy(d, "o_orderkey").limit(15).select("o_orderkey", F.round(d, 2).alias("delta"))


@query("top_03_multi_key_order", """SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey FROM lineitem ORDER BY l_discount, l_tax, abs(l_extendedprice-50000), l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 100""")
def top_03(spark, sf):
    return table(spark, sf, "lineitem").orderBy(
        "l_discount", "l_tax", F.abs(F.col("l_extendedprice") - 50000), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
    ).limit(100).select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey")


@query("top_04_cap_per_group", f"""WITH {_ROUTES_SQL} SELECT od_id, route_id, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY od_id ORDER BY distance_m, route_id) AS rn FROM routes) WHERE rn<=3""")
def top_04(spark, sf):
    r = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("od_id"), F.col("l_partkey").alias("route_id"), (F.col("l_extendedprice") / 40).alias("distance_m"))
    return O.top_k(r, ["od_id"], [F.col("distance_m"), F.col("route_id")], 3).select("od_id", "route_id", "rank")


# --- sets --------------------------------------------------------------------


@query("set_01_append_dedupe", """SELECT k, min(src) AS src FROM (SELECT o_custkey AS k, 1 AS src FROM orders UNION ALL SELECT c_custkey, 2 FROM customer) GROUP BY k""")
def set_01(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.lit(1).alias("src"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit(2).alias("src"))
    return a.unionByName(b).groupBy("k").agg(F.min("src").alias("src"))


@query("set_02_union_all", "SELECT layer, count(*) AS n FROM (SELECT 'a' AS layer FROM part UNION ALL SELECT 'b' FROM customer) GROUP BY 1")
def set_02(spark, sf):
    a = table(spark, sf, "part").select(F.lit("a").alias("layer"))
    return a.unionByName(table(spark, sf, "customer").select(F.lit("b").alias("layer"))).groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


@query("set_03_union_of_keys", """WITH a AS (SELECT o_custkey AS k, count(*) AS n_orders FROM orders WHERE o_orderstatus='P' GROUP BY 1), b AS (SELECT c_custkey AS k, c_acctbal FROM customer WHERE c_nationkey<12)
SELECT k, n_orders, c_acctbal FROM a FULL JOIN b USING (k)""")
def set_03(spark, sf):
    a = table(spark, sf, "orders").filter("o_orderstatus='P'").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n_orders"))
    b = table(spark, sf, "customer").filter("c_nationkey<12").select(F.col("c_custkey").alias("k"), "c_acctbal")
    return a.join(b, "k", "full")


@query("set_04_key_difference", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus='P')")
def set_04(spark, sf):
    used = table(spark, sf, "orders").filter("o_orderstatus='P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(used, "c_custkey", "left_anti")


# --- scalar families ---------------------------------------------------------


@query("fn_text", """SELECT doc_id, upper(trim(lang)) AS u, coalesce(nullif(lower(trim(string_split(source||';x',';')[1])),''),'unknown') AS first_tag,
 starts_with(source,'w') AS sw, contains(source,'o') AS ct, concat_ws(';', lang, NULLIF(source,'zzz')) AS tags, lang ILIKE 'E%' AS il FROM documents""")
def fn_text(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.upper(F.trim("lang")).alias("u"),
        F.coalesce(F.nullif(F.lower(F.trim(F.element_at(F.split(F.concat("source", F.lit(";x")), ";"), 1))), F.lit("")), F.lit("unknown")).alias("first_tag"),
        F.col("source").startswith("w").alias("sw"), F.col("source").contains("o").alias("ct"),
        F.concat_ws(";", "lang", F.nullif(F.col("source"), F.lit("zzz"))).alias("tags"), F.col("lang").ilike("E%").alias("il"))


@query("fn_dates", f"""SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(date_diff('day', CAST(ts AS DATE), DATE '{EVENTS_RUN_DATE}') AS INTEGER) AS days_since,
 CAST(ts AS DATE) >= DATE '{EVENTS_RUN_DATE}' - INTERVAL 20 DAY AS recent, try_cast(event_type AS DATE) AS bad FROM events""")
def fn_dates(spark, sf):
    run = F.lit(EVENTS_RUN_DATE).cast("date")
    return table(spark, sf, "events").select(
        "event_id", F.year("ts").alias("y"), F.datediff(run, F.to_date("ts")).alias("days_since"),
        (F.to_date("ts") >= F.date_sub(run, 20)).alias("recent"), F.col("event_type").try_cast("date").alias("bad"))


@query("fn_sphere", cte("crashes") + """, p AS (SELECT crash_id, longitude AS a, latitude AS b, longitude+0.01 AS c, latitude-0.02 AS d FROM crashes WHERE latitude < -30)
SELECT crash_id, round(2*6371000*asin(least(1,sqrt(power(sin(radians(d-b)/2),2)+cos(radians(b))*cos(radians(d))*power(sin(radians(c-a)/2),2)))),4) AS metres,
 round(((degrees(atan2(sin(radians(c-a))*cos(radians(d)), cos(radians(b))*sin(radians(d))-sin(radians(b))*cos(radians(d))*cos(radians(c-a))))+360)%360),6) AS heading FROM p""")
def fn_sphere(spark, sf):
    p = layer(spark, sf, "crashes").filter("latitude < -30")
    args = (F.col("longitude"), F.col("latitude"), F.col("longitude") + 0.01, F.col("latitude") - 0.02)
    return p.select("crash_id", F.round(geo.haversine(*args), 4).alias("metres"), F.round(geo.bearing(*args), 6).alias("heading"))


@query("fn_destination_round_trip", cte("crashes") + "SELECT crash_id, 500.0e0 AS metres, CAST(crash_id%360 AS DOUBLE) AS heading FROM crashes WHERE latitude < -30")
def fn_destination(spark, sf):
    p = layer(spark, sf, "crashes").filter("latitude < -30").withColumn("h", (F.col("crash_id") % 360).cast("double"))
    p = p.withColumn("d", geo.destination("longitude", "latitude", F.lit(500.0), "h"))
    args = (F.col("longitude"), F.col("latitude"), F.col("d.lng"), F.col("d.lat"))
    return p.select("crash_id", F.round(geo.haversine(*args), 4).alias("metres"),
                    F.pmod(F.round(geo.bearing(*args), 4), F.lit(360.0)).alias("heading"))


@query("fn_planar", cte("speed_zones") + """SELECT zone_id, round(sqrt(power(x2-x1,2)+power(y2-y1,2)),6) AS len, round((x1+x2)/2,4) AS mx, round(x1+(x2-x1)*0.25,4) AS qx FROM speed_zones""")
def fn_planar(spark, sf):
    z = layer(spark, sf, "speed_zones")
    line = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    return z.select("zone_id", F.round(geo.line_length(line), 6).alias("len"), F.round((F.col("x1") + F.col("x2")) / 2, 4).alias("mx"),
                    F.round(F.col("x1") + (F.col("x2") - F.col("x1")) * 0.25, 4).alias("qx"))


@query("fn_json_map", """SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k, (props->>'$.missing') IS NULL AS no_key, contains(props,'"k": 6') AS has_six FROM events""")
def fn_json(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.from_json("props", "k INT")["k"].alias("k"), F.get_json_object("props", "$.missing").isNull().alias("no_key"),
        F.col("props").contains('"k": 6').alias("has_six"))
