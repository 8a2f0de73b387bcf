"""Sources and sinks: tables written as layer files in the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import aggregates as A
from ..operators import quality as Q
from ..session import scratch_path
from ..sources import readers as I
from ..sources import sinks as K
from ..sources.wkb import LINE, MULTIPOLYGON, POINT, POLYGON
from ..streaming import sessions as T
from .bindings import cte, layer, segment_shapes, table
from .registry import query


def _point(x, y):
    return F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))


_CR = "SELECT crash_id, severity_raw, round(longitude,6) AS lng, round(latitude,6) AS lat FROM crashes WHERE longitude IS NOT NULL"


def _crash_points(spark, sf):
    return layer(spark, sf, "crashes").filter("longitude IS NOT NULL")


def _geojson(spark, sf, gzip):
    path = scratch_path(spark, "geojson")
    K.write_feature_lines(_crash_points(spark, sf), path, _point(F.col("longitude"), F.col("latitude")), ["crash_id", "severity_raw"], gzip)
    f = I.read_feature_lines(spark, path, "crash_id:bigint,severity_raw:string")
    xy = F.col("geometry.coordinates")
    return f.select("crash_id", "severity_raw", F.round(xy[0], 6).alias("lng"), F.round(xy[1], 6).alias("lat"))


@query("src_01_geojson_features", cte("crashes") + _CR)
def src_01(spark, sf):
    return _geojson(spark, sf, False)


@query("snk_02_geojson_lines", cte("crashes") + """SELECT crash_id, '{"type":"Feature","geometry":{"type":"Point","coordinates":['||crash_id||','||crash_id%90||']},"properties":{"crash_id":'||crash_id||'}}' AS line FROM crashes""")
def snk_02(spark, sf):
    path = scratch_path(spark, "lines")
    k = F.col("crash_id")
    K.write_feature_lines(layer(spark, sf, "crashes"), path, _point(k, k % 90), ["crash_id"])
    t = spark.read.text(path)
    return t.select(F.get_json_object("value", "$.properties.crash_id").cast("bigint").alias("crash_id"), F.col("value").alias("line"))


@query("snk_03_geojson_gzip", cte("crashes") + _CR)
def snk_03(spark, sf):
    return _geojson(spark, sf, True)


@query("src_02_csv_bad_rows_skipped", "SELECT o_orderkey AS crash_id, round(o_totalprice,2) AS price, o_orderpriority AS severity FROM orders WHERE o_orderkey%50<>0")
def src_02(spark, sf):
    path = scratch_path(spark, "csv")
    o = table(spark, sf, "orders")
    line = F.when(F.col("o_orderkey") % 50 == 0, "broken,row,with,too,many").otherwise(
        F.concat_ws(",", F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string"), "o_orderpriority"))
    o.select(line.alias("value")).write.text(path)
    c = I.read_csv_text(spark, path, ["key", "price", "severity"], header=False)
    return c.select(F.col("key").try_cast("bigint").alias("crash_id"), F.round(F.col("price").try_cast("double"), 2).alias("price"), "severity")


@query("src_03_geoparquet_metric", cte("crashes") + "SELECT crash_id, 1 AS n_points, true AS in_zone FROM crashes WHERE latitude < -30 AND longitude BETWEEN 144 AND 150")
def src_03(spark, sf):
    path = scratch_path(spark, "geoparquet")
    c = layer(spark, sf, "crashes").filter("latitude < -30 AND longitude BETWEEN 144 AND 150")
    pts = c.select("crash_id", F.array(F.struct(F.col("longitude").alias("x"), F.col("latitude").alias("y"))).alias("coords"))
    K.write_geo_parquet(pts, path, "coords", POINT)
    m = I.read_geo_parquet(spark, path, metric=True)
    p = F.col("coords")[0]
    return m.select("crash_id", F.size("coords").alias("n_points"), (p["x"].between(150000, 850000) & p["y"].between(5600000, 6300000)).alias("in_zone"))


@query("snk_01_geoparquet_round_trip", cte("segments") + "SELECT segment_id, 4 AS corners, round(minx,4) AS minx, round(maxy,4) AS maxy FROM segments")
def snk_01(spark, sf):
    path = scratch_path(spark, "rings")
    K.write_geo_parquet(segment_shapes(spark, sf).select("segment_id", "ring"), path, "ring", POLYGON)
    r = I.read_geo_parquet(spark, path)
    b = geo.coord_bounds(F.col("coords"))
    return r.select("segment_id", F.size("coords").alias("corners"), F.round(b["minx"], 4).alias("minx"), F.round(b["maxy"], 4).alias("maxy"))


def _outlines(spark, sf):
    """Segments as a box with a hole (two of three) or as two boxes side by side."""
    w, h = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")

    def box(x1, y1, x2, y2):
        return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))])

    x, y = F.col("minx"), F.col("miny")
    outline, hole = box(x, y, F.col("maxx"), F.col("maxy")), box(x + w / 4, y + h / 4, x + w / 2, y + h / 2)
    left, right = box(x, y, x + w / 4, F.col("maxy")), box(x + w / 2, y, F.col("maxx"), F.col("maxy"))
    split = F.col("segment_id") % 3 == 0
    parts = F.when(split, F.array(F.array(left), F.array(right))).otherwise(F.array(F.array(outline, hole)))
    return layer(spark, sf, "segments").select("segment_id", parts.alias("parts"), F.when(split, MULTIPOLYGON).otherwise(POLYGON).alias("kind"))


_BOX = "(maxx-minx)*(maxy-miny)"


@query("snk_01_geoparquet_parts", cte("segments") + f"""SELECT segment_id, CASE WHEN segment_id%3=0 THEN 2 ELSE 1 END AS n_parts, CASE WHEN segment_id%3=0 THEN 1 ELSE 2 END AS n_rings,
 round({_BOX}*CASE WHEN segment_id%3=0 THEN 0.75 ELSE 0.9375 END,6) AS area, segment_id%3=0 AS has_point_of_hole FROM segments""")
def snk_01_parts(spark, sf):
    """Holes and several parts survive the bytes: counts, area, and a point in the hole or in the second part."""
    path = scratch_path(spark, "parts")
    K.write_geo_parts(_outlines(spark, sf), path, "parts", F.col("kind"))
    g = I.read_geo_parts(spark, path).join(layer(spark, sf, "segments").select("segment_id", "minx", "miny", "maxx", "maxy"), "segment_id")
    # a spot in the hole of the first kind, in the right-hand box of the second
    x, y = F.when(F.col("segment_id") % 3 == 0, 0.75).otherwise(0.375), F.lit(0.375)
    inside = geo.in_parts(F.col("parts"), F.col("minx") + (F.col("maxx") - F.col("minx")) * x, F.col("miny") + (F.col("maxy") - F.col("miny")) * y)
    return g.select("segment_id", F.size("parts").alias("n_parts"), F.size(F.col("parts")[0]).alias("n_rings"), F.round(geo.parts_area(F.col("parts")), 6).alias("area"), inside.alias("has_point_of_hole"))


@query("agg_15_dissolved_outlines", cte("segments") + f"""SELECT suburb, count(*) AS members, sum(CASE WHEN segment_id%3=0 THEN 2 ELSE 1 END)::BIGINT AS n_parts, round(sum({_BOX}*CASE WHEN segment_id%3=0 THEN 0.75 ELSE 0.9375 END),5) AS area, min(ward) AS ward,
 round(min(minx),4) AS west, round(max(maxy),4) AS north FROM segments WHERE suburb IS NOT NULL GROUP BY 1""")
def agg_15_outlines(spark, sf):
    """Outlines of a suburb's segments gathered into geometries of several parts, written as WKB and read again."""
    path = scratch_path(spark, "areas")
    own = _outlines(spark, sf).join(layer(spark, sf, "segments").select("segment_id", "suburb", "ward"), "segment_id")
    K.write_geo_parts(A.dissolved(own, "suburb", "parts", "segment_id", [F.min("ward").alias("ward")], per_piece=100), path, "parts", F.lit(MULTIPOLYGON))
    g = I.read_geo_parts(spark, path).withColumns(geo.parts_bounds(F.col("parts")))
    return g.groupBy("suburb").agg(F.sum("n").alias("members"), F.sum(F.size("parts")).alias("n_parts"), F.round(F.sum(geo.parts_area(F.col("parts"))), 5).alias("area"), F.min("ward").alias("ward"),
                                   F.round(F.min("minx"), 4).alias("west"), F.round(F.max("maxy"), 4).alias("north"))


@query("prj_14_geometry_parts", cte("segments") + f"""SELECT segment_id, 0 AS part_no, round({_BOX}*0.9375,6) AS area FROM segments WHERE segment_id%3<>0
 UNION ALL SELECT segment_id, 0, round({_BOX}*0.25,6) FROM segments WHERE segment_id%3=0 UNION ALL SELECT segment_id, 1, round({_BOX}*0.5,6) FROM segments WHERE segment_id%3=0""")
def prj_14_parts(spark, sf):
    """One row per part of a geometry, with its holes."""
    p = _outlines(spark, sf).select("segment_id", F.posexplode("parts").alias("part_no", "part"))
    return p.select("segment_id", "part_no", F.round(geo.parts_area(F.array("part")), 6).alias("area"))


@query("src_04_parquet_in_sql", "SELECT p_partkey, CASE WHEN p_type IN ('LARGE','PROMO') THEN 'shared_use' ELSE 'footpath' END AS path_class FROM part")
def src_04(spark, sf):
    return spark.sql("SELECT p_partkey, CASE WHEN p_type IN ('LARGE','PROMO') THEN 'shared_use' ELSE 'footpath' END AS path_class FROM {part}", part=table(spark, sf, "part"))


def _osm(spark, sf):
    z = layer(spark, sf, "speed_zones")
    k = F.col("zone_id")
    pts = F.array(F.struct(F.col("x1").alias("lon"), F.col("y1").alias("lat")), F.struct(F.col("x2").alias("lon"), F.col("y2").alias("lat")))
    tags = F.create_map(F.lit("highway"), F.when(k % 2 == 0, "footway").otherwise("path"), F.lit("name"), F.concat(F.lit("way "), k.cast("string")))
    way = F.struct(F.lit("way").alias("type"), k.alias("id"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"), tags.alias("tags"),
                   F.when(k % 10 == 0, F.slice(pts, 1, 1)).otherwise(pts).alias("geometry"))
    none = F.lit(None).cast("array<struct<lon:double,lat:double>>")
    node = F.struct(F.lit("node").alias("type"), (k % 700).alias("id"), F.when(k % 7 == 0, None).otherwise((k % 700).cast("double")).alias("lon"), ((k % 700) / 2).alias("lat"),
                    F.create_map(F.lit("crossing"), F.lit("unmarked"), F.lit("highway"), F.lit("crossing")).alias("tags"), none.alias("geometry"))
    path = scratch_path(spark, "osm")
    I.land_documents(_indented(z.select((k % 32).alias("part"), F.explode(F.array(way, node)).alias("e")), "elements"), "value", path)
    return path


def _indented(rows, name):
    """Documents of many elements with a line break after every comma and brace, as files from a service come."""
    docs = rows.groupBy("part").agg(F.collect_list("e").alias(name)).select(F.to_json(F.struct(name)).alias("doc"))
    return docs.select(F.regexp_replace("doc", r'(\{|,)(?=")', "$1\n  ").alias("value"))


@query("src_05_osm_ways", cte("speed_zones") + "SELECT zone_id AS osm_id, CASE WHEN zone_id%2=0 THEN 'footway' ELSE 'path' END AS highway, 'way '||zone_id AS name, 2 AS n_points, round(x2,3) AS x_end FROM speed_zones WHERE zone_id%10<>0")
def src_05(spark, sf):
    w = I.read_osm_ways(spark, _osm(spark, sf))
    return w.select("osm_id", "highway", "name", F.size("line").alias("n_points"), F.round(F.col("line")[1]["x"], 3).alias("x_end"))


@query("src_06_osm_crossings", cte("speed_zones") + "SELECT DISTINCT zone_id%700 AS osm_id, CAST(zone_id%700 AS DOUBLE) AS lon, (zone_id%700)/2 AS lat, 'unmarked' AS crossing FROM speed_zones WHERE zone_id%7<>0")
def src_06(spark, sf):
    return I.read_osm_crossings(spark, _osm(spark, sf))


@query("src_07_od_pairs", "SELECT 'OD-'||c_custkey AS id, c_name AS label, c_custkey%2=0 AS verified, CAST(c_custkey AS DOUBLE) AS olng, c_custkey/4 AS olat, c_acctbal AS dlng, CAST(c_nationkey AS DOUBLE) AS dlat FROM customer")
def src_07(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")

    def place(name, *xy):
        return F.struct(F.lit(name).alias("name"), F.array(*[v.cast("double") for v in xy]).alias("center"))

    pair = F.struct(F.concat(F.lit("OD-"), k.cast("string")).alias("id"), F.col("c_name").alias("label"), (k % 2 == 0).alias("verified"),
                    place("a", k, k / 4).alias("origin"), place("b", F.col("c_acctbal"), F.col("c_nationkey")).alias("destination"))
    path = scratch_path(spark, "od")
    I.land_documents(_indented(c.select((k % 16).alias("part"), pair.alias("e")), "pairs"), "value", path)
    return I.read_od_pairs(spark, path)


@query("src_08_newest_file_wins", "SELECT o_orderkey AS od_id, CASE WHEN o_orderkey%3=0 THEN 'second' ELSE 'first' END AS run, o_totalprice AS v FROM orders")
def src_08(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("od_id"), F.col("o_totalprice").alias("v"))
    a, b = scratch_path(spark, "run1"), scratch_path(spark, "run2")
    o.withColumn("run", F.lit("first")).write.json(a)
    o.filter("od_id % 3 = 0").withColumn("run", F.lit("second")).write.json(b)
    return I.newest_rows(spark, [a, b], "od_id bigint, run string, v double", ["od_id"])


@query("src_09_paged_until_short", """WITH p AS (SELECT o_orderkey AS id, o_totalprice AS v, o_orderkey//500 AS page FROM orders WHERE o_orderkey<>1499),
 n AS (SELECT page, count(*) AS n, max(page) OVER () AS last FROM p GROUP BY page)
SELECT id, v, n < 500 AND page < last AS short_page FROM p JOIN n USING (page)""")
def src_09(spark, sf):
    """One page misses a row: its rows are kept and flagged, and so are all that follow."""
    path = scratch_path(spark, "pages")
    o = table(spark, sf, "orders").filter("o_orderkey <> 1499").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"), F.floor(F.col("o_orderkey") / 500).cast("int").alias("page"))
    o.write.json(path)
    return I.read_pages(spark, path, "id bigint, v double", 500).select("id", "v", "short_page")


@query("src_10_result_csv", "SELECT 'OD-'||o_custkey AS od_id, CASE WHEN o_orderkey%2=0 THEN 'control' ELSE 'challenger' END AS engine, max(round(o_totalprice/50000,3)) AS day_display FROM orders GROUP BY 1,2")
def src_10(spark, sf):
    path = scratch_path(spark, "results")
    o = table(spark, sf, "orders")
    rows = o.select(F.concat(F.lit("OD-"), F.col("o_custkey").cast("string")).alias("od_id"), F.when(F.col("o_orderkey") % 2 == 0, "control").otherwise("challenger").alias("engine"), F.round(F.col("o_totalprice") / 50000, 3).alias("day_display"))
    rows.write.option("header", True).csv(path)
    c = I.read_csv_text(spark, path, ["od_id", "engine", "day_display"])
    return c.groupBy("od_id", "engine").agg(F.max(F.col("day_display").try_cast("double")).alias("day_display"))


@query("snk_04_csv_union_header", "SELECT 'a' AS kind, c_custkey AS k, c_acctbal AS score, CAST(NULL AS VARCHAR) AS note FROM customer UNION ALL SELECT 'b', s_suppkey, NULL, s_name FROM supplier")
def snk_04(spark, sf):
    path = scratch_path(spark, "union")
    a = table(spark, sf, "customer").select(F.lit("a").alias("kind"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("score"))
    b = table(spark, sf, "supplier").select(F.lit("b").alias("kind"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("note"))
    K.write_union_csv([a, b], path)
    return spark.read.schema("k bigint, kind string, note string, score double").option("header", True).csv(path)


@query("snk_06_load_check", "SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus='F') AS n_eligible, min(o_orderpriority) AS min_version, max(o_orderpriority) AS max_version, CAST(max(o_orderdate) AS DATE) AS last_loaded FROM orders")
def snk_06(spark, sf):
    path = scratch_path(spark, "loaded")
    table(spark, sf, "orders").select((F.col("o_orderstatus") == "F").alias("ok"), "o_orderpriority", F.to_date("o_orderdate").alias("d")).write.parquet(path)
    return K.load_check(spark.read.parquet(path), "ok", "o_orderpriority", "d")


@query("snk_07_report_json", cte("segments") + "SELECT count(*) AS segment_count, count(*) FILTER (WHERE width_m IS NULL) AS missing_width, count(*) FILTER (WHERE walk_path_class='shared_use') AS shared_use FROM segments")
def snk_07(spark, sf):
    path = scratch_path(spark, "report")
    s = layer(spark, sf, "segments")
    K.write_report(s.agg(F.count(F.lit(1)).alias("segment_count"), F.count_if(Q.width_flag() == "missing").alias("missing_width"), F.count_if(F.col("walk_path_class") == "shared_use").alias("shared_use")), path)
    return spark.read.schema("segment_count bigint, missing_width bigint, shared_use bigint").json(path)


@query("snk_08_layer_manifest", cte("segments", "lights", "fountains") + """SELECT 'segments' AS layer, count(*) AS features, round(min(length_m),3) AS min, round(max(length_m),3) AS max, round(quantile_cont(length_m,0.5),3) AS median FROM segments
UNION ALL SELECT 'lights', count(*), min(wattage_w), max(wattage_w), round(quantile_cont(wattage_w,0.5),3) FROM lights UNION ALL SELECT 'fountains', count(*), min(gisfid), max(gisfid), quantile_cont(gisfid,0.5) FROM fountains""")
def snk_08(spark, sf):
    out = None
    for name, c in (("segments", "length_m"), ("lights", "wattage_w"), ("fountains", "gisfid")):
        v = layer(spark, sf, name).select(F.lit(name).alias("layer"), F.col(c).cast("double").alias("v"))
        out = v if out is None else out.unionByName(v)
    path = scratch_path(spark, "manifest")
    s = A.score_summary(out, "v", ["layer"])
    s.select("layer", F.col("n").alias("features"), F.round("min", 3).alias("min"), F.round("max", 3).alias("max"), F.round("median", 3).alias("median")).write.json(path)
    return spark.read.schema("layer string, features bigint, min double, max double, median double").json(path)


# --- event streams -----------------------------------------------------------


@query("st_01_usage_sessions", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts) AS start_at, max(ts) AS last_at, count(*) AS n_events, count(*) FILTER (WHERE event_type='purchase') AS n_done FROM s GROUP BY user_id, k""")
def st_01(spark, sf):
    s = T.usage_sessions(T.with_event_time(table(spark, sf, "events")))
    return s.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_at", "last_at")})


@query("st_02_outcome_rates_stream", """SELECT date_trunc('hour', ts) AS start_at, count(*) AS n, count(*) FILTER (WHERE event_type='error') AS n_failed, round(sum(value),4) AS sum_value, max(value) AS max_value FROM events GROUP BY 1""")
def st_02(spark, sf):
    """A real streaming run: watermark, hourly windows, update mode, replay-safe output."""
    ev = T.open_stream(spark, sf).withWatermark("at", "2 hours")
    out = T.run_updates(T.outcome_rates(ev, F.col("event_type") == "error"), ["start_at"], "rates")
    return out.select(F.col("start_at").cast("timestamp_ntz").alias("start_at"), "n", "n_failed", F.round("sum_value", 4).alias("sum_value"), "max_value")


_GROWTH = "ln(1.01e0/0.99e0)"
_BUCKET = f"CASE WHEN value>0 THEN CAST(ceil(ln(value)/{_GROWTH}) AS INTEGER) ELSE {T.LOWEST} END"


@query("st_02_timing_quantiles_stream", f"""WITH b AS (SELECT date_trunc('hour', ts) AS start_at, {_BUCKET} AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1,2),
 c AS (SELECT *, sum(n) OVER (PARTITION BY start_at ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY start_at) AS total, CASE WHEN bucket={T.LOWEST} THEN 0 ELSE exp(bucket*{_GROWTH})*0.99e0 END AS mid FROM b)
SELECT start_at, max(total)::BIGINT AS n, round(min(CASE WHEN upto>floor(0.5e0*(total-1)) THEN mid END),6) AS p50, round(min(CASE WHEN upto>floor(0.95e0*(total-1)) THEN mid END),6) AS p95 FROM c GROUP BY 1""")
def st_02_timing(spark, sf):
    """A streaming run whose state is a mergeable sketch per hour: median and 95th percentile of a timing."""
    ev = T.open_stream(spark, sf).withWatermark("at", "2 hours")
    counts = T.run_updates(T.timing_counts(ev), ["start_at", "bucket"], "timing")
    out = T.timing_quantiles(counts, {"p50": 0.5, "p95": 0.95})
    return out.select(F.col("start_at").cast("timestamp_ntz").alias("start_at"), "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95")])


@query("px_01_choice_win_rates", """SELECT l_returnflag AS scenario, 'discount' AS attribute, CAST(floor(l_discount*100) AS BIGINT) AS level, round(avg((l_linestatus='F')::INT),6) AS win_rate, count(*) AS n FROM lineitem GROUP BY 1,2,3
UNION ALL SELECT l_returnflag, 'quantity', CAST(floor(l_quantity/10) AS BIGINT), round(avg((l_linestatus='F')::INT),6), count(*) FROM lineitem GROUP BY 1,2,3""")
def px_01(spark, sf):
    li = table(spark, sf, "lineitem")
    levels = F.explode(F.array(F.struct(F.lit("discount").alias("attribute"), F.floor(F.col("l_discount") * 100).alias("level")), F.struct(F.lit("quantity").alias("attribute"), F.floor(F.col("l_quantity") / 10).alias("level"))))
    x = li.select(F.col("l_returnflag").alias("scenario"), (F.col("l_linestatus") == "F").cast("int").alias("won"), levels.alias("a"))
    return x.groupBy("scenario", "a.attribute", "a.level").agg(F.round(F.avg("won"), 6).alias("win_rate"), F.count(F.lit(1)).alias("n"))
