"""Graph tables and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import aggregates as A
from ..operators import graph as G
from ..operators import grid
from ..operators import kernels as K
from ..operators import layers as L
from ..operators import lines as N
from ..operators import ordering as O
from .bindings import cte, layer, segment_shapes, table
from .join_queries import RECT_PIECE, line_pairs_sql
from .line_queries import _VOTES, _votes
from .registry import query
from .route_fixtures import CARDS_CTE, ROUTES_CTE, cards, routes

EDGES = """SELECT o_orderkey AS edge_id, o_custkey AS u, o_custkey+1+(o_orderkey%7) AS v, CAST(50+(o_orderkey*37)%400 AS DOUBLE) AS length_m,
 CASE o_orderkey%9 WHEN 0 THEN 'footway' WHEN 1 THEN ' Path;Track' WHEN 2 THEN 'residential' WHEN 3 THEN 'service' WHEN 4 THEN 'primary' WHEN 5 THEN 'crossing' WHEN 6 THEN NULL WHEN 7 THEN 'busway' ELSE 'sidewalk' END AS highway,
 CASE WHEN o_orderkey%11=0 THEN NULL ELSE o_totalprice/5000 END AS day_index_score, CASE WHEN o_orderkey%13=0 THEN NULL ELSE (o_totalprice%70000)/700 END AS accessibility_score,
 CASE WHEN o_orderkey%5=0 THEN NULL ELSE (o_totalprice%90000)/900 END AS heat_shade_score, CASE WHEN o_orderkey%4=0 THEN NULL ELSE (o_totalprice%50000)/500 END AS lighting_score,
 CASE WHEN o_orderkey%3=0 THEN NULL ELSE (o_totalprice%80000)/800 END AS night_index_score FROM {orders}"""
EDGES_CTE = "edges AS (" + EDGES.replace("{orders}", "orders") + ")"


def edges(spark, sf):
    return spark.sql(EDGES, orders=table(spark, sf, "orders"))


_HW = "coalesce(nullif(lower(trim(string_split(highway,';')[1])),''),'unknown')"
_PATHS = "('footway','path','pedestrian','steps','corridor','bridleway','track','cycleway','crossing','sidewalk')"
_MULT = f"CASE WHEN {_HW} IN {_PATHS} THEN 1e0 WHEN {_HW} IN ('service','living_street') THEN 1.25e0 WHEN {_HW}='residential' THEN 1.75e0 WHEN {_HW}='primary' THEN 2e0 ELSE 1.6e0 END"
_AWAY = f"CASE WHEN {_HW} IN ('path','track') THEN 0.75e0 WHEN {_HW}='crossing' THEN 0.85e0 WHEN {_HW} IN ('footway','sidewalk') THEN 1.45e0 WHEN {_HW}='service' THEN 1.5e0 WHEN {_HW}='residential' THEN 2.5e0 WHEN {_HW}='primary' THEN 3e0 ELSE 2.4e0 END"
_PCT = "pq AS (SELECT quantile_cont(day_index_score,0.1) AS d1, quantile_cont(day_index_score,0.9) AS d9, quantile_cont(accessibility_score,0.1) AS a1, quantile_cont(accessibility_score,0.9) AS a9, quantile_cont(heat_shade_score,0.1) AS h1, quantile_cont(heat_shade_score,0.9) AS h9, quantile_cont(lighting_score,0.1) AS l1, quantile_cont(lighting_score,0.9) AS l9 FROM edges)"


def _norm(s, lo, hi):
    return f"(CASE WHEN {s} IS NULL THEN 0.5e0 ELSE greatest(0e0,least(1e0,({s}-{lo})/greatest(1e-6,{hi}-{lo}))) END)"


def percentiles(e, columns):
    """p10 and p90 of several streams as one row, from one distributed pass."""
    long = e.select(F.explode(F.create_map(*[x for k, c in columns.items() for x in (F.lit(k), F.col(c))])).alias("k_", "v_"))
    q = O.exact_quantiles(long, "v_", {"lo": 0.1, "hi": 0.9}, ["k_"])
    return q.agg(*[F.max(F.when(F.col("k_") == k, F.col(s))).alias(f"{k}{n}") for k in columns for s, n in (("lo", 1), ("hi", 9))])


_STREAMS = {"d": "day_index_score", "a": "accessibility_score", "h": "heat_shade_score", "l": "lighting_score"}


def with_percentiles(e):
    """The one-row percentile frame as a scalar struct on every edge."""
    p = percentiles(e, _STREAMS)
    return e.withColumn("pq", p.select(F.struct(*p.columns)).scalar())


@query("gr_01_undirected_edges", f"""WITH {EDGES_CTE}, m AS (SELECT edge_id, least(u,v) AS a, greatest(u,v) AS b, length_m*({_MULT}) AS cost FROM edges WHERE u<>v)
SELECT CAST(a AS VARCHAR) AS u, CAST(b AS VARCHAR) AS v, edge_id, round(cost,6) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY a,b ORDER BY cost, edge_id) AS rn FROM m) WHERE rn=1""")
def gr_01(spark, sf):
    e = edges(spark, sf).select("edge_id", "u", "v", (F.col("length_m") * G.class_multiplier("highway")).alias("cost")).filter("u <> v")
    k = e.withColumns({"a": F.least("u", "v"), "b": F.greatest("u", "v")})
    m = k.groupBy("a", "b").agg(F.min_by(F.struct("edge_id", "cost"), F.struct("cost", "edge_id")).alias("e"))
    return m.select(F.col("a").cast("string").alias("u"), F.col("b").cast("string").alias("v"), "e.edge_id", F.round("e.cost", 6).alias("cost"))


@query("gr_01_edges_from_lines", f"""WITH {ROUTES_CTE}, k AS (SELECT route_id, i, CAST(round(x1/200) AS BIGINT)||'_'||CAST(round(y1/200) AS BIGINT) AS a, CAST(round(x2/200) AS BIGINT)||'_'||CAST(round(y2/200) AS BIGINT) AS b, greatest(1,sqrt(power(x2-x1,2)+power(y2-y1,2))) AS len FROM pc),
 m AS (SELECT least(a,b) AS u, greatest(a,b) AS v, route_id, i, len FROM k WHERE a<>b)
SELECT u, v, route_id, CAST(i AS INTEGER) AS i, round(len,6) AS length_m FROM (SELECT *, row_number() OVER (PARTITION BY u,v ORDER BY round(len,6), route_id, i) AS rn FROM m) WHERE rn=1""")
def gr_01b(spark, sf):
    """Vertices rounded to nodes, consecutive vertices to edges, cheapest parallel edge kept."""
    p = N.pieces(routes(spark, sf), ["route_id"])
    length = F.round(F.greatest(F.lit(1.0), geo.span(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))), 6)
    p = p.select("route_id", "i", length.alias("len"), *[F.round(F.col(c) / 200).cast("bigint").alias(c) for c in ("x1", "y1", "x2", "y2")])
    e = G.undirected_edges(p, F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), "len", 0, ["route_id", "i"])
    return e.select("u", "v", "route_id", "i", F.col("len").alias("length_m"))


@query("gr_02_normalised_scores", f"WITH {EDGES_CTE}, {_PCT} SELECT edge_id, round({_norm('day_index_score','d1','d9')},8) AS day_norm, round({_norm('lighting_score','l1','l9')},8) AS light_norm FROM edges, pq")
def gr_02(spark, sf):
    e = with_percentiles(edges(spark, sf))
    return e.select("edge_id", F.round(G.norm_score("day_index_score", F.col("pq.d1"), F.col("pq.d9")), 8).alias("day_norm"),
                    F.round(G.norm_score("lighting_score", F.col("pq.l1"), F.col("pq.l9")), 8).alias("light_norm"))


@query("gr_03_class_multiplier", f"WITH {EDGES_CTE} SELECT edge_id, {_MULT} AS normal, {_AWAY} AS away FROM edges")
def gr_03(spark, sf):
    return edges(spark, sf).select("edge_id", G.class_multiplier("highway").alias("normal"), G.class_multiplier("highway", True).alias("away"))


@query("gr_04_edge_cost", f"WITH {EDGES_CTE}, {_PCT} SELECT edge_id, round(greatest(1,length_m)*(1+(0.5-{_norm('day_index_score','d1','d9')}))*({_MULT}),6) AS cost_day FROM edges, pq")
def gr_04(spark, sf):
    e = with_percentiles(edges(spark, sf))
    return e.select("edge_id", F.round(G.edge_cost("length_m", "day_index_score", F.col("pq.d1"), F.col("pq.d9"), "highway"), 6).alias("cost_day"))


_LT = "coalesce(lighting_score,night_index_score)"


def _pref_sql(swing):
    day = f"CASE WHEN accessibility_score IS NULL AND heat_shade_score IS NULL THEN 0.5e0 ELSE (CASE WHEN accessibility_score IS NULL THEN 0 ELSE {_norm('accessibility_score','a1','a9')}*wa END+CASE WHEN heat_shade_score IS NULL THEN 0 ELSE {_norm('heat_shade_score','h1','h9')}*ws END)/(CASE WHEN accessibility_score IS NULL THEN 0 ELSE wa END+CASE WHEN heat_shade_score IS NULL THEN 0 ELSE ws END) END"
    night = day.replace("heat_shade_score", _LT).replace("h1", "l1").replace("h9", "l9").replace("ws", "wd")
    return f"greatest(1,length_m)*(1+{swing}*(0.5-CASE WHEN md='day' THEN {day} ELSE {night} END))*CASE WHEN aw THEN {_AWAY} ELSE {_MULT} END"


_PREFS = """pf AS (SELECT n_nationkey AS user_id, CASE WHEN n_nationkey%2=0 THEN 'day' ELSE 'night' END AS md, n_nationkey%3=0 AS aw, CAST(greatest(10,least(100,n_nationkey*9)) AS DOUBLE) AS wa, CAST(greatest(10,least(100,120-n_nationkey*7)) AS DOUBLE) AS ws, CAST(greatest(10,least(100,n_nationkey*5+3)) AS DOUBLE) AS wd FROM nation)"""


def preference_rows(spark, sf):
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        k.alias("user_id"), F.when(k % 2 == 0, "day").otherwise("night").alias("md"), (k % 3 == 0).alias("aw"),
        G.importance(k * 9).alias("wa"), G.importance(120 - k * 7).alias("ws"), G.importance(k * 5 + 3).alias("wd"))


def _pref_query(spark, sf, swing):
    """Each edge under the weights of the residents of its zone: an equi-join on the zone."""
    prefs = preference_rows(spark, sf).select("user_id", F.struct("user_id", "md", "aw", "wa", "ws", "wd").alias("p"))
    e = with_percentiles(edges(spark, sf)).withColumn("user_id", (F.col("u") % 25).cast("int")).join(prefs, "user_id")
    light = F.coalesce("lighting_score", "night_index_score")
    night = F.col("p.md") == "night"
    acc = (F.col("accessibility_score"), F.col("pq.a1"), F.col("pq.a9"), F.col("p.wa"))
    day = G.preference_cost("length_m", "highway", [acc, (F.col("heat_shade_score"), F.col("pq.h1"), F.col("pq.h9"), F.col("p.ws"))], F.col("p.aw"), swing)
    dark = G.preference_cost("length_m", "highway", [acc, (light, F.col("pq.l1"), F.col("pq.l9"), F.col("p.wd"))], F.col("p.aw"), swing)
    return e.select("edge_id", F.col("p.user_id").alias("user_id"), F.round(F.when(night, dark).otherwise(day), 6).alias("cost"))


@query("gr_05_preference_cost", f"WITH {EDGES_CTE}, {_PCT}, {_PREFS} SELECT edge_id, user_id, round({_pref_sql('1e0')},6) AS cost FROM edges JOIN pf ON user_id=u%25, pq")
def gr_05(spark, sf):
    return _pref_query(spark, sf, 1.0)


@query("gr_05_loop_preference_cost", f"WITH {EDGES_CTE}, {_PCT}, {_PREFS} SELECT edge_id, user_id, round({_pref_sql('0.5e0')},6) AS cost FROM edges JOIN pf ON user_id=u%25, pq")
def gr_05b(spark, sf):
    return _pref_query(spark, sf, 0.5)


def _imp(c):
    return f"greatest(10,least(100,{c}))"


@query("gr_06_contrast_preferences", f"""WITH {CARDS_CTE}, p AS (SELECT DISTINCT od_id, walk_mode, {_imp('pref_acc')} AS a, CASE WHEN walk_mode='night' THEN {_imp('pref_dark')} ELSE {_imp('pref_shade')} END AS s FROM cards)
SELECT od_id, CASE WHEN s>=a THEN 100e0 ELSE 10e0 END AS alt_accessibility, CASE WHEN walk_mode='night' THEN 0e0 WHEN s>=a THEN 10e0 ELSE 100e0 END AS alt_shade, CASE WHEN walk_mode<>'night' THEN 0e0 WHEN s>=a THEN 10e0 ELSE 100e0 END AS alt_dark,
 CASE WHEN s>=a THEN 'accessibility' WHEN walk_mode='night' THEN 'afterDark' ELSE 'shadeHeat' END AS alt_stream FROM p""")
def gr_06(spark, sf):
    c = cards(spark, sf).select("od_id", "walk_mode", "pref_acc", "pref_shade", "pref_dark").distinct()
    return c.select("od_id", *[v.alias(k) for k, v in G.contrast_preferences("walk_mode", "pref_acc", "pref_shade", "pref_dark").items()])


_ROADS = "CASE route_id%5 WHEN 0 THEN 'residential' WHEN 1 THEN 'Tertiary' WHEN 2 THEN 'footway' ELSE 'primary_link' END"


@query("gr_07_sidewalk_conversion", f"""WITH {_VOTES}, r AS (SELECT *, lower({_ROADS}) AS hw FROM v WHERE {_ROADS}<>'footway'), sh AS (SELECT route_id, min(CASE WHEN side IS NOT NULL THEN i END) AS lo, max(CASE WHEN side IS NOT NULL THEN i END) AS hi FROM r GROUP BY 1),
 w AS (SELECT route_id, street, sum(side*len) AS vote, sum(CASE WHEN side IS NOT NULL THEN len END) AS m FROM r GROUP BY 1,2), s AS (SELECT street, sum(vote) AS sv FROM w GROUP BY 1),
 u AS (SELECT route_id, CASE WHEN abs(vote)<0.6*m AND sv<>0 THEN CASE WHEN sv>=0 THEN 1 ELSE -1 END WHEN vote>=0 THEN 1 ELSE -1 END AS use_ FROM w JOIN s USING (street) WHERE vote IS NOT NULL)
SELECT route_id, CAST(i AS INTEGER) AS i, hw AS sidewalk_of, round(x1-(y2-y1)/len*use_*4.5,4) AS x1, round(y1+(x2-x1)/len*use_*4.5,4) AS y1 FROM r JOIN sh USING (route_id) JOIN u USING (route_id) WHERE i BETWEEN lo AND hi""")
def gr_07(spark, sf):
    k = F.col("route_id") % 5
    hw = F.when(k == 0, "residential").when(k == 1, "Tertiary").when(k == 2, "footway").otherwise("primary_link")
    s = G.sidewalk_edges(_votes(spark, sf).withColumn("highway", hw), "route_id", "street")
    return s.select("route_id", "i", "sidewalk_of", F.round("x1", 4).alias("x1"), F.round("y1", 4).alias("y1"))


@query("gr_09_node_table", f"""WITH {EDGES_CTE}, {_PCT}, b AS (SELECT u, v, greatest(1,length_m) AS w, {_HW} AS hw, CASE WHEN accessibility_score IS NOT NULL THEN {_norm('accessibility_score','a1','a9')} END AS b FROM edges, pq),
 d AS (SELECT u AS node, w, hw, b FROM b UNION ALL SELECT v, w, hw, b FROM b)
SELECT node, count(*) AS degree, bool_or(hw IN {_PATHS} AND hw<>'crossing') AS on_paths, round(sum(b*w)/sum(w) FILTER (WHERE b IS NOT NULL),7) AS blend FROM d GROUP BY 1""")
def gr_09(spark, sf):
    e = with_percentiles(edges(spark, sf))
    b = F.when(F.col("accessibility_score").isNotNull(), G.norm_score("accessibility_score", F.col("pq.a1"), F.col("pq.a9")))
    e = e.select("u", "v", "length_m", "highway", b.alias("b"))
    return G.node_table(e, F.col("b")).withColumn("blend", F.round("blend", 7))


def path_requests(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("od_id"), (k * 13 % 1000).alias("src"), (k * 13 % 1000 + 20 + k % 30).alias("dst"))


_ARCS = EDGES_CTE.replace("{orders}", "orders") + """, arcs AS MATERIALIZED (SELECT u, v, min(length_m) AS cost FROM (SELECT u, v, length_m FROM edges UNION ALL SELECT v, u, length_m FROM edges) GROUP BY 1,2),
 req AS (SELECT s_suppkey AS od_id, s_suppkey*13%1000 AS src, s_suppkey*13%1000+20+s_suppkey%30 AS dst FROM supplier)"""


@query("gr_10_batch_shortest_paths", f"""WITH RECURSIVE {_ARCS},
 lab(od_id, node, g) USING KEY (od_id, node) AS (SELECT od_id, src, 0e0 FROM req UNION
  SELECT n.od_id, n.node, n.g FROM (SELECT l.od_id, a.v AS node, min(l.g+a.cost) AS g FROM lab l JOIN arcs a ON l.node=a.u GROUP BY 1,2) n
   LEFT JOIN recurring.lab o ON o.od_id=n.od_id AND o.node=n.node WHERE o.g IS NULL OR n.g<o.g)
SELECT req.od_id, src, dst, round(g,4) AS cost FROM req LEFT JOIN lab ON lab.od_id=req.od_id AND lab.node=req.dst""")
def gr_10(spark, sf):
    """Cheapest cost of every request; a goal that no path reaches has none."""
    e = edges(spark, sf).select("u", "v", F.col("length_m").alias("cost"))
    req = path_requests(spark, sf)
    lab = G.batch_paths(e, req)
    return req.join(lab.select("od_id", F.col("node").alias("dst"), F.round("g", 4).alias("cost")), ["od_id", "dst"], "left").select("od_id", "src", "dst", "cost")


_TRACED = EDGES_CTE.replace("{orders}", "orders") + f""", twoway AS (SELECT u, v, length_m, {_HW} AS hw, length_m+edge_id/1e7 AS cost FROM edges UNION ALL SELECT v, u, length_m, {_HW}, length_m+edge_id/1e7 FROM edges),
 arcs AS MATERIALIZED (SELECT u, v, min(cost) AS cost, arg_min(length_m, cost) AS length_m, arg_min(hw, cost) AS hw FROM twoway GROUP BY 1,2),
 req AS (SELECT s_suppkey AS od_id, s_suppkey*13%1000 AS src, s_suppkey*13%1000+20+s_suppkey%30 AS dst FROM supplier),
 lab(od_id, node, g, prev) USING KEY (od_id, node) AS (SELECT od_id, src, 0e0, NULL::BIGINT FROM req UNION
  SELECT n.od_id, n.node, n.g, n.prev FROM (SELECT l.od_id, a.v AS node, min(l.g+a.cost) AS g, arg_min(l.node, l.g+a.cost) AS prev FROM lab l JOIN arcs a ON l.node=a.u GROUP BY 1,2) n
   LEFT JOIN recurring.lab o ON o.od_id=n.od_id AND o.node=n.node WHERE o.g IS NULL OR n.g<o.g),
 walk(od_id, u, v) AS (SELECT lab.od_id, prev, node FROM lab JOIN req ON lab.od_id=req.od_id AND node=dst WHERE prev IS NOT NULL
  UNION ALL SELECT w.od_id, l.prev, l.node FROM walk w JOIN lab l ON l.od_id=w.od_id AND l.node=w.u WHERE l.prev IS NOT NULL)"""


@query("gr_11_traced_routes", f"""WITH RECURSIVE {_TRACED} SELECT od_id, round(sum(length_m),3) AS distance_m, round(sum(length_m)/1.3,3) AS duration_s, count(*) AS n_edges,
 round(sum(CASE WHEN hw IN {_PATHS} OR hw IN ('service','living_street') THEN length_m ELSE 0 END)/sum(length_m),6) AS pathish_share FROM walk JOIN arcs USING (u, v) GROUP BY 1""")
def gr_11_traced(spark, sf):
    """Routes from the edges of searched paths: search, walk back, measure. Costs carry a trace of the edge number, so the cheapest path is one."""
    cost = F.col("length_m") + F.col("edge_id") / 1e7
    e = G.both_ways(edges(spark, sf).select("u", "v", "length_m", G.road_class("highway").alias("hw"), cost.alias("cost")))
    arcs = e.groupBy("u", "v").agg(F.min_by(F.struct("length_m", "hw", "cost"), F.col("cost")).alias("e")).select("u", "v", "e.*")
    req = path_requests(spark, sf)
    hops = G.trace_paths(G.batch_paths(arcs.select("u", "v", "cost"), req), req)
    p = hops.join(arcs, ["u", "v"])
    total = F.sum("length_m")
    share = F.sum(F.when(F.col("hw").isin(*G.ROUTE_PATH_CLASSES), F.col("length_m")).otherwise(0.0)) / total
    return p.groupBy("od_id").agg(F.round(total, 3).alias("distance_m"), F.round(total / G.WALK_MPS, 3).alias("duration_s"), F.count(F.lit(1)).alias("n_edges"), F.round(share, 6).alias("pathish_share"))


_TRIP = f"""{EDGES_CTE}, path AS (SELECT edge_id, u%300 AS od_id, length_m, {_HW} AS hw FROM edges)"""


@query("gr_11_path_to_route", f"""WITH {_TRIP} SELECT od_id, round(sum(length_m),3) AS distance_m, round(sum(length_m)/1.3,3) AS duration_s, count(*) AS n_edges, round(sum(CASE WHEN hw IN {_PATHS} OR hw IN ('service','living_street') THEN length_m ELSE 0 END)/sum(length_m),6) AS pathish_share FROM path GROUP BY 1""")
def gr_11(spark, sf):
    p = edges(spark, sf).select((F.col("u") % 300).alias("od_id"), "length_m", G.road_class("highway").alias("hw"))
    total = F.sum("length_m")
    share = F.sum(F.when(F.col("hw").isin(*G.ROUTE_PATH_CLASSES), F.col("length_m")).otherwise(0.0)) / total
    return p.groupBy("od_id").agg(F.round(total, 3).alias("distance_m"), F.round(total / G.WALK_MPS, 3).alias("duration_s"), F.count(F.lit(1)).alias("n_edges"), F.round(share, 6).alias("pathish_share"))


@query("agg_19_class_metres_map", f"""WITH {_TRIP}, c AS (SELECT od_id, hw, sum(length_m) AS m FROM path GROUP BY 1,2) SELECT od_id, string_agg(hw||'='||CAST(CAST(m AS BIGINT) AS VARCHAR), ';' ORDER BY hw) AS classes, sum(m) AS total_m FROM c GROUP BY 1""")
def agg_19(spark, sf):
    p = edges(spark, sf).select((F.col("u") % 300).alias("od_id"), "length_m", G.road_class("highway").alias("hw"))
    m = A.share_map(p, ["od_id"], "hw", "length_m")
    text = F.array_join(F.transform(F.map_entries("metres_by_class"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("bigint").cast("string"))), ";")
    return m.select("od_id", text.alias("classes"), "total_m")


@query("gr_12_detour_policy", f"""WITH {CARDS_CTE}, s AS (SELECT od_id, min(distance_m) AS sh FROM cards GROUP BY 1), d AS (SELECT od_id, card, distance_m/greatest(sh,1) AS det, shared_use_ratio AS p, prefer_shared AS aw FROM cards JOIN s USING (od_id))
SELECT od_id, card, round(det,6) AS detour, CASE WHEN det<=CASE WHEN aw THEN 1.6 ELSE 1.15 END THEN 'score' WHEN p>=0.7 AND det<=1.2 AND NOT aw THEN 'score' ELSE 'fallback' END AS kept FROM d""")
def gr_12(spark, sf):
    c = O.group_min(cards(spark, sf), ["od_id"], [F.min("distance_m").alias("sh")])
    det = F.col("distance_m") / F.greatest(F.col("sh"), F.lit(1.0))
    cap = F.when(F.col("prefer_shared"), G.MAX_DETOUR_AWAY).otherwise(G.MAX_DETOUR)
    return c.select("od_id", "card", F.round(det, 6).alias("detour"), G.choose_route(det, F.col("shared_use_ratio"), cap, F.col("prefer_shared")).alias("kept"))


@query("gr_13_reuse_penalty", f"""WITH {EDGES_CTE}, used AS (SELECT DISTINCT least(u,v) AS a, greatest(u,v) AS b FROM edges WHERE edge_id%17=0) SELECT edge_id, CASE WHEN used.a IS NULL THEN length_m ELSE length_m*4 END AS cost FROM edges LEFT JOIN used ON a=least(u,v) AND b=greatest(u,v)""")
def gr_13(spark, sf):
    e = edges(spark, sf).withColumns({"a": F.least("u", "v"), "b": F.greatest("u", "v")})
    used = e.filter("edge_id % 17 = 0").select("a", "b").distinct().withColumn("used", F.lit(True))
    return e.join(used, ["a", "b"], "left").select("edge_id", F.when(F.col("used"), F.col("length_m") * 4).otherwise(F.col("length_m")).alias("cost"))


@query("jn_29_crossing_links", cte("lights", "benches") + f""", c AS (SELECT DISTINCT light_id, px, py FROM lights), n AS (SELECT b.gisfid AS node, b.px AS nx, b.py AS ny FROM benches b WHERE b.gisfid IN (SELECT u FROM ({EDGES.replace('{orders}','orders')}) WHERE {_HW} IN {_PATHS})),
 d AS (SELECT light_id, node, round(sqrt(power(px-nx,2)+power(py-ny,2)),6) AS d FROM c JOIN n ON nx BETWEEN px-22 AND px+22 AND ny BETWEEN py-22 AND py+22)
SELECT light_id, node, d AS metres FROM (SELECT *, row_number() OVER (PARTITION BY light_id ORDER BY d, node) AS rn FROM d WHERE d<=22) WHERE rn<=6""")
def jn_29(spark, sf):
    """Crossing points linked to at most six path nodes within 22 m."""
    c = layer(spark, sf, "lights").select("light_id", "px", "py").distinct()
    path_nodes = edges(spark, sf).filter(G.road_class("highway").isin(*G.PATH_CLASSES)).select(F.col("u").alias("node")).distinct()
    n = layer(spark, sf, "benches").select(F.col("gisfid").alias("node"), F.col("px").alias("nx"), F.col("py").alias("ny")).join(path_nodes, "node", "left_semi")
    box = n.select("*", *[F.col(a).alias(b) for a, b in (("nx", "minx"), ("ny", "miny"), ("nx", "maxx"), ("ny", "maxy"))])
    d = F.round(geo.span(F.col("px") - F.col("nx"), F.col("py") - F.col("ny")), 6)
    near = grid.box_point_pairs(box, c, 100.0, 22.0).withColumn("metres", d).filter("metres <= 22")
    return O.top_k(near, ["light_id"], [F.col("metres"), F.col("node")], 6).select("light_id", "node", "metres")


@query("jn_30_pavement_side", cte("segments").rstrip() + f""", {ROUTES_CTE}, p AS (SELECT route_id, i, x1, y1, x2, y2, power(x2-x1,2)+power(y2-y1,2) AS len2, s.segment_id, minx, miny, maxx, maxy FROM pc JOIN segments s ON least(x1,x2)<=maxx+12 AND greatest(x1,x2)>=minx-12 AND least(y1,y2)<=maxy+12 AND greatest(y1,y2)>=miny-12),
 d AS (SELECT *, round({RECT_PIECE},6) AS d FROM p)
SELECT route_id, CAST(i AS INTEGER) AS i, segment_id, d AS metres, CASE WHEN (x2-x1)*((miny+maxy)/2-y1)-(y2-y1)*((minx+maxx)/2-x1)>=0 THEN 1 ELSE -1 END AS side FROM (SELECT *, row_number() OVER (PARTITION BY route_id, i ORDER BY d, segment_id) AS rn FROM d WHERE d<=12) WHERE rn=1""")
def jn_30(spark, sf):
    """Nearest pavement within 12 m of each piece, and the side its centre lies on."""
    p = N.pieces(routes(spark, sf), ["route_id"]).select(
        "*", F.least("x1", "x2").alias("rminx"), F.least("y1", "y2").alias("rminy"), F.greatest("x1", "x2").alias("rmaxx"), F.greatest("y1", "y2").alias("rmaxy"))
    segs = segment_shapes(spark, sf).withColumns({"mx": (F.col("minx") + F.col("maxx")) / 2, "my": (F.col("miny") + F.col("maxy")) / 2})
    best = L.nearest_segment(segs, p, ["route_id", "i"], 12.0, ["x1", "y1", "x2", "y2"], ["mx", "my"])
    cross = (F.col("x2") - F.col("x1")) * (F.col("my") - F.col("y1")) - (F.col("y2") - F.col("y1")) * (F.col("mx") - F.col("x1"))
    return best.select("route_id", "i", "segment_id", "metres", F.when(cross >= 0, 1).otherwise(-1).alias("side"))
