"""Line windows, corridor scores, coverage and sample measures."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geo
from ..operators import corridor as R
from ..operators import lines as N
from ..operators import ordering as O
from ..operators.grid import meet
from .bindings import cte, layer, segment_shapes, table
from .join_queries import RECT_PIECE, corridor_sql, line_pairs_sql, rect_clip
from .registry import query
from .route_fixtures import ROUTES_CTE, routes


@query("win_05_vertex_pairs", f"WITH {ROUTES_CTE} SELECT route_id, CAST(i AS INTEGER) AS i, x1, y1, x2, y2 FROM pc")
def win_05(spark, sf):
    return N.pieces(routes(spark, sf), ["route_id"])


_ALONG = f"{ROUTES_CTE}, al AS (SELECT *, len, sum(len) OVER (PARTITION BY route_id ORDER BY i) AS end_m FROM (SELECT *, sqrt(power(x2-x1,2)+power(y2-y1,2)) AS len FROM pc))"


@query("win_06_distance_along", f"WITH {_ALONG} SELECT route_id, CAST(i AS INTEGER) AS i, round(end_m,5) AS end_m FROM al")
def win_06(spark, sf):
    a = N.along(routes(spark, sf), ["route_id"])
    return a.select("route_id", "i", F.round("end_m", 5).alias("end_m"))


_SAMPLES = f"""{_ALONG}, tt AS (SELECT route_id, max(end_m) AS total, arg_max(x2,i) AS lx, arg_max(y2,i) AS ly FROM al GROUP BY 1), st AS (SELECT route_id, x1 AS sx, y1 AS sy FROM pc WHERE i=0),
 ks AS (SELECT route_id, total, unnest(range(0, CAST(floor(total/28+1e-9) AS BIGINT)+1)) AS n FROM tt),
 sm0 AS (SELECT ks.route_id, n, n*28e0 AS along, total, arg_min({{'a':x1,'b':y1,'c':x2,'d':y2,'f':CASE WHEN len>0 THEN least(1,greatest(0,(n*28e0-(end_m-len))/len)) ELSE 0 END}}, i) AS s
  FROM ks JOIN al ON al.route_id=ks.route_id AND floor(end_m/28+1e-9) >= n GROUP BY 1,2,3,4),
 sm AS (SELECT route_id, n, along, s.a+s.f*(s.c-s.a) AS px, s.b+s.f*(s.d-s.b) AS py, total FROM sm0 UNION ALL SELECT route_id, CAST(floor(total/28+1e-9) AS BIGINT)+1, total, lx, ly, total FROM tt)"""


@query("rq_09_even_samples", f"WITH {_SAMPLES} SELECT route_id, n, round(along,4) AS along, round(px,3) AS px, round(py,3) AS py FROM sm")
def rq_09(spark, sf):
    s = N.samples(routes(spark, sf), ["route_id"], 28.0)
    return s.select("route_id", "n", F.round("along", 4).alias("along"), F.round("px", 3).alias("px"), F.round("py", 3).alias("py"))


def _sampled(spark, sf):
    """Samples and start of each route in one row."""
    r = routes(spark, sf).select("route_id", "line", F.col("line")[0]["x"].alias("sx"), F.col("line")[0]["y"].alias("sy"))
    return N.samples(r, ["route_id", "sx", "sy"], 28.0, nested=True)


@query("rq_04_revisit_ratio", f"""WITH {_SAMPLES}, s AS (SELECT sm.*, sqrt(power(px-sx,2)+power(py-sy,2))<=80 AS a FROM sm JOIN st USING (route_id)),
 h AS (SELECT l.route_id, count(DISTINCT l.n) AS hits FROM s l JOIN s r ON l.route_id=r.route_id AND l.along-r.along>=95 AND l.along>=l.total*0.18 AND NOT (l.a AND r.a) AND power(l.px-r.px,2)+power(l.py-r.py,2)<=225 GROUP BY 1)
SELECT route_id, round(CASE WHEN count(*)<8 OR max(total)<120 THEN 1 ELSE coalesce(max(hits),0)/count(*) FILTER (WHERE along>=total*0.18) END,6) AS revisit FROM s LEFT JOIN h USING (route_id) GROUP BY 1""")
def rq_04(spark, sf):
    v = N.revisit_ratio(_sampled(spark, sf), ["route_id"])
    return v.select("route_id", F.round("revisit", 6).alias("revisit"))


@query("rq_05_reverse_overlap", f"""WITH {_SAMPLES}, c AS (SELECT route_id, count(*) AS cn FROM sm GROUP BY 1), s AS (SELECT sm.*, cn, along>=total/2 AS ret FROM sm JOIN c USING (route_id)),
 r AS (SELECT route_id, n, px, py FROM s WHERE ret), o AS (SELECT route_id, px AS ox, py AS oy FROM s WHERE NOT ret),
 h AS (SELECT r.route_id, count(DISTINCT r.n) AS hits FROM r JOIN o ON r.route_id=o.route_id AND power(px-ox,2)+power(py-oy,2)<=225 GROUP BY 1)
SELECT route_id, round(CASE WHEN count(*)<10 OR max(total)<80 THEN 1 ELSE coalesce(max(hits),0)/count(*) FILTER (WHERE ret) END,6) AS reverse_overlap FROM s LEFT JOIN h USING (route_id) GROUP BY 1""")
def rq_05(spark, sf):
    """Return half against outbound half, on even samples."""
    s = N.samples(routes(spark, sf), ["route_id"], 28.0).withColumn("ret", F.col("along") >= F.col("total") / 2)
    hit = N.near_any(s.filter("ret").select("route_id", "n", "px", "py"), s.filter("NOT ret").select("route_id", "px", "py"), ["route_id"], 15.0)
    hits = hit.groupBy("route_id").agg(F.count(F.lit(1)).alias("hits"))
    base = s.groupBy("route_id").agg(F.count(F.lit(1)).alias("c"), F.max("total").alias("t"), F.count_if("ret").alias("n_ret"))
    v = F.when((F.col("c") < 10) | (F.col("t") < 80), 1.0).otherwise(F.coalesce("hits", F.lit(0)) / F.col("n_ret"))
    return base.join(hits, "route_id", "left").select("route_id", F.round(v, 6).alias("reverse_overlap"))


@query("rq_07_spurs", f"""WITH {_SAMPLES}, c AS (SELECT route_id, count(*) AS cn FROM sm GROUP BY 1), s AS (SELECT sm.*, cn, sqrt(power(px-sx,2)+power(py-sy,2))>80 AS o FROM sm JOIN st USING (route_id) JOIN c USING (route_id)),
 p AS (SELECT l.route_id, l.n, r.n AS m, l.along-r.along AS sep, r.along AS ea, r.px AS ex, r.py AS ey FROM s l JOIN s r ON l.route_id=r.route_id AND l.cn>=10 AND l.o AND r.o AND l.n>=2 AND l.along>=80 AND l.along<=l.total-80 AND r.along>=40
   AND l.along-r.along BETWEEN 120 AND 320 AND power(l.px-r.px,2)+power(l.py-r.py,2)<=225),
 q AS (SELECT p.*, sqrt(power(t.px-ex,2)+power(t.py-ey,2)) AS away FROM p JOIN sm t ON t.route_id=p.route_id AND t.n=CAST(floor((p.n+m)/2) AS BIGINT)),
 b AS (SELECT route_id, n, arg_max(sep/2,m) AS spur, floor(arg_max(ea,m)/50) AS bucket FROM q WHERE away>=greatest(50,sep/2*0.6) AND away<=sep/2*1.35 GROUP BY 1,2),
 k AS (SELECT route_id, bucket, arg_min(spur,n) AS f, max(spur) AS w FROM b GROUP BY 1,2), z AS (SELECT route_id, max(w) AS w, sum(f) AS t FROM k GROUP BY 1)
SELECT route_id, round(coalesce(w,0),4) AS worst_spur_m, round(coalesce(t,0),4) AS total_spur_m FROM c LEFT JOIN z USING (route_id)""")
def rq_07(spark, sf):
    v = N.spur_measure(_sampled(spark, sf), ["route_id"])
    return v.select("route_id", F.round("worst_spur_m", 4).alias("worst_spur_m"), F.round("total_spur_m", 4).alias("total_spur_m"))


@query("rq_06_pair_overlap", f"""WITH {_SAMPLES}, c AS (SELECT route_id, count(*) AS cn FROM sm GROUP BY 1), s AS (SELECT sm.*, cn, (route_id%63)*100000+CAST(floor(route_id/252) AS BIGINT) AS req FROM sm JOIN c USING (route_id)),
 a AS (SELECT * FROM s WHERE n % greatest(1,cn//16)=0 AND cn>=4), b AS (SELECT * FROM s WHERE n % greatest(1,cn//20)=0 AND cn>=4),
 na AS (SELECT route_id, count(*) AS k FROM a GROUP BY 1)
SELECT a.route_id AS route_a, b.route_id AS route_b, round(count(DISTINCT a.n)/max(k),6) AS overlap FROM a JOIN b ON a.req=b.req AND a.route_id<>b.route_id AND power(a.px-b.px,2)+power(a.py-b.py,2)<=3025 JOIN na ON na.route_id=a.route_id GROUP BY 1,2""")
def rq_06(spark, sf):
    """Only pairs that come near each other appear; all others overlap by nothing."""
    s = N.samples(routes(spark, sf), ["route_id"], 28.0, nested=True)
    s = s.withColumn("req", (F.col("route_id") % 63) * 100000 + F.floor(F.col("route_id") / 252))
    a, b = N.every_kth(s, ["route_id"], 16).filter("size_ >= 4"), N.every_kth(s, ["route_id"], 20).filter("size_ >= 4")
    near = N.sample_overlaps(a, b, "route_id", "req", 55.0)
    return near.select(F.col("route_id").alias("route_a"), F.col("route_id_b").alias("route_b"), F.round("overlap", 6).alias("overlap"))


_SEGS = """sg AS (SELECT *, CASE WHEN segment_id%7=0 THEN NULL ELSE 40e0+segment_id%50 END AS day_index_score, CASE WHEN segment_id%5=0 THEN NULL ELSE 30e0+segment_id%61 END AS night_index_score, 20e0+segment_id%71 AS accessibility_score FROM segments)"""


def scored_segments(spark, sf):
    k = F.col("segment_id")
    return segment_shapes(spark, sf).withColumns({
        "day_index_score": F.when(k % 7 == 0, None).otherwise(40.0 + k % 50), "night_index_score": F.when(k % 5 == 0, None).otherwise(30.0 + k % 61),
        "accessibility_score": 20.0 + k % 71})


_c0 = rect_clip()
_RS = f"""{_SEGS}, {ROUTES_CTE}, pr AS (SELECT route_id, i, x1,y1,x2,y2, power(x2-x1,2)+power(y2-y1,2) AS len2, s.* FROM pc JOIN sg s ON least(x1,x2)<=maxx+20 AND greatest(x1,x2)>=minx-20 AND least(y1,y2)<=maxy+20 AND greatest(y1,y2)>=miny-20),
 wt AS (SELECT route_id, segment_id, sum(greatest({_c0[1]}-{_c0[0]},0)*sqrt(len2)) AS on_, sum({corridor_sql(20)}*sqrt(len2)) AS by_, any_value(day_index_score) AS d, any_value(night_index_score) AS nn, any_value(accessibility_score) AS a, any_value(length_m) AS lm, any_value(walk_path_class) AS cl FROM pr GROUP BY 1,2),
 rl AS (SELECT route_id, sum(sqrt(power(x2-x1,2)+power(y2-y1,2))) AS distance_m FROM pc GROUP BY 1)"""
_W = {"route_overlap": "CASE WHEN on_>=0.5 THEN on_ WHEN by_>=0.5 THEN by_ END", "segment_length": "CASE WHEN lm>=0.5 THEN lm END"}


def _route_sql(weight: str) -> str:
    return cte("segments").rstrip() + f""", {_RS}, u AS (SELECT *, {_W[weight]} AS u FROM wt WHERE by_>1e-6), m AS (SELECT route_id, sum(d*u)/sum(u) FILTER (WHERE d IS NOT NULL) AS day, sum(nn*u)/sum(u) FILTER (WHERE nn IS NOT NULL) AS night, sum(a*u)/sum(u) AS acc,
 sum(u) AS mm, count(*) AS hits, sum(CASE WHEN cl='shared_use' THEN u ELSE 0 END)/sum(u) AS sh FROM u GROUP BY 1)
SELECT route_id, round(distance_m,4) AS distance_m, floor(day*1000+0.37)/1000 AS day_index_score, floor(night*1000+0.37)/1000 AS night_index_score, floor(acc*1000+0.37)/1000 AS accessibility_score, floor(least(1,coalesce(mm/distance_m,0))*100000+0.37)/100000 AS coverage_ratio,
 floor(coalesce(mm/distance_m,0)*100000+0.37)/100000 AS coverage_raw, coalesce(hits,0) AS segment_hits, floor(coalesce(sh,0)*100000+0.37)/100000 AS shared_use_ratio, CASE WHEN coalesce(mm/distance_m,0)>=0.35 THEN 'full' ELSE 'reduced' END AS confidence FROM rl LEFT JOIN m USING (route_id)"""


def _route_out(d):
    # shares here are often k/1280: a cut at 0.37 keeps exact halves off the rounding edge
    return d.select("route_id", F.round("distance_m", 4).alias("distance_m"), *[(F.floor(F.col(c) * 1000 + 0.37) / 1000).alias(c) for c in R.STREAMS],
                    *[(F.floor(F.col(c) * 100000 + 0.37) / 100000).alias(c) for c in ("coverage_ratio", "coverage_raw", "shared_use_ratio")], "segment_hits", "confidence")


@query("jn_18_route_scores", _route_sql("route_overlap"))
def jn_18(spark, sf):
    p = N.pieces(routes(spark, sf), ["route_id"])
    return _route_out(R.score_routes(p, scored_segments(spark, sf), "route_id"))


@query("udf_01_route_score_function", f"WITH sc AS ({_route_sql('route_overlap')}) SELECT route_id, distance_m, day_index_score, confidence FROM sc WHERE route_id%7=0")
def udf_01(spark, sf):
    """The route score called from SQL as a table function."""
    r = routes(spark, sf)
    scores = _route_out(R.score_routes(N.pieces(r, ["route_id"]), scored_segments(spark, sf), "route_id"))
    R.register_route_scores(spark, scores, "route_id", "strideframe_route_scores")
    r.select("route_id").createOrReplaceTempView("strideframe_routes")
    return spark.sql("SELECT r.route_id, s.distance_m, s.day_index_score, s.confidence FROM strideframe_routes r, LATERAL strideframe_route_scores(r.route_id) s WHERE r.route_id % 7 = 0")


@query("jn_20_route_scores_by_segment_length", _route_sql("segment_length"))
def jn_20(spark, sf):
    p = N.pieces(routes(spark, sf), ["route_id"])
    return _route_out(R.score_routes(p, scored_segments(spark, sf), "route_id", weight="segment_length"))


@query("jn_19_route_mode_confidence", cte("segments").rstrip() + f""", {_RS}, h AS (SELECT route_id, CASE segment_id%3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE NULL END AS conf FROM wt WHERE by_>1e-6),
 c AS (SELECT route_id, conf, count(*) AS n FROM h WHERE conf IS NOT NULL GROUP BY 1,2), b AS (SELECT route_id, conf FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY n DESC, conf) AS rn FROM c) WHERE rn=1)
SELECT route_id, coalesce(conf,'reduced') AS confidence FROM rl LEFT JOIN b USING (route_id)""")
def jn_19(spark, sf):
    from ..operators import aggregates as A
    p = N.pieces(routes(spark, sf), ["route_id"])
    k = F.col("segment_id")
    segs = segment_shapes(spark, sf).withColumn("conf", F.when(k % 3 == 0, "high").when(k % 3 == 1, "medium"))
    hit = R.segment_value_counts(p, segs, "route_id", 20.0, "conf")
    mode = A.frequent_value(hit, ["route_id"], "conf", "confidence", "reduced", "n_")
    return meet(p.select("route_id").distinct(), mode, "route_id", "left").withColumn("confidence", F.coalesce("confidence", F.lit("reduced")))


def _disc(n: str) -> str:
    """Interval of a piece inside the disc around one end of a way, clipped to the piece; NULL if they do not meet."""
    root = f"sqrt(greatest(b{n}*b{n}-uu*c{n},0))"
    lo, hi = f"(-b{n}-{root})/uu", f"(-b{n}+{root})/uu"
    ok = f"b{n}*b{n}-uu*c{n}>=0 AND {hi}>=0 AND {lo}<=1"
    return f"CASE WHEN {ok} THEN greatest({lo},0) END AS lo{n}, CASE WHEN {ok} THEN least({hi},1) END AS hi{n}"


def _slab(c0: str, cu: str, lo: str, hi: str) -> tuple[str, str]:
    t1, t2, flat = f"({lo}-{c0})/nullif({cu},0)", f"({hi}-{c0})/nullif({cu},0)", f"{c0} BETWEEN {lo} AND {hi}"
    return f"CASE WHEN {cu}<>0 THEN least({t1},{t2}) WHEN {flat} THEN 0 ELSE 2 END", f"CASE WHEN {cu}<>0 THEN greatest({t1},{t2}) WHEN {flat} THEN 1 ELSE -1 END"


def _cover_sql(pieces: str, lines: str, r: int, key: str = "route_id") -> str:
    """CTEs up to s(key, i, share): share of each piece within r of any line; lines have u1, v1, u2, v2."""
    (l0, h0), (l1, h1) = _slab("a0", "au", "0", "vv"), _slab("k0", "ku", f"-{r}*sqrt(vv)", f"{r}*sqrt(vv)")
    return f"""j AS (SELECT {key}, i, x1 AS ax, y1 AS ay, x2-x1 AS ux, y2-y1 AS uy, u1, v1, u2, v2, u2-u1 AS vx, v2-v1 AS vy FROM {pieces} JOIN {lines} ON least(x1,x2)<=greatest(u1,u2)+{r} AND greatest(x1,x2)>=least(u1,u2)-{r} AND least(y1,y2)<=greatest(v1,v2)+{r} AND greatest(y1,y2)>=least(v1,v2)-{r}),
 k AS (SELECT {key}, i, ux*ux+uy*uy AS uu, vx*vx+vy*vy AS vv, (ax-u1)*ux+(ay-v1)*uy AS b1, (ax-u1)*(ax-u1)+(ay-v1)*(ay-v1)-{r * r} AS c1, (ax-u2)*ux+(ay-v2)*uy AS b2, (ax-u2)*(ax-u2)+(ay-v2)*(ay-v2)-{r * r} AS c2,
  (ax-u1)*vx+(ay-v1)*vy AS a0, ux*vx+uy*vy AS au, (ax-u1)*vy-(ay-v1)*vx AS k0, ux*vy-uy*vx AS ku FROM j),
 d AS (SELECT *, {_disc('1')}, {_disc('2')}, greatest({l0},{l1},0) AS slo, least({h0},{h1},1) AS shi FROM k WHERE uu>0),
 g AS (SELECT {key}, i, least(lo1,lo2,CASE WHEN vv>0 AND slo<=shi THEN slo END) AS lo, greatest(hi1,hi2,CASE WHEN vv>0 AND slo<=shi THEN shi END) AS hi FROM d),
 f AS (SELECT {key}, i, greatest(0,hi-greatest(lo,coalesce(max(hi) OVER (PARTITION BY {key}, i ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0))) AS fresh FROM g WHERE lo IS NOT NULL AND hi>lo),
 s AS (SELECT {key}, i, sum(fresh) AS share FROM f GROUP BY 1,2)"""


@query("jn_21_line_coverage", cte("speed_zones").rstrip() + f""", {ROUTES_CTE}, ways AS (SELECT DISTINCT x1 AS u1, y1 AS v1, x2 AS u2, y2 AS v2 FROM speed_zones), {_cover_sql('pc', 'ways', 60)}
SELECT route_id, round(sum(len),4) AS length_m, round(least(1,sum(coalesce(share,0)*len)/sum(len)),6) AS coverage FROM (SELECT *, sqrt(power(x2-x1,2)+power(y2-y1,2)) AS len FROM pc) LEFT JOIN s USING (route_id, i) GROUP BY 1""")
def jn_21(spark, sf):
    """Share of each route within 60 m of a way: the union of capsule intervals per piece."""
    p = N.pieces(routes(spark, sf), ["route_id"])
    z = layer(spark, sf, "speed_zones")
    c = N.covered_metres(p, R.cover_intervals(p, z, "route_id", 60.0), ["route_id"])
    return c.select("route_id", F.round("length_m", 4).alias("length_m"), F.round(F.least(F.lit(1.0), F.col("covered_m") / F.col("length_m")), 6).alias("coverage"))


@query("jn_22_layer_agreement", cte("segments", "speed_zones").rstrip() + f""", ways AS (SELECT zone_id AS route_id, 0 AS i, x1, y1, x2, y2 FROM speed_zones), axes AS (SELECT DISTINCT minx AS u1, (miny+maxy)/2 AS v1, maxx AS u2, (miny+maxy)/2 AS v2 FROM segments),
 {_cover_sql('ways', 'axes', 15)}, near AS (SELECT count(DISTINCT segment_id) AS n FROM ({line_pairs_sql('speed_zones', 'zone_id', 15)}) WHERE {RECT_PIECE}<=15)
SELECT (SELECT count(*) FROM segments) AS n, round((SELECT n FROM near)/(SELECT count(*) FROM segments),6) AS g1_feature_share, round(sum(coalesce(share,0)*len)/sum(len),6) AS g2_length_share FROM (SELECT *, sqrt(power(x2-x1,2)+power(y2-y1,2)) AS len FROM ways) LEFT JOIN s USING (route_id, i)""")
def jn_22(spark, sf):
    """Share of segments near a way, and share of way length near a segment axis."""
    from ..operators.layers import with_line_near
    from .bindings import zone_lines
    segs, z = segment_shapes(spark, sf), zone_lines(spark, sf)
    ways = z.select(F.col("zone_id").alias("route_id"), F.lit(0).alias("i"), "x1", "y1", "x2", "y2")
    axes = segs.select(F.col("minx").alias("x1"), F.col("y").alias("y1"), F.col("maxx").alias("x2"), F.col("y").alias("y2"))
    c = N.covered_metres(ways, R.cover_intervals(ways, axes, "route_id", 15.0), ["route_id"])
    near = with_line_near(segs, z, 15.0).agg(F.count(F.lit(1))).scalar()
    g2 = c.agg(F.round(F.sum("covered_m") / F.sum("length_m"), 6)).scalar()
    return segs.agg(F.count(F.lit(1)).alias("n")).select("n", F.round(near / F.col("n"), 6).alias("g1_feature_share"), g2.alias("g2_length_share"))


# --- windows along routes ----------------------------------------------------

_VOTES = f"{ROUTES_CTE}, v AS (SELECT *, sqrt(power(x2-x1,2)+power(y2-y1,2)) AS len, CASE WHEN (route_id+i)%4=0 THEN NULL WHEN (route_id*3+i*i)%3=0 THEN -1 ELSE 1 END AS side, route_id%200 AS street FROM pc)"


def _votes(spark, sf):
    p = N.pieces(routes(spark, sf), ["route_id"])
    i, k = F.col("i"), F.col("route_id")
    side = F.when((k + i) % 4 == 0, None).when((k * 3 + i * i) % 3 == 0, -1).otherwise(1)
    return p.withColumns({"len": geo.span(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), "side": side, "street": k % 200})


@query("win_07_interior_gap_fill", f"WITH {_VOTES} SELECT route_id, CAST(i AS INTEGER) AS i FROM (SELECT *, min(CASE WHEN side IS NOT NULL THEN i END) OVER (PARTITION BY route_id) AS lo, max(CASE WHEN side IS NOT NULL THEN i END) OVER (PARTITION BY route_id) AS hi FROM v) WHERE i BETWEEN lo AND hi")
def win_07(spark, sf):
    v = _votes(spark, sf)
    ends = v.filter("side IS NOT NULL").groupBy("route_id").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    return v.join(ends, "route_id").filter("i BETWEEN lo AND hi").select("route_id", "i")


@query("win_08_side_vote", f"""WITH {_VOTES}, w AS (SELECT route_id, street, sum(side*len) AS vote, sum(CASE WHEN side IS NOT NULL THEN len END) AS m FROM v GROUP BY 1,2), s AS (SELECT street, sum(side*len) AS sv FROM v GROUP BY 1)
SELECT route_id, CASE WHEN abs(vote)<0.6*m AND sv<>0 THEN CASE WHEN sv>=0 THEN 1 ELSE -1 END WHEN vote>=0 THEN 1 ELSE -1 END AS side FROM w JOIN s USING (street) WHERE vote IS NOT NULL""")
def win_08(spark, sf):
    from ..operators.graph import side_votes
    return side_votes(_votes(spark, sf), "route_id", "street")


_SHIFT = f"{_SAMPLES}, q AS (SELECT route_id, n, CASE WHEN (route_id*7+n*n*13)%5=0 THEN NULL ELSE ((route_id*7+n*n*13)%37)-14 END AS s FROM sm)"


def _shift(spark, sf, nested=False):
    """Proposals of the samples, a row each or in an array per route."""

    def s(n):
        h = F.col("route_id") * 7 + n * n * 13
        return F.when(h % 5 == 0, None).otherwise(h % 37 - 14).alias("s")

    smp = N.samples(routes(spark, sf), ["route_id"], 28.0, nested=nested)
    if nested:
        return smp.select("route_id", F.transform("samples", lambda p: F.struct(p["n"].alias("n"), p["px"].alias("px"), p["py"].alias("py"), s(p["n"]))).alias("samples"))
    return smp.select("route_id", "n", s(F.col("n")), "px", "py")


@query("win_09_median_then_mean", f"""WITH {_SHIFT}, c AS (SELECT route_id, n, list_sort(list(coalesce(s,0)) OVER (PARTITION BY route_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS l FROM q), m AS (SELECT route_id, n, l[len(l)//2+1] AS med FROM c)
SELECT route_id, n, round(avg(med) OVER (PARTITION BY route_id ORDER BY n ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING),6) AS smooth FROM m""")
def win_09(spark, sf):
    """Frames of a few rows, so long routes are cut into overlapping chunks first."""
    spread, w, home = O.with_halo(_shift(spark, sf), ["route_id"], "n", 3, 3)
    win = F.array_sort(F.collect_list(F.coalesce("s", F.lit(0))).over(w.rowsBetween(-2, 2)))
    med = spread.withColumn("l", win).withColumn("med", F.element_at("l", (F.floor(F.size("l") / 2) + 1).cast("int")))
    out = med.withColumn("smooth", F.round(F.avg("med").over(w.rowsBetween(-1, 1)), 6)).filter(home)
    return out.select("route_id", "n", "smooth")


@query("win_10_run_agreement", f"""WITH {_SHIFT}, r AS (SELECT *, sum(CASE WHEN s IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY route_id ORDER BY n) AS run FROM q),
 g AS (SELECT *, count(*) FILTER (WHERE s>0) OVER (PARTITION BY route_id, run) AS p, count(*) FILTER (WHERE s<0) OVER (PARTITION BY route_id, run) AS m FROM r WHERE s IS NOT NULL)
SELECT route_id, n, s FROM g WHERE greatest(p,m)/greatest(1,p+m)>=0.8 AND s*(CASE WHEN p>=m THEN 1 ELSE -1 END)>=0""")
def win_10(spark, sf):
    s = _shift(spark, sf).withColumn("n1", F.col("n"))
    r = O.chunked_total(s, ["route_id"], "n", F.col("s").isNull().cast("long"), "run").filter("s IS NOT NULL")
    g = r.groupBy("route_id", "run").agg(F.count_if(F.col("s") > 0).alias("p"), F.count_if(F.col("s") < 0).alias("m"))
    keep = (F.greatest("p", "m") / F.greatest(F.lit(1), F.col("p") + F.col("m")) >= 0.8) & (F.col("s") * F.when(F.col("p") >= F.col("m"), 1).otherwise(-1) >= 0)
    return r.join(g, ["route_id", "run"]).filter(keep).select("route_id", "n", "s")


@query("win_11_turn_damping", f"""WITH {_SAMPLES}, t AS (SELECT route_id, n, px-coalesce(lag(px,2) OVER w, lag(px,1) OVER w, px) AS e1, py-coalesce(lag(py,2) OVER w, lag(py,1) OVER w, py) AS n1,
 coalesce(lead(px,2) OVER w, lead(px,1) OVER w, px)-px AS e2, coalesce(lead(py,2) OVER w, lead(py,1) OVER w, py)-py AS n2 FROM sm WINDOW w AS (PARTITION BY route_id ORDER BY n)),
 g AS (SELECT route_id, n, CASE WHEN sqrt(e1*e1+n1*n1)<1 OR sqrt(e2*e2+n2*n2)<1 THEN 0 ELSE degrees(acos(least(1,greatest(-1,(e1*e2+n1*n2)/(sqrt(e1*e1+n1*n1)*sqrt(e2*e2+n2*n2)))))) END AS turn FROM t)
SELECT route_id, n, round(turn,2) AS turn, round(greatest(0,1-turn/45),3) AS damping FROM g""")
def win_11(spark, sf):
    s = N.samples(routes(spark, sf), ["route_id"], 28.0)
    spread, w, home = O.with_halo(s, ["route_id"], "n", 2, 2)

    def pick(c, side):
        """Two rows away, else the last row there is on that side."""
        return F.coalesce(side(c, 2).over(w), side(c, 1).over(w), F.col(c))

    d = spread.withColumns({"ax": pick("px", F.lag), "ay": pick("py", F.lag), "cx": pick("px", F.lead), "cy": pick("py", F.lead)}).filter(home)
    e1, n1, e2, n2 = F.col("px") - F.col("ax"), F.col("py") - F.col("ay"), F.col("cx") - F.col("px"), F.col("cy") - F.col("py")
    l1, l2 = geo.span(e1, n1), geo.span(e2, n2)
    turn = F.when((l1 < 1) | (l2 < 1), 0.0).otherwise(F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.try_divide(e1 * e2 + n1 * n2, l1 * l2))))))
    t = d.withColumn("turn", turn)
    return t.select("route_id", "n", F.round("turn", 2).alias("turn"), F.round(F.greatest(F.lit(0.0), 1 - F.col("turn") / 45), 3).alias("damping"))


@query("rq_21_side_flips", f"""WITH {_SHIFT}, k AS (SELECT route_id, n, s FROM q WHERE abs(s)>=2), f AS (SELECT route_id, s, lag(sign(s)) OVER (PARTITION BY route_id ORDER BY n) AS prev FROM k)
SELECT route_id, count(*) FILTER (WHERE prev<>sign(s)) AS flips, max(abs(s)) AS max_offset FROM f GROUP BY 1""")
def rq_21(spark, sf):
    """Flips between kept samples: kept rows get dense positions, then a lag of one row with overlap."""
    k = _shift(spark, sf).withColumn("keep", (F.abs(F.col("s")) >= 2))
    pos = O.chunked_total(k, ["route_id"], "n", F.coalesce("keep", F.lit(False)).cast("long"), "pos").filter("keep")
    spread, w, home = O.with_halo(pos, ["route_id"], "pos", 1, 0)
    f = spread.withColumn("prev", F.lag(F.signum("s")).over(w)).filter(home)
    return f.groupBy("route_id").agg(F.count_if(F.col("prev") != F.signum("s")).alias("flips"), F.max(F.abs(F.col("s"))).alias("max_offset"))
