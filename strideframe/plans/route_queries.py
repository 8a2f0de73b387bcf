"""Ranking, gates and comparison of route cards."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import ordering as O
from ..operators import reports as P
from ..operators import routes as R
from .bindings import table
from .registry import query
from .route_fixtures import CARD_WAY, CARDS_CTE, card_points, cards

_IMP = "greatest(10,least(100,{}))"
_HEAT = "coalesce(heat_shade_score,(day_index_score-0.6e0*accessibility_score)/0.4e0)"
_BASE = f"""{CARDS_CTE}, b0 AS (SELECT *, CAST({_IMP.format('pref_acc')} AS DOUBLE) AS wa, CAST(CASE WHEN walk_mode='night' THEN {_IMP.format('pref_dark')} ELSE {_IMP.format('pref_shade')} END AS DOUBLE) AS wb,
  CASE WHEN walk_mode='night' THEN coalesce(lighting_after_dark_score,night_index_score) WHEN {_HEAT} IS NULL THEN NULL ELSE least(100,greatest(0,{_HEAT})) END AS st FROM cards),
 b1 AS (SELECT *, CASE WHEN accessibility_score IS NULL AND st IS NULL THEN NULL ELSE (coalesce(accessibility_score*wa,0)+coalesce(st*wb,0))/(CASE WHEN accessibility_score IS NULL THEN 0 ELSE wa END+CASE WHEN st IS NULL THEN 0 ELSE wb END) END AS pref,
  least(1,greatest(0,((wa+wb)/2-10)/90)) AS t, CASE WHEN prefer_shared THEN floor(least(1,greatest(0,shared_use_ratio))*12+0.5) ELSE 0 END AS bonus, min(duration_s) OVER (PARTITION BY od_id) AS sd, min(distance_m) OVER (PARTITION BY od_id) AS sm,
  starts_with(strategy,'score_aware') OR starts_with(strategy,'distance_') AS aware,
  CASE WHEN wb>=wa THEN CASE WHEN walk_mode='night' THEN coalesce(lighting_after_dark_score,night_index_score) ELSE coalesce({_HEAT},day_index_score) END ELSE accessibility_score END AS dom FROM b0),
 b2 AS (SELECT *, 0.78*(1-t)+0.15*t AS w, 0.12*(1-t)+0.05*t AS wo FROM b1),
 b3 AS (SELECT *, CASE WHEN pref IS NULL THEN NULL ELSE (1-w)*pref+w*greatest(0,100*(1-0.5*(least(1.5,duration_s/sd)-1)))+bonus-least(14,CASE WHEN aware THEN 0 ELSE greatest(0,centreline_share) END*CASE WHEN nudged THEN 0.45 ELSE 1 END*14) END AS match FROM b2),
 b4 AS (SELECT *, row_number() OVER (PARTITION BY od_id ORDER BY round(match,6) DESC NULLS LAST, round(pref,6) DESC NULLS LAST, round(dom,6) DESC NULLS LAST, duration_s, distance_m, card) AS rk FROM b3)"""


@query("rq_01_preference_score", f"WITH {_BASE} SELECT od_id, card, round(pref,6) AS pref FROM b3")
def rq_01(spark, sf):
    return cards(spark, sf).select("od_id", "card", F.round(R.preference_score(), 6).alias("pref"))


@query("rq_02_efficiency_weight", f"WITH {_BASE} SELECT od_id, card, round(w,8) AS trip_weight, round(wo,8) AS outing_weight FROM b3")
def rq_02(spark, sf):
    return cards(spark, sf).select("od_id", "card", F.round(R.efficiency_weight(), 8).alias("trip_weight"), F.round(R.efficiency_weight(R.OUTING_EFFICIENCY), 8).alias("outing_weight"))


@query("rq_03_trip_rank_score", f"WITH {_BASE} SELECT od_id, card, round(match,8) AS match_score, CAST(bonus AS DOUBLE) AS shared_bonus FROM b3")
def rq_03(spark, sf):
    c = R.scored_cards(cards(spark, sf), "od_id")
    return c.select("od_id", "card", F.round("match_score", 8).alias("match_score"), R.shared_bonus().alias("shared_bonus"))


def ranked(spark, sf):
    """Cards per request are few (one per line number), so the window stays small whatever the request."""
    from pyspark.sql import Window
    w = Window.partitionBy("od_id").orderBy(*R.rank_columns(["card"]))
    return R.scored_cards(cards(spark, sf), "od_id").withColumn("rank", F.row_number().over(w))


@query("win_14_preference_ranking", f"WITH {_BASE} SELECT od_id, card, CAST(rk AS INTEGER) AS rank FROM b4")
def win_14(spark, sf):
    return ranked(spark, sf).select("od_id", "card", "rank")


@query("rq_19_card_label", f"""WITH {_BASE}, s AS (SELECT *, row_number() OVER (PARTITION BY od_id ORDER BY distance_m, card) AS sk FROM b4)
SELECT od_id, card, CASE WHEN rk=1 THEN 'Best for you' WHEN starts_with(strategy,'loop_') THEN 'Another loop' WHEN contains(strategy,'_away') THEN 'Away from roads'
 WHEN contains(strategy,'_complement') THEN CASE WHEN walk_mode='night' THEN 'Better lighting' ELSE 'More shade' END WHEN aware THEN 'Neighbourhood links' WHEN sk=1 THEN 'Shortest' ELSE 'Another option' END AS label FROM s""")
def rq_19(spark, sf):
    c = ranked(spark, sf)
    first = c.groupBy("od_id").agg(F.min_by("card", F.struct("distance_m", "card")).alias("short_card"))
    stream = F.when(F.col("walk_mode") == "night", "afterDark").otherwise("shadeHeat")
    return c.join(first, "od_id").select("od_id", "card", R.card_label(F.col("rank"), F.col("strategy"), stream, F.col("card") == F.col("short_card")).alias("label"))


_TARGET = "(900+(od_id%10)*100)"


@query("rq_11_outing_match", f"""WITH {_BASE}, f AS (SELECT *, abs(duration_s-{_TARGET})/60 AS off FROM b3) SELECT od_id, card, abs(duration_s-{_TARGET})<=300 AS in_band, round(CASE WHEN off>5 THEN 0 ELSE 100-3*off END,6) AS fit,
 round(CASE WHEN pref IS NULL THEN 8+bonus ELSE (1-wo)*pref+wo*CASE WHEN off>5 THEN 0 ELSE 100-3*off END+8+bonus END,6) AS outing_match FROM f""")
def rq_11(spark, sf):
    target = (900 + (F.col("od_id") % 10) * 100).cast("double")
    d = F.col("duration_s")
    c = cards(spark, sf)
    return c.select("od_id", "card", (F.abs(d - target) <= 300).alias("in_band"), F.round(R.duration_fit(d, target), 6).alias("fit"),
                    F.round(R.outing_match(R.preference_score(), d, target, F.lit(8.0)), 6).alias("outing_match"))


@query("rq_08_circuit_quality", f"WITH {CARDS_CTE} SELECT od_id, card, floor((1-least(1,centreline_share))*100-(distance_m/40*0.35+duration_s/20*0.06)+0.5) AS quality FROM cards")
def rq_08(spark, sf):
    return cards(spark, sf).select("od_id", "card", R.circuit_quality(F.col("centreline_share"), F.col("distance_m") / 40, F.col("duration_s") / 20).alias("quality"))


_GATE = f"""g AS (SELECT od_id, card, CASE WHEN card=7 THEN NULL ELSE centreline_share*60 END AS gap, abs(duration_s-{_TARGET}) AS off, shared_use_ratio AS rev, centreline_share/3 AS rv, distance_m/12 AS ws, distance_m/6 AS ts, duration_s/4 AS aw FROM cards)"""
_REASON = "CASE WHEN gap IS NULL THEN 'no_end' WHEN gap>40 THEN 'not_closed' WHEN off>300 THEN 'duration' WHEN rev>0.55 THEN 'reverse_overlap' WHEN rv>0.2 THEN 'revisit' WHEN ws>150 OR ts>320 THEN 'spur' WHEN aw<800*0.35 THEN 'too_small' ELSE 'accepted' END"


def _gates(spark, sf):
    target = 900 + (F.col("od_id") % 10) * 100
    s = F.col("centreline_share")
    return cards(spark, sf).withColumn("reason", R.loop_reject_reason(
        F.when(F.col("card") == 7, None).otherwise(s * 60), F.abs(F.col("duration_s") - target), F.col("shared_use_ratio"), s / 3,
        F.col("distance_m") / 12, F.col("distance_m") / 6, F.col("duration_s") / 4, F.lit(800.0)))


@query("rq_12_gate_tally", f"WITH {CARDS_CTE}, {_GATE} SELECT {_REASON} AS reason, count(*) AS n FROM g GROUP BY 1")
def rq_12(spark, sf):
    return _gates(spark, sf).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("rq_13_candidate_funnel", f"""WITH {CARDS_CTE}, {_GATE}, r AS (SELECT od_id, {_REASON} AS reason FROM g)
SELECT od_id, count(*) AS drawn, count(*) FILTER (WHERE reason NOT IN ('no_end','not_closed')) AS closed, count(*) FILTER (WHERE reason NOT IN ('no_end','not_closed','duration')) AS in_band, count(*) FILTER (WHERE reason='accepted') AS accepted FROM r GROUP BY 1""")
def rq_13(spark, sf):
    r = F.col("reason")
    return _gates(spark, sf).groupBy("od_id").agg(
        F.count(F.lit(1)).alias("drawn"), F.count_if(~r.isin("no_end", "not_closed")).alias("closed"),
        F.count_if(~r.isin("no_end", "not_closed", "duration")).alias("in_band"), F.count_if(r == "accepted").alias("accepted"))


@query("rq_14_road_share", """WITH e AS (SELECT l_suppkey AS route_id, CASE l_linenumber WHEN 1 THEN 'residential' WHEN 2 THEN 'service' WHEN 3 THEN 'trunk' WHEN 4 THEN 'footway' ELSE 'path' END AS hw, l_quantity AS m FROM lineitem)
SELECT route_id, round(sum(CASE WHEN hw IN ('residential','trunk') THEN m ELSE 0 END)/sum(m),6) AS road_share, sum(CASE WHEN hw IN ('residential','trunk') THEN m ELSE 0 END)/sum(m)>0.28 AS rejected FROM e GROUP BY 1""")
def rq_14(spark, sf):
    from ..operators.graph import CENTRELINE_ROADS
    k = F.col("l_linenumber")
    hw = F.when(k == 1, "residential").when(k == 2, "service").when(k == 3, "trunk").when(k == 4, "footway").otherwise("path")
    share = F.sum(F.when(hw.isin(*CENTRELINE_ROADS), F.col("l_quantity")).otherwise(0.0)) / F.sum("l_quantity")
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("route_id")).agg(F.round(share, 6).alias("road_share"), (share > 0.28).alias("rejected"))


@query("rq_16_bakeoff_report", f"""WITH {CARDS_CTE}, s AS (SELECT od_id, min(distance_m) FILTER (WHERE card NOT IN (2,3)) AS sh FROM cards GROUP BY 1),
 m AS (SELECT od_id, max(day_index_score/10) FILTER (WHERE card NOT IN (2,3)) AS control_day, arg_min(day_index_score/10, card) FILTER (WHERE card IN (2,3)) AS challenger_day, arg_min(distance_m, card) FILTER (WHERE card IN (2,3)) AS cd FROM cards GROUP BY 1)
SELECT od_id, round(control_day,6) AS control_day, round(challenger_day,6) AS challenger_day, round(cd/sh,6) AS detour, CASE WHEN abs(challenger_day-control_day)<0.05 THEN 'tie' WHEN challenger_day>control_day THEN 'challenger' ELSE 'control' END AS winner
FROM m JOIN s USING (od_id) WHERE control_day IS NOT NULL AND challenger_day IS NOT NULL""")
def rq_16(spark, sf):
    c = cards(spark, sf).withColumn("ch", F.col("card").isin(2, 3))
    day = F.col("day_index_score") / 10
    m = c.groupBy("od_id").agg(
        F.max(F.when(~F.col("ch"), day)).alias("control_day"), F.min(F.when(~F.col("ch"), F.col("distance_m"))).alias("sh"),
        F.min_by(F.struct(day.alias("d"), "distance_m"), F.when(F.col("ch"), F.col("card"))).alias("c"))
    m = m.filter("control_day IS NOT NULL AND c.d IS NOT NULL")
    d = F.col("c.d") - F.col("control_day")
    return m.select("od_id", F.round("control_day", 6).alias("control_day"), F.round("c.d", 6).alias("challenger_day"), F.round(F.col("c.distance_m") / F.col("sh"), 6).alias("detour"),
                    F.when(F.abs(d) < 0.05, "tie").when(d > 0, "challenger").otherwise("control").alias("winner"))


@query("rq_17_fitness_report", """WITH r AS (SELECT o_custkey%50 AS grp, (o_totalprice%1000)/1000 AS m1, (o_totalprice%777)/777 AS m3, CASE WHEN o_orderkey%7=0 THEN NULL ELSE (o_totalprice%900)/600 END AS m4 FROM orders)
SELECT grp, count(*) AS n, count(*) FILTER (WHERE m1>=0.7) AS m1_ok, count(*) FILTER (WHERE m3>=0.7) AS m3_ok, count(*) FILTER (WHERE m4>1.25) AS m4_bad, CASE WHEN count(*) FILTER (WHERE m1>=0.7)>=count(*)*0.8 AND count(*) FILTER (WHERE m3>=0.7)>=count(*)*0.8 AND count(*) FILTER (WHERE m4>1.25)<=count(*)*0.2 THEN 'fit'
 WHEN count(*) FILTER (WHERE m1>=0.7)<count(*)*0.6 OR count(*) FILTER (WHERE m3>=0.7)<count(*)*0.6 THEN 'caution' ELSE 'mixed' END AS verdict FROM r GROUP BY 1""")
def rq_17(spark, sf):
    p = F.col("o_totalprice")
    r = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("grp"), (p % 1000 / 1000).alias("m1"), (p % 777 / 777).alias("m3"), F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(p % 900 / 600).alias("m4"))
    g = r.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_if(P.fitness_band("m1") != "weak").alias("m1_ok"), F.count_if(P.fitness_band("m3") != "weak").alias("m3_ok"), F.count_if(F.col("m4") > 1.25).alias("m4_bad"))
    return g.withColumn("verdict", P.fitness_verdict("n", "m1_ok", "m3_ok", "m4_bad"))


@query("rq_18_hybrid_audit", f"""WITH {CARDS_CTE}, a AS (SELECT od_id, max(distance_m) FILTER (WHERE card=1) AS ctl, max(distance_m) FILTER (WHERE card=2) AS ch, max(shared_use_ratio) AS orphan FROM cards GROUP BY 1)
SELECT od_id, round(ch/ctl,6) AS ratio, concat_ws(';', CASE WHEN ch/ctl<0.85 THEN 'much_shorter' END, CASE WHEN ch/ctl>1.2 THEN 'much_longer' END, CASE WHEN orphan>0.35 THEN 'orphan_share' END) AS flags FROM a WHERE ctl IS NOT NULL AND ch IS NOT NULL""")
def rq_18(spark, sf):
    c = cards(spark, sf).groupBy("od_id").agg(F.max(F.when(F.col("card") == 1, F.col("distance_m"))).alias("ctl"), F.max(F.when(F.col("card") == 2, F.col("distance_m"))).alias("ch"), F.max("shared_use_ratio").alias("orphan"))
    ratio = F.col("ch") / F.col("ctl")
    return c.filter("ctl IS NOT NULL AND ch IS NOT NULL").select("od_id", F.round(ratio, 6).alias("ratio"), P.audit_flags(ratio, F.col("orphan")).alias("flags"))


def _greedy_sql(order, clash, rounds, where="true"):
    """k rounds of: best remaining per request, then drop what clashes with it."""
    out, prev, parts = "", "c0", []
    out = f", c0 AS (SELECT * FROM cards WHERE {where})"
    for r in range(1, rounds + 1):
        out += f", p{r} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY od_id ORDER BY {order}, card) AS rn_ FROM c{r-1}) WHERE rn_=1), c{r} AS (SELECT c.* FROM c{r-1} c JOIN p{r} p USING (od_id) WHERE c.card<>p.card AND NOT ({clash}))"
        parts.append(f"SELECT od_id, card, {r} AS pick FROM p{r}")
    return out + " " + " UNION ALL ".join(parts)


_WAY = {p: {k: re.sub(r"\b(od_id|card)\b", rf"{p}.\1", v) for k, v in CARD_WAY.items()} for p in "cp"}
_GAP = "sqrt(" + "+".join(f"power(({_WAY['c'][f'{k}1']}-({_WAY['p'][f'{k}1']}))*(1-t/6e0)+({_WAY['c'][f'{k}2']}-({_WAY['p'][f'{k}2']}))*(t/6e0),2)" for k in "xy") + ")"
_GAPS = f"list_transform(range(7), lambda t: {_GAP})"
_CLASH = f"abs(c.distance_m-p.distance_m)/greatest(c.distance_m,p.distance_m,1)<=0.22 AND (len(list_filter({_GAPS}, lambda d: d<0.0011))>=5 OR list_sum({_GAPS})/7<0.0007)"


@query("rq_10_greedy_distinct", f"WITH {CARDS_CTE} {_greedy_sql('round(distance_m,6)', _CLASH, 3)}")
def rq_10(spark, sf):
    """Shortest first, then the shortest that runs another way: seven points of each are compared."""
    c = card_points(cards(spark, sf)).withColumn("o1", F.round("distance_m", 6))
    return R.greedy_picks(c, "od_id", "card", ["o1"], R.same_way, 3, ["distance_m", "points"])


@query("rq_23_ordered_distinct", f"WITH {CARDS_CTE} {_greedy_sql('CASE card WHEN 2 THEN 0 WHEN 4 THEN 1 ELSE 2 END', _CLASH, 3, 'card IN (2,3,4)')}")
def rq_23(spark, sf):
    """Best, complement, away: kept only when distinct from the ones before."""
    c = card_points(cards(spark, sf).filter("card IN (2,3,4)")).withColumn("o1", F.when(F.col("card") == 2, 0).when(F.col("card") == 4, 1).otherwise(2))
    return R.greedy_picks(c, "od_id", "card", ["o1"], R.same_way, 3, ["distance_m", "points"])


@query("rq_20_preference_battery", f"""WITH {_BASE}, alt AS (SELECT *, CASE WHEN accessibility_score IS NULL AND st IS NULL THEN NULL ELSE (coalesce(accessibility_score*wb,0)+coalesce(st*wa,0))/(CASE WHEN accessibility_score IS NULL THEN 0 ELSE wb END+CASE WHEN st IS NULL THEN 0 ELSE wa END) END AS p2 FROM b3),
 k AS (SELECT od_id, arg_max(card,(round(pref,6),-card)) FILTER (WHERE pref IS NOT NULL) AS best, arg_max(card,(round(p2,6),-card)) FILTER (WHERE p2 IS NOT NULL) AS best2, count(*) AS n FROM alt GROUP BY 1)
 , w AS (SELECT k.*, coalesce(best<>best2 AND NOT ({{clash}}),false) AS moved FROM k LEFT JOIN cards c ON c.od_id=k.od_id AND c.card=k.best LEFT JOIN cards p ON p.od_id=k.od_id AND p.card=k.best2)
SELECT od_id, best, best2, moved, CASE WHEN n>1 THEN 1 ELSE 0 END+CASE WHEN moved THEN 2 ELSE 0 END AS usefulness FROM w""".replace("{{clash}}", "{clash}").replace("{clash}", _CLASH))
def rq_20(spark, sf):
    from ..functions.columns import weighted_present_mean
    a, b = R.active_weights()
    c = card_points(cards(spark, sf)).withColumns({"p1": R.preference_score(), "p2": weighted_present_mean([(F.col("accessibility_score"), b), (R.second_stream(), a)])})

    def top(p):
        return F.max_by(F.struct("card", "distance_m", "points"), F.when(F.col(p).isNotNull(), F.struct(F.round(p, 6), -F.col("card"))))

    k = c.groupBy("od_id").agg(top("p1").alias("a"), top("p2").alias("b"), F.count(F.lit(1)).alias("n"))
    # another card counts as another choice only if it runs another way
    moved = F.coalesce((F.col("a.card") != F.col("b.card")) & ~R.same_way(F.col("a"), F.col("b")), F.lit(False))
    return k.select("od_id", F.col("a.card").alias("best"), F.col("b.card").alias("best2"), moved.alias("moved"), (F.when(F.col("n") > 1, 1).otherwise(0) + F.when(moved, 2).otherwise(0)).alias("usefulness"))


@query("rq_15_lateral_shift", """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey%9=0 THEN NULL ELSE (l_partkey%80)/2 END AS sw_d, (l_suppkey%41)-20 AS sw_lat, (l_partkey%30)/2 AS rd_d, CASE l_returnflag WHEN 'A' THEN 16 WHEN 'N' THEN 11 ELSE 7 END AS rd_t, (l_suppkey%7)-3 AS rd_lat, l_quantity<3 AS crossing, CASE WHEN l_quantity>45 THEN 2 END AS path_d FROM lineitem),
 s AS (SELECT *, least(abs(sw_lat),sw_d,9) AS mag, least(9,rd_t-rd_d) AS push FROM p)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE WHEN crossing THEN NULL WHEN path_d<=3 AND rd_d>4.5 THEN NULL WHEN sw_d>3 AND sw_d<=30 AND mag>=1.5 THEN CASE WHEN sw_lat>=0 THEN mag ELSE -mag END WHEN rd_d<rd_t AND push>=1.5 THEN CASE WHEN rd_lat>0 THEN -push ELSE push END END AS DOUBLE) AS shift FROM s""")
def rq_15(spark, sf):
    pk, sk = F.col("l_partkey"), F.col("l_suppkey")
    p = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        P.lateral_shift(F.col("l_quantity") < 3, F.when(F.col("l_quantity") > 45, 2.0), F.when(pk % 9 == 0, None).otherwise(pk % 80 / 2), (sk % 41 - 20).cast("double"),
                        pk % 30 / 2, F.when(F.col("l_returnflag") == "A", 16.0).when(F.col("l_returnflag") == "N", 11.0).otherwise(7.0), (sk % 7 - 3).cast("double")).alias("shift"))
    return p


@query("rq_22_variant_comparison", f"""WITH {CARDS_CTE}, v AS (SELECT od_id, CASE WHEN card<=2 THEN 'baseline' WHEN card<=4 THEN 'x4' ELSE 'x8' END AS variant, duration_s, centreline_share, shared_use_ratio FROM cards)
SELECT variant, count(*) AS n, round(avg(duration_s),4) AS mean_duration_s, count(*) FILTER (WHERE abs(duration_s-{_TARGET})<=300) AS in_band, round(avg(centreline_share),6) AS mean_revisit, round(max(shared_use_ratio),6) AS max_overlap FROM v GROUP BY 1""")
def rq_22(spark, sf):
    v = F.when(F.col("card") <= 2, "baseline").when(F.col("card") <= 4, "x4").otherwise("x8")
    t = 900 + (F.col("od_id") % 10) * 100
    return cards(spark, sf).groupBy(v.alias("variant")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("duration_s"), 4).alias("mean_duration_s"), F.count_if(F.abs(F.col("duration_s") - t) <= 300).alias("in_band"),
        F.round(F.avg("centreline_share"), 6).alias("mean_revisit"), F.round(F.max("shared_use_ratio"), 6).alias("max_overlap"))


@query("win_12_best_per_sector", """WITH c AS (SELECT l_suppkey AS start_id, l_orderkey*8+l_linenumber AS node, l_partkey%360 AS bearing, max(l_extendedprice) AS blend FROM lineitem GROUP BY 1,2,3)
SELECT start_id, CAST(floor(bearing/30) AS BIGINT) AS sector, arg_max(node,(blend,-node)) AS node FROM c GROUP BY 1,2""")
def win_12(spark, sf):
    c = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("start_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("node"), (F.col("l_partkey") % 360).alias("bearing"), F.col("l_extendedprice").alias("blend"))
    return c.groupBy("start_id", F.floor(F.col("bearing") / 30).alias("sector")).agg(F.max_by("node", F.struct("blend", -F.col("node"))).alias("node"))


@query("win_13_draw_order", """WITH p AS (SELECT l_suppkey%50 AS start_id, l_orderkey*8+l_linenumber AS pair_id, max(l_partkey)%360 AS bearing, max(CASE WHEN l_linenumber=7 THEN NULL ELSE l_extendedprice END) AS blend FROM lineitem GROUP BY 1,2),
 r AS (SELECT *, row_number() OVER (PARTITION BY start_id ORDER BY blend, pair_id)-1 AS i, count(*) OVER (PARTITION BY start_id) AS n FROM p WHERE blend IS NOT NULL), q AS (SELECT start_id, max(blend) AS q3 FROM r WHERE i=floor(n*0.75) GROUP BY 1),
 t AS (SELECT start_id, pair_id, blend, floor(bearing/60) AS sec FROM p JOIN q USING (start_id) WHERE blend>=q3), f AS (SELECT start_id, sec, arg_max(pair_id,(blend,-pair_id)) AS pair_id FROM t GROUP BY 1,2)
SELECT start_id, CAST(sec AS BIGINT) AS sector, pair_id FROM f""")
def win_13(spark, sf):
    """First pick per 60-degree sector among the top quarter; the quartile comes from distributed ranks."""
    p = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("start_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pair_id")).agg(
        (F.max("l_partkey") % 360).alias("bearing"), F.max(F.when(F.col("l_linenumber") == 7, None).otherwise(F.col("l_extendedprice"))).alias("blend"))
    cum = O.cumulative_counts(p, "blend", ["start_id"])
    i = F.floor(F.col("total") * 0.75)
    q = cum.filter((F.col("before") <= i) & (i < F.col("before") + F.col("cnt"))).groupBy("start_id").agg(F.max("blend").alias("q3"))
    t = p.join(q, "start_id").filter("blend >= q3")
    return t.groupBy("start_id", F.floor(F.col("bearing") / 60).alias("sector")).agg(F.max_by("pair_id", F.struct("blend", -F.col("pair_id"))).alias("pair_id"))
