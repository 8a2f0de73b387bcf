"""Routes and route cards derived from order lines, in SQL both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.routes import LIKE_POINTS, even_points
from .bindings import table

ROUTE_POINTS = """SELECT l_orderkey AS route_id, l_linenumber AS pos,
 ((l_orderkey*7919)%100003)/10 + (l_linenumber*83+l_orderkey*l_linenumber*17)%300 AS x,
 ((l_orderkey*6389+17)%99991)/10 + (l_linenumber*57+l_orderkey*l_linenumber*29)%280 AS y
 FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""

CARDS = """SELECT l_orderkey AS od_id, l_linenumber AS card, max(l_extendedprice)/40 AS distance_m, max(l_extendedprice)/52+60*l_linenumber AS duration_s,
 CASE WHEN l_linenumber=5 THEN NULL ELSE max(l_discount)*700+20 END AS accessibility_score,
 CASE WHEN l_linenumber=6 THEN NULL ELSE max(l_quantity)+35 END AS day_index_score,
 CASE WHEN l_linenumber IN (2,5,6) THEN NULL ELSE max(l_tax)*900+15 END AS heat_shade_score,
 CASE WHEN l_linenumber=4 THEN NULL ELSE min(l_quantity)+30 END AS night_index_score,
 CASE WHEN l_linenumber IN (3,4) THEN NULL ELSE min(l_tax)*1000+10 END AS lighting_after_dark_score,
 max(l_tax)*12 AS shared_use_ratio, min(l_discount)*8 AS centreline_share, max(l_partkey)%2=0 AS nudged,
 CASE l_linenumber WHEN 1 THEN 'alternatives' WHEN 2 THEN 'score_aware_day_prefs' WHEN 3 THEN 'score_aware_day_prefs_away' WHEN 4 THEN 'score_aware_day_complement'
  WHEN 5 THEN 'distance_day' WHEN 6 THEN 'loop_tri_30' ELSE 'walkway_prefer' END AS strategy,
 l_orderkey%101 AS pref_acc, (l_orderkey*7)%101 AS pref_shade, (l_orderkey*13)%101 AS pref_dark, l_orderkey%3=0 AS prefer_shared,
 CASE WHEN l_orderkey%2=0 THEN 'day' ELSE 'night' END AS walk_mode
 FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""


def sql_of(text: str) -> str:
    return text.replace("{lineitem}", "lineitem")


ROUTES_CTE = f"rp AS ({sql_of(ROUTE_POINTS)}), pc AS (SELECT route_id, rn-1 AS i, x AS x1, y AS y1, x2, y2 FROM (SELECT *, row_number() OVER w AS rn, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM rp WINDOW w AS (PARTITION BY route_id ORDER BY pos)) WHERE x2 IS NOT NULL)"
CARDS_CTE = f"cards AS ({sql_of(CARDS)})"


#: straight ways of the cards, in degrees: cards of a request start together and end more or less apart
CARD_WAY = {"x1": "145e0+(od_id%1000)/1e4", "y1": "-38e0+(od_id%777)/1e4", "x2": "145.01e0+(od_id%1000)/1e4+((card*7+od_id)%5)*0.0007e0", "y2": "-37.995e0+(od_id%777)/1e4-((card*3+od_id)%4)*0.0005e0"}


def card_points(cards: DataFrame) -> DataFrame:
    """Cards with seven even points of their way."""
    e = {k: F.expr(v) for k, v in CARD_WAY.items()}
    line = F.array(F.struct(e["x1"].alias("x"), e["y1"].alias("y")), F.struct(e["x2"].alias("x"), e["y2"].alias("y")))
    return cards.withColumn("points", even_points(line, F.lit(LIKE_POINTS)))


def cards(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(CARDS, lineitem=table(spark, sf, "lineitem"))


def routes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per route with its line; a route has as many points as distinct line numbers.

    Order lines travel once, by route: points and lines are grouped where they are.
    """
    p = spark.sql(ROUTE_POINTS, lineitem=table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").repartition("l_orderkey"))
    r = p.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("p"))
    return r.select("route_id", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("line"))
