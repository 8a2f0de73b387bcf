"""Walking graph tables: edges, costs, sidewalks and batch shortest paths."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.columns import col
from ..session import discard, settle
from .grid import box_point_pairs
from .ordering import top_k

# Fixed values of the cost model.
PATH_CLASSES = (
    "footway", "path", "pedestrian", "steps", "corridor", "bridleway", "track", "cycleway", "crossing", "sidewalk",
)
ROUTE_PATH_CLASSES = (*PATH_CLASSES, "service", "living_street")
ROAD_COST = {
    "living_street": 1.25, "service": 1.25, "residential": 1.75, "unclassified": 1.75, "tertiary": 1.85,
    "tertiary_link": 1.85, "secondary": 2.0, "secondary_link": 2.0, "primary": 2.0, "primary_link": 2.0,
    "trunk": 2.0, "trunk_link": 2.0, "motorway": 3.0, "motorway_link": 3.0,
}
ROAD_COST_DEFAULT = 1.6
AWAY_TRAILS = ("path", "cycleway", "track", "bridleway", "pedestrian")
AWAY_FOOTWAYS = ("footway", "steps", "corridor", "sidewalk")
AWAY_COST = {
    "living_street": 1.5, "service": 1.5, "residential": 2.5, "unclassified": 2.5, "tertiary": 2.8,
    "tertiary_link": 2.8, "secondary": 3.0, "secondary_link": 3.0, "primary": 3.0, "primary_link": 3.0,
    "trunk": 3.0, "trunk_link": 3.0, "motorway": 4.0, "motorway_link": 4.0,
}
AWAY_COST_DEFAULT = 2.4
AWAY_TRAIL_COST, AWAY_FOOTWAY_COST, AWAY_CROSSING_COST = 0.75, 1.45, 0.85
SIDEWALK_ROADS = (
    "residential", "unclassified", "living_street", "tertiary", "tertiary_link", "secondary", "secondary_link",
    "primary", "primary_link",
)
CENTRELINE_ROADS = (*SIDEWALK_ROADS, "trunk", "trunk_link", "motorway", "motorway_link")
MAX_DETOUR, MAX_DETOUR_AWAY, MAX_DETOUR_PATHISH, PATHISH_MIN = 1.15, 1.6, 1.20, 0.70
WALK_MPS = 1.3
CROSSING_REACH_M, CROSSING_LINKS = 22.0, 6
IMPORTANCE = (10, 100)


def road_class(c: str | Column) -> Column:
    """First tag of a class text, lower case, ``unknown`` when empty."""
    first = F.lower(F.trim(F.element_at(F.split(col(c), ";"), 1)))
    return F.coalesce(F.nullif(first, F.lit("")), F.lit("unknown"))


def _lookup(table: dict[str, float]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items()))


def class_multiplier(highway: str | Column, away: bool | Column = False) -> Column:
    """Cost per metre by class, in the normal or the away-from-roads mode."""
    hw = road_class(highway)
    normal = F.when(hw.isin(*PATH_CLASSES), 1.0).otherwise(F.coalesce(_lookup(ROAD_COST)[hw], F.lit(ROAD_COST_DEFAULT)))
    other = (
        F.when(hw.isin(*AWAY_TRAILS), AWAY_TRAIL_COST).when(hw == "crossing", AWAY_CROSSING_COST)
        .when(hw.isin(*AWAY_FOOTWAYS), AWAY_FOOTWAY_COST).otherwise(F.coalesce(_lookup(AWAY_COST)[hw], F.lit(AWAY_COST_DEFAULT)))
    )
    if isinstance(away, Column):
        return F.when(away, other).otherwise(normal)
    return other if away else normal


def norm_score(score: str | Column, p10, p90) -> Column:
    """0-1 between the network percentiles, 0.5 for a missing score."""
    s, lo, hi = col(score), p10 if isinstance(p10, Column) else F.lit(float(p10)), p90 if isinstance(p90, Column) else F.lit(float(p90))
    pos = (s - lo) / F.greatest(F.lit(1e-6), hi - lo)
    return F.when(s.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), pos)))


def edge_cost(length, score, p10, p90, highway, away: bool | Column = False, swing: float = 1.0) -> Column:
    return (
        F.greatest(F.lit(1.0), col(length)) * (1.0 + swing * (0.5 - norm_score(score, p10, p90))) * class_multiplier(highway, away)
    )


def importance(c: str | Column) -> Column:
    """Slider value clamped to the allowed band."""
    v = F.coalesce(F.rint(col(c).cast("double")), F.lit(float(IMPORTANCE[0])))
    return F.greatest(F.lit(float(IMPORTANCE[0])), F.least(F.lit(float(IMPORTANCE[1])), v))


def blended_norm(parts: list[tuple[Column, Column, Column, Column]]) -> Column:
    """Weighted mean of normalised streams; (score, p10, p90, weight); NULL when all are missing."""
    num = sum((F.when(s.isNull(), 0.0).otherwise(norm_score(s, lo, hi) * w) for s, lo, hi, w in parts), F.lit(0.0))
    den = sum((F.when(s.isNull(), 0.0).otherwise(w) for s, _, _, w in parts), F.lit(0.0))
    return F.when(den > 0, F.try_divide(num, den))


def preference_cost(length, highway, streams: list[tuple[Column, Column, Column, Column]], away: bool | Column = False, swing: float = 1.0, reused: Column | None = None, reuse: float = 3.0) -> Column:
    """Edge cost under a resident's weights; no stream at all leaves length and class."""
    s = F.coalesce(blended_norm(streams), F.lit(0.5))
    cost = F.greatest(F.lit(1.0), col(length)) * (1.0 + swing * (0.5 - s)) * class_multiplier(highway, away)
    return F.when(reused, cost * reuse).otherwise(cost) if reused is not None else cost


def contrast_preferences(mode: str | Column, acc: str | Column, shade: str | Column, dark: str | Column) -> dict[str, Column]:
    """Weights of the opposite walk: the dominant stream goes to the floor, the other to the top."""
    lo, hi = (float(v) for v in IMPORTANCE)
    night = col(mode) == "night"
    second = F.when(night, importance(dark)).otherwise(importance(shade))
    leads = second >= importance(acc)
    other = F.when(leads, lo).otherwise(hi)
    return {
        "alt_accessibility": F.when(leads, hi).otherwise(lo),
        "alt_shade": F.when(night, 0.0).otherwise(other),
        "alt_dark": F.when(night, other).otherwise(0.0),
        "alt_stream": F.when(leads, "accessibility").when(night, "afterDark").otherwise("shadeHeat"),
    }


def undirected_edges(pieces: DataFrame, ax: Column, ay: Column, bx: Column, by: Column, cost: str, digits: int, order: list[str]) -> DataFrame:
    """Vertex pairs to edges ``u < v``; loops dropped, the cheapest of parallel edges kept."""

    def node(x, y):
        return F.concat_ws("_", F.round(x, digits).cast("string"), F.round(y, digits).cast("string"))

    e = pieces.withColumn("a_", node(ax, ay)).withColumn("b_", node(bx, by)).filter("a_ <> b_")
    e = e.withColumns({"u": F.least("a_", "b_"), "v": F.greatest("a_", "b_")})
    rest = [c for c in e.columns if c not in ("a_", "b_", "u", "v")]
    return e.groupBy("u", "v").agg(F.min_by(F.struct(*rest), F.struct(cost, *order)).alias("e")).select("u", "v", "e.*")


def both_ways(edges: DataFrame) -> DataFrame:
    flip = edges.withColumns({"u": F.col("v"), "v": F.col("u")})
    return edges.unionByName(flip)


def node_table(edges: DataFrame, blend: Column, length: str = "length_m", highway: str = "highway") -> DataFrame:
    """Degree, path contact and length-weighted blend of the edges at every node."""
    w = F.greatest(F.lit(1.0), F.col(length))
    e = both_ways(edges).withColumns({"b_": blend, "w_": w})
    path = road_class(highway).isin(*[c for c in PATH_CLASSES if c != "crossing"])
    return e.groupBy(F.col("u").alias("node")).agg(
        F.count(F.lit(1)).alias("degree"), F.max(path).alias("on_paths"),
        F.try_divide(F.sum(F.col("b_") * F.col("w_")), F.sum(F.when(F.col("b_").isNotNull(), F.col("w_")))).alias("blend"))


def side_votes(pieces: DataFrame, way: str, street: str) -> DataFrame:
    """Side per way by length-weighted vote; a weak vote follows its street.

    Needs ``len`` and ``side`` (+1, -1 or NULL for no match).
    """
    weight = F.col("side") * F.col("len")
    per_way = pieces.groupBy(way, street).agg(F.sum(weight).alias("vote"), F.sum(F.when(F.col("side").isNotNull(), F.col("len"))).alias("m"))
    per_street = per_way.groupBy(street).agg(F.sum("vote").alias("sv"))
    weak = (F.abs("vote") < 0.6 * F.col("m")) & (F.col("sv") != 0)
    pick = F.when(weak, F.when(F.col("sv") >= 0, 1).otherwise(-1)).when(F.col("vote") >= 0, 1).otherwise(-1)
    return per_way.filter("vote IS NOT NULL").join(per_street, street).select(way, pick.alias("side"))


def sidewalk_edges(pieces: DataFrame, way: str, street: str, offset: float = 4.5, ring_skip: float = 150.0) -> DataFrame:
    """Road pieces with pavement alongside become sidewalk edges moved to the voted side.

    ``pieces``: way, ``i``, street, ends, ``len``, ``side`` (NULL = no pavement
    near), ``highway``. Gaps between the first and last match of a way are
    filled; short closed ways stay roads.
    """
    roads = pieces.filter(road_class("highway").isin(*SIDEWALK_ROADS))
    shape = roads.groupBy(way).agg(
        F.min_by(F.struct("x1", "y1"), F.col("i")).alias("a_"), F.max_by(F.struct(F.col("x2").alias("x1"), F.col("y2").alias("y1")), F.col("i")).alias("b_"),
        F.sum("len").alias("way_m"), F.min(F.when(F.col("side").isNotNull(), F.col("i"))).alias("lo"), F.max(F.when(F.col("side").isNotNull(), F.col("i"))).alias("hi"))
    ring = (F.col("a_") == F.col("b_")) & (F.col("way_m") < ring_skip)
    live = roads.join(shape.filter(~ring), way)
    sides = side_votes(live.select(way, street, "len", "side"), way, street).withColumnRenamed("side", "use_")
    conv = live.filter("i BETWEEN lo AND hi").join(sides, way)
    ex, ey = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    n = F.when(F.col("len") > 0, F.col("len")).otherwise(1.0)
    ox, oy = -ey / n * F.col("use_") * offset, ex / n * F.col("use_") * offset
    return conv.select(
        way, "i", road_class("highway").alias("sidewalk_of"), F.lit("sidewalk").alias("highway"), "len",
        (F.col("x1") + ox).alias("x1"), (F.col("y1") + oy).alias("y1"), (F.col("x2") + ox).alias("x2"), (F.col("y2") + oy).alias("y2"))


def rebuilt_graph(
    pieces: DataFrame, crossings: DataFrame, nodes: DataFrame, way: str, street: str, scores: tuple[str, str], bands: Column,
    reach: float = CROSSING_REACH_M, most: int = CROSSING_LINKS, offset: float = 4.5, ring_skip: float = 150.0,
) -> DataFrame:
    """The whole walking graph after sidewalks and crossings, one row per edge, every cost anew.

    ``pieces``: way, ``i``, street, nodes ``u, v``, ends ``x1..y2``, ``len``,
    ``side``, ``highway`` and the day and night ``scores``. Of parallel pieces
    the cheapest by day is the edge. An edge of a road class with a voted
    pavement along one of its pieces becomes a sidewalk: its line moves to that
    side (of the first way that votes), its length, nodes and scores stay. All
    other edges stay as they are. ``crossings`` (``node, px, py``) are linked to
    at most ``most`` of the ``nodes`` (``node, nx, ny``) within ``reach`` that
    touch a walking path once sidewalks are made; links that are edges already
    are left out, and new ones carry no scores. ``bands`` is a struct column
    with ``d1, d9, n1, n9``, the scores' percentiles.
    """
    day, night = scores

    def costs(df: DataFrame) -> DataFrame:
        b = df.withColumn("pq_", bands)
        return b.withColumns({
            "cost_day": edge_cost("length_m", day, F.col("pq_.d1"), F.col("pq_.d9"), "highway"),
            "cost_night": edge_cost("length_m", night, F.col("pq_.n1"), F.col("pq_.n9"), "highway"), "cost_distance": F.col("length_m")}).drop("pq_")

    ends = ["x1", "y1", "x2", "y2"]
    live = pieces.filter("u <> v").withColumns({"a_": F.least("u", "v"), "b_": F.greatest("u", "v"), "length_m": F.greatest(F.lit(1.0), F.col("len"))})
    kept = costs(live.select(way, "i", "a_", "b_", "highway", "length_m", *scores, *ends)).groupBy("a_", "b_").agg(
        F.min_by(F.struct(way, "i", "highway", "length_m", *scores, *ends), F.struct("cost_day", way, "i")).alias("e")).select(F.col("a_").alias("u"), F.col("b_").alias("v"), "e.*")
    moved = sidewalk_edges(live, way, street, offset, ring_skip).select(way, "i", *[F.col(c).alias(f"m{c}") for c in ends])
    moved = live.select(way, "i", F.col("a_").alias("u"), F.col("b_").alias("v")).join(moved, [way, "i"]).groupBy("u", "v").agg(
        F.min_by(F.struct(*[f"m{c}" for c in ends]), F.struct(way, "i")).alias("m_"))
    is_road = road_class("highway").isin(*SIDEWALK_ROADS)
    turned = kept.join(moved, ["u", "v"], "left").withColumn("turned_", F.col("m_").isNotNull() & is_road)
    base = turned.select(
        "u", "v", way, "i", F.when(F.col("turned_"), F.lit("sidewalk")).otherwise(F.col("highway")).alias("highway"), F.when(F.col("turned_"), road_class("highway")).alias("sidewalk_of"),
        F.lit(False).alias("synthetic"), "length_m", *scores, *[F.when(F.col("turned_"), F.col(f"m_.m{c}")).otherwise(F.col(c)).alias(c) for c in ends])
    base = settle(base, "graph")
    touch = both_ways(base.select("u", "v", "highway")).filter(road_class("highway").isin(*PATH_CLASSES)).select(F.col("u").alias("node")).distinct()
    boxes = nodes.join(touch, "node", "left_semi").select("node", "nx", "ny", *[F.col(a).alias(b) for a, b in (("nx", "minx"), ("ny", "miny"), ("nx", "maxx"), ("ny", "maxy"))])
    near = box_point_pairs(boxes, crossings.select(F.col("node").alias("cross"), "px", "py").distinct(), max(100.0, 4 * reach), reach)
    gap = F.round(geo.span(F.col("px") - F.col("nx"), F.col("py") - F.col("ny")), 6)
    near = near.withColumn("gap", gap).filter((F.col("gap") <= reach) & (F.col("cross") != F.col("node")))
    links = top_k(near, ["cross"], [F.col("gap"), F.col("node")], most)
    links = links.select(F.least("cross", "node").alias("u"), F.greatest("cross", "node").alias("v"), F.greatest(F.lit(1.0), F.col("gap")).alias("length_m"),
                         *[F.when(F.col("cross") < F.col("node"), F.col(a)).otherwise(F.col(b)).alias(c) for a, b, c in (("px", "nx", "x1"), ("py", "ny", "y1"), ("nx", "px", "x2"), ("ny", "py", "y2"))])
    links = links.dropDuplicates(["u", "v"]).join(base.select("u", "v"), ["u", "v"], "left_anti")
    links = links.withColumns({"highway": F.lit("crossing"), "synthetic": F.lit(True)})
    return costs(base.unionByName(links, allowMissingColumns=True))


def batch_paths(edges: DataFrame, requests: DataFrame, key: Sequence[str] = ("od_id",), kind: Sequence[str] = (), overlay: DataFrame | None = None) -> DataFrame:
    """Cheapest path cost per request (``key, src, dst``) over ``edges(u, v, cost)``.

    Labels (request, node, cost, previous node) relax along the edges for all
    requests at once, until no label improves, however many edges a path has. A
    label that already costs more than the best known arrival of its request is
    dropped, so the search stays inside the radius of the answer. Only labels
    that changed in the last step travel. Each step's state is written to the
    shared folder, and the state before it is dropped.

    ``kind`` names the columns of ``key`` that edges have too: a request walks
    only edges of its kind, so searches under several costs run as one.
    ``overlay`` (``key, u, v, factor``) makes single edges dearer for single
    requests: the edge table stays shared, and only the small overlay is joined
    to the labels that are about to use one of its edges.
    """
    key, kind = list(key), list(kind)
    arcs = settle(both_ways(edges.select(*kind, "u", "v", "cost")).groupBy(*kind, "u", "v").agg(F.min("cost").alias("cost")), "arcs")
    dear = settle(both_ways(overlay.select(*key, "u", "v", "factor")).distinct(), "overlay") if overlay is not None else None
    labels = requests.select(*key, F.col("src").alias("node"), F.lit(0.0).alias("g"), F.lit(None).cast(requests.schema["src"].dataType).alias("prev"), F.lit(0).alias("round"))
    labels = settle(labels, "labels")
    goals = settle(requests.select(*key, F.col("dst").alias("node")), "goals")
    step = 0
    while not labels.filter(F.col("round") == step).isEmpty():
        step += 1
        old, labels = labels, settle(_relax(labels, arcs, goals, step, key, kind, dear), "labels")
        discard(old)
    return labels


def _relax(labels: DataFrame, arcs: DataFrame, goals: DataFrame, step: int, key: list[str], kind: list[str], dear: DataFrame | None) -> DataFrame:
    """One more edge for every label of the step before."""
    front = labels.filter(F.col("round") == step - 1).select(*key, F.col("node").alias("u"), "g")
    best = labels.join(goals, [*key, "node"]).select(*key, F.col("g").alias("best_"))
    grown = front.join(arcs, [*kind, "u"])
    cost = F.col("cost")
    if dear is not None:
        grown = grown.join(dear, [*key, "u", "v"], "left")
        cost = cost * F.coalesce("factor", F.lit(1.0))
    grown = (
        grown.select(*key, F.col("v").alias("node"), (F.col("g") + cost).alias("g"), F.col("u").alias("prev"))
        .join(best, key, "left").filter(F.col("best_").isNull() | (F.col("g") < F.col("best_"))).drop("best_")
        .withColumn("round", F.lit(step))
    )
    # an old label wins a tie, so nothing is relaxed twice at the same cost
    return labels.unionByName(grown).groupBy(*key, "node").agg(
        F.min_by(F.struct("g", "prev", "round"), F.struct("g", "round", "prev")).alias("l")).select(*key, "node", "l.*")


def trace_paths(labels: DataFrame, requests: DataFrame, key: Sequence[str] = ("od_id",)) -> DataFrame:
    """Edges of each found path, counted back from the goal to its start: key, hop, u, v.

    A request whose goal is its start, or was not reached, has no edges. Jumps
    of 1, 2, 4, ... edges are made by joining each with itself, then the goal is
    spread over them from the longest down, so jobs grow with the logarithm of
    the longest path. Labels that lead to no goal's path stay in the jumps; they
    are as many as the search kept.
    """
    key = list(key)
    goals = requests.join(labels.select(*key, F.col("node").alias("dst")), [*key, "dst"]).select(*key, F.col("dst").alias("node"), F.lit(0).alias("hop"))
    first = settle(labels.filter("prev IS NOT NULL").select(*key, "node", F.col("prev").alias("up")), "jump")
    jumps = [first]
    while not jumps[-1].isEmpty():
        half = jumps[-1]
        jumps.append(settle(half.join(half.select(*key, F.col("node").alias("up"), F.col("up").alias("top")), [*key, "up"]).select(*key, "node", F.col("top").alias("up")), "jump"))
    on_path = settle(goals, "on-path")
    for power in range(len(jumps) - 2, -1, -1):
        ahead = on_path.join(jumps[power], [*key, "node"]).select(*key, F.col("up").alias("node"), (F.col("hop") + (1 << power)).alias("hop"))
        on_path = settle(on_path.unionByName(ahead), "on-path")
    hops = settle(on_path.join(first, [*key, "node"]).select(*key, "hop", F.col("up").alias("u"), F.col("node").alias("v")), "hops")
    for jump in jumps:
        discard(jump)
    return hops


def used_edges(hops: DataFrame, key: Sequence[str] = ("od_id",)) -> DataFrame:
    """Edges of paths whichever way they were walked, once each: key, u, v with u < v."""
    return hops.select(*key, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def circuits(edges: DataFrame, loops: DataFrame) -> DataFrame:
    """Walks start - a - b - start, each leg shunning the edges of the legs before it.

    ``loops``: ``od_id, variant, start, a, b, factor``; a used edge costs
    ``factor`` times as much, a null factor leaves it alone. All loops and
    variants of a leg are one search. Returns the hops of every leg: ``od_id,
    variant, leg, hop, u, v``; a loop that a leg cannot close keeps the legs
    before that one.
    """
    key = ["od_id", "variant"]
    stops = ["start", "a", "b", "start"]
    walked = None
    for leg in range(3):
        asked = loops.select(*key, F.col(stops[leg]).alias("src"), F.col(stops[leg + 1]).alias("dst"))
        if walked is None:
            dear = None
        else:
            done = walked.filter(F.col("leg") == leg).select(*key).distinct()
            asked = asked.join(done, key, "left_semi") if leg else asked
            dear = used_edges(walked, key).join(loops.filter("factor IS NOT NULL").select(*key, F.col("factor").cast("double").alias("factor")), key)
        labels = batch_paths(edges, asked, key, overlay=dear)
        hops = trace_paths(labels, asked, key).withColumn("leg", F.lit(leg + 1))
        discard(labels)
        walked = hops if walked is None else walked.unionByName(hops)
    return walked.select(*key, "leg", "hop", "u", "v")


def path_measures(hops: DataFrame, arcs: DataFrame, key: Sequence[str], kind: Sequence[str] = ()) -> DataFrame:
    """Length, time, edges and share on walking classes of each path; ``arcs``: ``u, v, length_m, hw``."""
    p = hops.join(arcs, [*kind, "u", "v"])
    total = F.sum("length_m")
    share = F.sum(F.when(F.col("hw").isin(*ROUTE_PATH_CLASSES), F.col("length_m")).otherwise(0.0)) / total
    return p.groupBy(*key).agg(total.alias("distance_m"), (total / WALK_MPS).alias("duration_s"), F.count(F.lit(1)).alias("n_edges"), share.alias("pathish_share"))


def leg_report(hops: DataFrame, arcs: DataFrame) -> DataFrame:
    """Edges, metres, and metres on edges of earlier legs, for each leg of each loop and variant."""
    key = ["od_id", "variant"]
    legs = hops.select(*key, "leg", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).join(arcs.filter("u < v").select("u", "v", "length_m"), ["u", "v"])
    seen = legs.groupBy(*key, "u", "v").agg(F.min("leg").alias("first_leg"))
    again = F.when(F.col("first_leg") < F.col("leg"), F.col("length_m")).otherwise(0.0)
    return legs.join(seen, [*key, "u", "v"]).groupBy(*key, "leg").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("length_m").alias("distance_m"), F.sum(again).alias("reused_m"))


def circuit_report(hops: DataFrame, arcs: DataFrame, band_s: tuple[float, float]) -> DataFrame:
    """One row per loop and variant whose three legs close: time, whether it is in the band, metres walked before, and metres that two legs share."""
    key = ["od_id", "variant"]
    legs = hops.select(*key, "leg", "hop", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).join(arcs.filter("u < v").select("u", "v", "length_m"), ["u", "v"])
    per_edge = legs.groupBy(*key, "u", "v").agg(
        F.first("length_m").alias("length_m"), F.count(F.lit(1)).alias("walks"), *[F.max(F.when(F.col("leg") == k, 1).otherwise(0)).alias(f"l{k}") for k in (1, 2, 3)])
    shared = {f"overlap_{a}{b}_m": F.sum(F.when((F.col(f"l{a}") == 1) & (F.col(f"l{b}") == 1), F.col("length_m")).otherwise(0.0)) for a, b in ((1, 2), (2, 3), (1, 3))}
    total = F.sum(F.col("length_m") * F.col("walks"))
    out = per_edge.groupBy(*key).agg(
        total.alias("distance_m"), (F.sum(F.col("length_m") * (F.col("walks") - 1)) / total).alias("revisit_ratio"), *[v.alias(k) for k, v in shared.items()], *[F.max(f"l{k}").alias(f"l{k}") for k in (1, 2, 3)])
    duration = F.col("distance_m") / WALK_MPS
    return out.filter("l1 = 1 AND l2 = 1 AND l3 = 1").select(*key, "distance_m", duration.alias("duration_s"), duration.between(*band_s).alias("in_band"), "revisit_ratio", *shared)


def drawn_routes(arcs: DataFrame, requests: DataFrame, away_factor: float = 3.0) -> DataFrame:
    """The route to draw for each request, chosen among searched ones.

    ``arcs``: ``kind, u, v, cost, length_m, hw``, one way each, with kinds
    ``distance``, ``quality`` and one per profile. ``requests``: ``od_id, src,
    dst, profile, base, away, cap``. Each request is searched by distance, by
    quality and under its profile; one that keeps away from roads is first
    searched under its ``base`` profile, and the edges of that path cost
    ``away_factor`` as much in the search under its own.

    Returns ``od_id, kept, distance_m, detour, pathish_share``: the profile's
    route if its detour is within the cap (or it is mostly on paths), else the
    base route for those who keep away, else the quality route. Requests without
    a path have no row.
    """
    key = ["od_id", "kind"]
    edges = arcs.select("kind", "u", "v", "cost")
    plain = requests.select("od_id", "src", "dst", F.explode(F.array(F.lit("distance"), F.lit("quality"), F.when(F.col("away"), F.col("base")).otherwise(F.col("profile")))).alias("kind"))
    labels = batch_paths(edges, plain, key, ["kind"])
    first = trace_paths(labels, plain, key)
    discard(labels)
    shy = requests.filter("away").select("od_id", "src", "dst", F.col("profile").alias("kind"), F.col("base"))
    dear = used_edges(first, key).withColumnRenamed("kind", "base").join(shy.select("od_id", "kind", "base"), ["od_id", "base"]).select("od_id", "kind", "u", "v", F.lit(away_factor).alias("factor"))
    labels = batch_paths(edges, shy, key, ["kind"], dear)
    second = trace_paths(labels, shy, key)
    discard(labels)
    lengths = arcs.select("kind", "u", "v", "length_m", "hw")
    drawn = path_measures(first.unionByName(second), lengths, key, ["kind"])

    def as_(name: str, kind: Column) -> DataFrame:
        return requests.select("od_id", kind.alias("kind")).join(drawn, key).select("od_id", F.struct("distance_m", "pathish_share").alias(name))

    own, away = F.col("profile"), F.col("away")
    out = requests.select("od_id", "away", "cap").join(as_("score", own), "od_id").join(as_("shortest", F.lit("distance")), "od_id").join(as_("quality", F.lit("quality")), "od_id")
    out = out.join(as_("default", F.when(away, F.col("base"))), "od_id", "left")
    detour = F.col("score.distance_m") / F.greatest(F.col("shortest.distance_m"), F.lit(1.0))
    out = out.withColumn("kept", choose_route(detour, F.col("score.pathish_share"), F.col("cap"), away))
    out = out.withColumn("kept", F.when(F.col("kept") == "score", "score").when(away & F.col("default").isNotNull(), "default").otherwise("quality"))
    route = F.when(F.col("kept") == "score", F.col("score")).when(F.col("kept") == "default", F.col("default")).otherwise(F.col("quality"))
    return out.select("od_id", "kept", route["distance_m"].alias("distance_m"), detour.alias("detour"), route["pathish_share"].alias("pathish_share"))


def choose_route(detour: Column, pathish: Column, cap: Column | float, away: Column) -> Column:
    """Which of the drawn routes to keep: ``score``, or ``fallback`` when the detour is too long."""
    keep = (pathish >= PATHISH_MIN) & (detour <= MAX_DETOUR_PATHISH) & ~away
    return F.when(detour <= cap, "score").when(F.coalesce(keep, F.lit(False)), "score").otherwise("fallback")
