"""How the star-schema tables stand in for city layers.

The tables hold no geometry, so coordinates come from keys by modular
arithmetic on a 10 km square. Each layer is one list of SQL expressions that
means the same in Spark and in the check engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo

RUN_DATE = "2001-08-01"
EVENTS_RUN_DATE = "2024-01-31"

SURFACES = (
    "Concrete", "Reinforced Concrete", "Asphalt - DGA", "Spray Seal", "Brick Paving",
    "Class 2 Crushed Rock", "Timber", "Gravel", "Rubber", "To be determined",
)


def _pos(key: str, a: int = 7919, b: int = 6389, c: int = 17) -> dict[str, str]:
    return {"x": f"(({key}*{a})%100003)/10", "y": f"(({key}*{b}+{c})%99991)/10"}


_surface = "CASE " + " ".join(f"WHEN p_partkey%11={i} THEN '{s}'" for i, s in enumerate(SURFACES)) + " END"
_hx, _hy = "(20+(p_partkey%97)*10)/2", "(2+p_size/10)/2"
_sx, _sy = "((p_partkey*7919)%100003)/10", "((p_partkey*6389+17)%99991)/10"
_line_dx, _line_dy = "((c_custkey%41)*10-200)", "((c_custkey%37)*10-180)"
_cx, _cy = "((c_custkey*7919)%100003)/10", "((c_custkey*6389+17)%99991)/10"
_lkey = "(l_orderkey*8+l_linenumber)"

# layer -> (table, {column: expression})
LAYERS: dict[str, tuple[str, dict[str, str]]] = {
    "segments": ("part", {
        "segment_id": "p_partkey",
        "t1key": "CASE WHEN p_partkey%13=0 THEN NULL ELSE p_partkey%1700 END",
        "feature_type": "CASE p_type WHEN 'STANDARD' THEN 'Footpath' WHEN 'SMALL' THEN 'Footpath' WHEN 'MEDIUM' THEN 'Footpath' "
                        "WHEN 'LARGE' THEN 'Shared Use Path' WHEN 'PROMO' THEN 'Shared Use Path' ELSE 'Ramp' END",
        "walk_path_class": "CASE p_type WHEN 'STANDARD' THEN 'footpath' WHEN 'SMALL' THEN 'footpath' WHEN 'MEDIUM' THEN 'footpath' "
                           "WHEN 'LARGE' THEN 'shared_use' WHEN 'PROMO' THEN 'shared_use' ELSE 'other' END",
        "surface_material": _surface,
        "width_m": "CASE WHEN p_partkey%11=0 THEN NULL WHEN p_partkey%23=0 THEN 0.0e0 WHEN p_partkey%29=0 THEN 7.5e0 "
                   "WHEN p_partkey%31=0 THEN 0.3e0 ELSE 0.55e0+p_size*0.05e0 END",
        "length_m": "CAST(20+(p_partkey%97)*10 AS DOUBLE)",
        "suburb": "CASE WHEN p_partkey%17=0 THEN NULL ELSE p_brand END",
        "ward": "p_type",
        "x": _sx, "y": _sy,
        "minx": f"{_sx}-{_hx}", "miny": f"{_sy}-{_hy}", "maxx": f"{_sx}+{_hx}", "maxy": f"{_sy}+{_hy}",
    }),
    "speed_zones": ("customer", {
        "zone_id": "c_custkey",
        "speed_limit_kmh": "CASE WHEN c_custkey%11=0 THEN NULL WHEN c_custkey%17=0 THEN 5 WHEN c_custkey%19=0 THEN 130 ELSE 40+10*(c_nationkey%7) END",
        "zone_length_m": "CASE WHEN c_custkey%13=0 THEN NULL WHEN c_custkey%7=0 THEN 0.0e0 ELSE c_acctbal END",
        "road_type": "c_mktsegment",
        "x1": _cx, "y1": _cy, "x2": f"{_cx}+{_line_dx}", "y2": f"{_cy}+{_line_dy}",
    }),
    "graffiti": ("orders", {
        "record_id": "o_orderkey",
        "graffiti_type": "CASE WHEN o_orderkey%11=0 THEN NULL WHEN o_orderpriority='1-URGENT' THEN 'Offensive' "
                         "WHEN o_orderpriority='5-LOW' THEN 'Other' ELSE 'Non-Offensive' END",
        "created_date": "CASE WHEN o_orderkey%19=0 THEN NULL ELSE CAST(o_orderdate AS DATE) END",
        "days_to_remove": "CASE WHEN o_orderstatus='O' THEN NULL ELSE CAST(o_orderkey%9-1 AS INTEGER) END",
        "area_removed_m2": "CASE WHEN o_orderkey%29=0 THEN NULL WHEN o_orderkey%31=0 THEN -1.0e0 ELSE o_totalprice/900 END",
        **_pos("o_orderkey", 3571, 2741, 29),
    }),
    "crashes": ("orders", {
        "crash_id": "o_orderkey",
        "crash_date": "CASE WHEN o_orderkey%19=0 THEN NULL ELSE CAST(o_orderdate AS DATE) END",
        "light_condition": "CASE o_orderkey%10 WHEN 0 THEN NULL WHEN 1 THEN 'Day' WHEN 2 THEN ' daylight ' WHEN 3 THEN 'Dusk/Dawn' "
                           "WHEN 4 THEN 'Dark Street lights on' WHEN 5 THEN 'Dark, lighted' WHEN 6 THEN 'Dark not lighted' "
                           "WHEN 7 THEN 'Dark No street lights' WHEN 8 THEN 'dark' ELSE 'Unknown' END",
        "latitude": "CASE WHEN o_orderkey%23=0 THEN NULL WHEN o_orderkey%37=0 THEN 0.0e0 ELSE -38.5e0+((o_orderkey*7)%1000)/500 END",
        "longitude": "CASE WHEN o_orderkey%23=0 THEN NULL WHEN o_orderkey%37=0 THEN 0.0e0 WHEN o_orderkey%41=0 THEN 151.5e0 ELSE 144.5e0+(o_orderkey%997)/500 END",
        "severity_raw": "CASE o_orderpriority WHEN '1-URGENT' THEN ' Fatal Accident ' WHEN '2-HIGH' THEN 'SERIOUS INJURY ACCIDENT' WHEN '3-MEDIUM' THEN 'Other Injury Accident' "
                        "WHEN '4-NOT SPECIFIED' THEN 'NON INJURY ACCIDENT' ELSE 'Unrecorded' END",
        "night_eligible": "o_orderstatus='F'",
        **_pos("o_orderkey", 3571, 2741, 29),
    }),
    "lights": ("lineitem", {
        "light_id": _lkey,
        "wattage_w": "CASE WHEN l_partkey%11=0 THEN NULL WHEN l_partkey%13=0 THEN 0.0e0 ELSE l_quantity*10 END",
        "provider": "l_returnflag",
        "px": f"(({_lkey}*3571)%100003)/10", "py": f"(({_lkey}*2741+29)%99991)/10",
    }),
    "trees": ("lineitem", {
        "asset_number": _lkey,
        "tree_type": "CASE l_returnflag WHEN 'A' THEN 'Street Tree' WHEN 'N' THEN 'Park Tree' ELSE 'Reserve Tree' END",
        "tree_height_m": "CASE WHEN l_partkey%17=0 THEN NULL WHEN l_partkey%7=0 THEN 0.0e0 ELSE l_quantity/2 END",
        "canopy_ew_width_m": "CASE WHEN l_suppkey%3=0 THEN NULL WHEN l_suppkey%3=1 THEN 0.0e0 ELSE l_quantity/4 END",
        "canopy_ns_width_m": "CASE WHEN l_suppkey%5=0 THEN NULL ELSE 0.0e0 END",
        "tree_age": "CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN ' ' WHEN 3 THEN 'To Be Determined' WHEN 4 THEN 'Not appliable' ELSE 'Mature' END",
        "px": f"(({_lkey}*4463)%100003)/10", "py": f"(({_lkey}*5279+41)%99991)/10",
    }),
    "fountains": ("supplier", {
        "gisfid": "s_suppkey",
        "condition": "CASE s_suppkey%5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'To be determined' WHEN 3 THEN 'Not Applicable' ELSE 'Good' END",
        "dftype": "CASE s_suppkey%7 WHEN 0 THEN NULL WHEN 1 THEN 'Not applicable' WHEN 2 THEN 'not appliable' ELSE 'Bubbler' END",
        "px": "((s_suppkey*3571)%100003)/10", "py": "((s_suppkey*2741+29)%99991)/10",
    }),
    "school_crossings": ("supplier", {
        "gisfid": "s_suppkey",
        "name_of_school": "CASE s_suppkey%6 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE s_name END",
        "streetname": "CASE s_suppkey%4 WHEN 0 THEN '' ELSE s_name END",
        "px": "((s_suppkey*6007)%100003)/10", "py": "((s_suppkey*8191+13)%99991)/10",
    }),
    "benches": ("customer", {
        "gisfid": "c_custkey",
        "quantity": "CASE c_custkey%5 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN '0' WHEN 3 THEN 'two' ELSE '2' END",
        "capacity": "CASE c_custkey%4 WHEN 0 THEN NULL WHEN 1 THEN ' TBD ' ELSE '3' END",
        "furncap": "CASE c_custkey%3 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 4 END",
        "px": "((c_custkey*1999)%100003)/10", "py": "((c_custkey*4007+7)%99991)/10",
    }),
    "park_lights": ("customer", {
        "gisfid": "c_custkey",
        "luminwatt": "CASE c_custkey%6 WHEN 0 THEN NULL WHEN 1 THEN '0' WHEN 2 THEN '500' WHEN 3 THEN 'n/a' ELSE '70.5' END",
        "px": "((c_custkey*2999)%100003)/10", "py": "((c_custkey*6007+11)%99991)/10",
    }),
    "features": ("orders", {
        "segment_id": "o_orderkey",
        "walk_path_class": "CASE o_orderkey%3 WHEN 0 THEN 'footpath' WHEN 1 THEN 'shared_use' ELSE 'other' END",
        "width_m": "CASE WHEN o_orderkey%11=0 THEN NULL WHEN o_orderkey%23=0 THEN 0.0e0 ELSE 0.3e0+(o_orderkey%63)*0.1e0 END",
        "width_qa_flag": "CASE WHEN o_orderkey%11=0 THEN 'missing' WHEN o_orderkey%23=0 THEN 'zero' WHEN o_orderkey%63<2 THEN 'too_narrow' WHEN o_orderkey%63>57 THEN 'too_wide' ELSE 'ok' END",
        "surface_material": "CASE o_orderkey%8 WHEN 0 THEN NULL WHEN 1 THEN 'Concrete' WHEN 2 THEN 'Spray Seal' WHEN 3 THEN 'Timber' WHEN 4 THEN 'Gravel' WHEN 5 THEN 'To be determined' WHEN 6 THEN 'Not Applicable' ELSE 'Granite' END",
        "speed_corridor_max_kmh": "CASE WHEN o_custkey%7=0 THEN NULL ELSE 30+5*(o_custkey%17) END",
        "speed_corridor_line_m": "CASE WHEN o_custkey%7=0 THEN NULL ELSE (o_orderkey%40)*0.7e0 END",
        "graffiti_count_25m": "CASE WHEN o_orderkey%5=0 THEN 0 ELSE o_custkey%6 END",
        "graffiti_count_25m_365d": "CASE WHEN o_orderkey%5=0 OR o_custkey%6=0 THEN 0 ELSE o_orderkey%3 END",
        "graffiti_days_since_last": "CASE WHEN o_orderkey%5=0 OR o_orderkey%19=0 THEN NULL ELSE o_orderkey%1500 END",
        "school_crossing_within_20m": "CASE WHEN o_orderkey%31=0 THEN NULL ELSE o_orderkey%9=0 END",
        "school_crossing_within_50m": "CASE WHEN o_orderkey%31=0 THEN NULL ELSE o_orderkey%9<4 END",
        "uhi18_m": "CASE WHEN o_orderkey%8=0 THEN NULL ELSE floor(o_totalprice/500)/100 END",
        "uhi_join_method": "CASE WHEN o_orderkey%8=0 THEN 'missing' WHEN o_orderkey%12=1 THEN 'nearest' ELSE 'intersection' END",
        "canopy_dense_pct": "CASE WHEN o_orderkey%4=0 THEN 0.0e0 ELSE (o_custkey%40)*1.1e0 END",
        "canopy_medium_pct": "CASE WHEN o_orderkey%4=0 THEN 0.0e0 ELSE (o_custkey%23)*0.9e0 END",
        "canopy_sparse_pct": "CASE WHEN o_orderkey%4=0 THEN NULL ELSE (o_custkey%13)*0.03e0 END",
        "canopy_cover_pct": "CASE WHEN o_orderkey%4=0 THEN 0.0e0 ELSE (o_custkey%40)*1.1e0+(o_custkey%23)*0.9e0+(o_custkey%13)*0.03e0 END",
        "fountain_nearest_m": "CASE WHEN o_orderkey%13=0 THEN NULL ELSE (o_orderkey%500)*1.3e0 END",
        "bench_count_50m": "CASE WHEN o_orderkey%17=0 THEN NULL ELSE o_orderkey%4 END",
        "bench_nearest_m": "CASE WHEN o_orderkey%29=0 THEN NULL ELSE (o_orderkey%220)*1.0e0 END",
        "streetlight_nearest_m": "CASE WHEN o_orderkey%6=0 THEN NULL ELSE (o_orderkey%97)*0.61e0 END",
        "park_light_nearest_m": "CASE WHEN o_orderkey%10<7 THEN NULL ELSE (o_custkey%89)*0.83e0 END",
        "streetlight_count_30m": "CASE WHEN o_orderkey%6=0 THEN 0 ELSE o_custkey%9 END",
        "park_light_count_50m": "CASE WHEN o_orderkey%10<7 THEN NULL ELSE o_custkey%3 END",
        "length_m": "CAST(20+(o_orderkey%97)*10 AS DOUBLE)",
        "crash_ped_count_25m": "CASE WHEN o_orderkey%3=0 THEN 0 ELSE o_custkey%4 END",
        "crash_night_count_25m_5y": "CASE WHEN o_orderkey%3=0 THEN NULL WHEN o_custkey%4<2 THEN 0 ELSE o_custkey%4 END",
        "crossing_flag": "CASE WHEN o_orderkey%31=0 OR o_orderkey%9>=4 THEN 'gap' ELSE 'ok' END",
        "score_eligible": "CASE WHEN o_orderkey%41=0 THEN NULL ELSE o_orderkey%43<>0 END",
        "suburb": "o_orderpriority", "ward": "o_orderstatus",
    }),
    "areas": ("nation", {
        "area_id": "n_nationkey", "area_name": "n_name", "region_id": "n_regionkey",
        "uhi18_m": "CASE WHEN n_nationkey%12=11 THEN NULL ELSE n_nationkey/5-1 END",
        "veg_pct": "CAST(n_nationkey*3 AS DOUBLE)",
        "tree_density": "CASE n_nationkey%4 WHEN 0 THEN 'Dense' WHEN 1 THEN 'medium' WHEN 2 THEN 'Sparse' ELSE 'bare' END",
        "minx": "CAST((n_nationkey%5)*2000 AS DOUBLE)", "miny": "CAST(FLOOR(n_nationkey/5)*2000 AS DOUBLE)",
        "maxx": "CAST((n_nationkey%5)*2000+2000 AS DOUBLE)", "maxy": "CAST(FLOOR(n_nationkey/5)*2000+2000 AS DOUBLE)",
    }),
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def layer(spark: SparkSession, sf: str, name: str) -> DataFrame:
    src, cols = LAYERS[name]
    return table(spark, sf, src).selectExpr(*[f"{e} AS {c}" for c, e in cols.items()])


def cte(*names: str) -> str:
    """The same layers as common table expressions."""
    parts = []
    for n in names:
        src, cols = LAYERS[n]
        parts.append(f"{n} AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in cols.items()) + f" FROM {src})")
    return "WITH " + ",\n".join(parts) + "\n"


def segment_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Segments with their outline as a ring."""
    return layer(spark, sf, "segments").withColumn("ring", geo.box_ring("minx", "miny", "maxx", "maxy"))


def zone_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Speed zones with the box of their single piece."""
    return layer(spark, sf, "speed_zones").select(
        "*",
        F.least("x1", "x2").alias("rminx"), F.least("y1", "y2").alias("rminy"),
        F.greatest("x1", "x2").alias("rmaxx"), F.greatest("y1", "y2").alias("rmaxy"),
    )
