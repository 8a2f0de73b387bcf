"""Quality flags. Every rule set keeps all rows and adds flag columns.

A rule set is an ordered list of (condition, label); the first that holds wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import blank, col, composite_flag, first_label
from .ordering import spread_left_join

# Fixed values of the rule sets.
WIDTH_RANGE_M = (0.5, 6.0)
SPEED_RANGE_KMH = (10, 110)
GRAFFITI_TYPES = ("Offensive", "Non-Offensive")
AREA_MAX_M2 = 500
WATTAGE_MAX_W = 400
STATE_LAT = (-39.2, -33.9)
STATE_LNG = (140.9, 149.9)
UHI_RANGE = (-10, 20)
DENSITY_CLASSES = ("dense", "medium", "sparse")
PLACEHOLDERS = ("to be determined", "not applicable", "not appliable")
PLACEHOLDER_TYPES = ("to be determined", "not applicable")
NIGHT_LIGHT_CATEGORIES = ("dark_lighted", "dark_not_lighted")


def _word(c: str | Column) -> Column:
    return F.lower(F.trim(col(c)))


def with_flags(df: DataFrame, flags: dict[str, Column], composite: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Add part flags, then composites built from part flags in order."""
    out = df.withColumns(flags)
    if composite:
        out = out.withColumns({n: composite_flag(*parts) for n, parts in composite.items()})
    return out


def width_flag(c: str = "width_m") -> Column:
    w = col(c)
    return first_label([
        (w.isNull(), "missing"), (w == 0, "zero"),
        (w < WIDTH_RANGE_M[0], "too_narrow"), (w > WIDTH_RANGE_M[1], "too_wide"),
    ])


def speed_flags(limit: str = "speed_limit_kmh", length: str = "zone_length_m") -> dict[str, Column]:
    s, n = col(limit), col(length)
    return {
        "speed_qa_flag": first_label([
            (s.isNull(), "missing_limit"), (s < SPEED_RANGE_KMH[0], "below_range"), (s > SPEED_RANGE_KMH[1], "above_range"),
        ]),
        "length_qa_flag": first_label([(n.isNull(), "missing_length"), (n <= 0, "invalid_length")]),
    }


def graffiti_flags(kind: str, area: str, created: str, completed: str) -> dict[str, Column]:
    k, a, c, d = col(kind), col(area), col(created), col(completed)
    return {
        "type_qa_flag": first_label([(k.isNull(), "missing_type"), (~k.isin(*GRAFFITI_TYPES), "unknown_type")]),
        "date_qa_flag": first_label([(c.isNull(), "missing_created_date"), (d < c, "completed_before_created")]),
        "area_qa_flag": first_label([(a.isNull(), "missing_area"), (a < 0, "invalid_area"), (a > AREA_MAX_M2, "high_area")]),
    }


def wattage_flag(c: str | Column) -> Column:
    w = col(c)
    return first_label([(w.isNull(), "missing_wattage"), (w == 0, "zero_wattage"), (w > WATTAGE_MAX_W, "high_wattage")])


def text_wattage_flag(c: str) -> Column:
    """Wattage held as text: unreadable numbers count as fine, only an absent text is missing."""
    w = col(c).try_cast("double")
    return first_label([(col(c).isNull(), "missing_wattage"), (w == 0, "zero_wattage"), (w > WATTAGE_MAX_W, "high_wattage")])


def duplicate_key_flag(df: DataFrame, key: str, label: str, flag: str, out: str) -> DataFrame:
    """Overall flag where a repeated key overrides the part flag.

    Counts are made by partial aggregation, so one key with a third of all rows
    never meets in one task.
    """
    repeats = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("cnt")).filter("cnt > 1")
    repeats = repeats.withColumn("rep_", F.lit(True))
    joined = spread_left_join(df, repeats, key)
    return joined.withColumn(out, F.when(F.coalesce("rep_", F.lit(False)), label).otherwise(F.col(flag))).drop("rep_")


def light_category(c: str) -> Column:
    """Lighting text to a category; the order of the tests matters."""
    w = _word(c)

    def has(s: str) -> Column:
        return w.contains(s)

    return first_label([
        (blank(c), "missing"),
        (w.isin("day", "daylight"), "daylight"),
        (has("dawn") | has("dusk"), "dawn_dusk"),
        (has("lights on") | (has("lighted") & ~has("not")), "dark_lighted"),
        (has("not lighted") | has("lights off") | has("no street lights") | has("lights unknown") | has("dark"), "dark_not_lighted"),
    ], default="other")


def crash_flags(lat: str, lng: str, date: str, light: str) -> dict[str, Column]:
    y, x, cat = col(lat), col(lng), light_category(light)
    return {
        "coord_qa_flag": first_label([
            (y.isNull() | x.isNull(), "missing_coords"), ((y == 0) & (x == 0), "zero_coords"),
            (~y.between(*STATE_LAT) | ~x.between(*STATE_LNG), "out_of_vic_bounds"),
        ]),
        "date_qa_flag": first_label([(col(date).isNull(), "missing_date")]),
        "light_qa_flag": first_label([(cat == "missing", "missing_light"), (cat == "other", "unknown_light")]),
    }


# Fixed value pairs of the crash severity text.
SEVERITIES = {
    "FATAL ACCIDENT": "fatal", "SERIOUS INJURY ACCIDENT": "serious",
    "OTHER INJURY ACCIDENT": "minor", "NON INJURY ACCIDENT": "no_injury",
}


def severity(c: str) -> Column:
    w = F.upper(F.trim(col(c)))
    chain = first_label([(w == text, label) for text, label in SEVERITIES.items()], default="?")
    return F.when(w.isin(*SEVERITIES), chain).otherwise(_word(c))


def tree_flags(ew: str, ns: str, height: str, age: str) -> dict[str, Column]:
    none = (F.coalesce(col(ew), F.lit(0.0)) == 0) & (F.coalesce(col(ns), F.lit(0.0)) == 0)
    return {
        "canopy_qa_flag": F.when(none, "canopy_width_unpopulated").otherwise("canopy_width_present"),
        "height_qa_flag": first_label([(col(height).isNull(), "missing_height"), (col(height) == 0, "zero_height")]),
        "age_qa_flag": first_label([(blank(age), "missing_age"), (_word(age).isin(*PLACEHOLDERS), "placeholder_age")]),
    }


def density_flags(cls: str, area: str) -> dict[str, Column]:
    return {
        "density_qa_flag": first_label([(blank(cls), "missing_density"), (~_word(cls).isin(*DENSITY_CLASSES), "invalid_density")]),
        "area_qa_flag": first_label([(col(area).isNull() | (col(area) <= 0), "invalid_area")]),
    }


def heat_flag(c: str) -> Column:
    return first_label([(col(c).isNull(), "missing_uhi"), (~col(c).between(*UHI_RANGE), "outlier_uhi")])


def fountain_flags(condition: str, kind: str) -> dict[str, Column]:
    return {
        "condition_qa_flag": first_label([(blank(condition), "missing_condition"), (_word(condition).isin(*PLACEHOLDERS), "placeholder_condition")]),
        "type_qa_flag": first_label([(blank(kind), "missing_type"), (_word(kind).isin(*PLACEHOLDER_TYPES), "placeholder_type")]),
    }


def bench_flags(quantity: str, capacity: str, furncap: str) -> dict[str, Column]:
    return {
        "quantity_qa_flag": first_label([(blank(quantity), "missing_quantity"), (col(quantity).try_cast("int") == 0, "zero_quantity")]),
        "capacity_qa_flag": first_label([(blank(capacity), "missing_capacity"), (_word(capacity) == "tbd", "placeholder_capacity")]),
        "furncap_qa_flag": first_label([(col(furncap).isNull(), "missing_furncap"), (col(furncap) == 0, "zero_furncap")]),
        "qa_flag": F.lit("ok"),
    }


def missing_text_flag(c: str, label: str) -> Column:
    return first_label([(blank(c), label)])


def path_class(c: str) -> Column:
    return F.when(col(c) == "Shared Use Path", "shared_use").when(col(c) == "Footpath", "footpath").otherwise("other")


def digits(c: str) -> Column:
    """Whole number made of the digits in a text."""
    return F.nullif(F.regexp_replace(col(c), "[^0-9]", ""), F.lit("")).try_cast("int")
