"""Writers. All write in parallel except reports of a few rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .wkb import parts_to_wkb, to_wkb


def write_geo_parquet(df: DataFrame, path: str, coords: str, kind: int) -> None:
    df.withColumn("geometry", to_wkb(F.col(coords), F.lit(kind))).drop(coords).write.mode("overwrite").parquet(path)


def write_geo_parts(df: DataFrame, path: str, parts: str, kind: Column) -> None:
    """Any geometries as WKB: ``parts`` of rings of coordinates, of a kind per row."""
    df.withColumn("geometry", parts_to_wkb(F.col(parts), kind)).drop(parts).write.mode("overwrite").parquet(path)


def feature_json(geometry: Column, properties: list[str]) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")))


def write_feature_lines(df: DataFrame, path: str, geometry: Column, properties: list[str], gzip: bool = False) -> None:
    """GeoJSON features, one compact object per line."""
    w = df.select(feature_json(geometry, properties).alias("value")).write.mode("overwrite")
    (w.option("compression", "gzip") if gzip else w).text(path)


def write_union_csv(parts: list[DataFrame], path: str) -> None:
    """Tables with different columns in one CSV whose header is the union of all columns."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    both.select(*sorted(both.columns)).write.mode("overwrite").option("header", True).csv(path)


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str] | None = None, batch: int = 500) -> None:
    """Truncate and load a database table in batches."""
    w = df.write.format("jdbc").option("url", url).option("dbtable", table).option("truncate", "true").option("batchsize", batch)
    for k, v in (properties or {}).items():
        w = w.option(k, v)
    w.mode("overwrite").save()


def load_check(df: DataFrame, eligible: str, version: str, stamp: str) -> DataFrame:
    """Figures to compare after a load."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(eligible).alias("n_eligible"), F.min(version).alias("min_version"), F.max(version).alias("max_version"), F.max(stamp).alias("last_loaded"))


def write_report(one_row: DataFrame, path: str) -> None:
    """A report of one row as a single JSON object."""
    one_row.select(F.to_json(F.struct(*one_row.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)
