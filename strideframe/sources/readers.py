"""Layer files as DataFrames. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..functions import geo
from .wkb import only_ring, parts_from_wkb

POSITION = "array<double>"


def read_feature_lines(spark: SparkSession, path: str, properties: str, coordinates: str = POSITION) -> DataFrame:
    """GeoJSON with one feature per line; splits, so any size reads in parallel."""
    schema = f"type string, geometry struct<type:string,coordinates:{coordinates}>, properties struct<{properties}>"
    return spark.read.schema(schema).json(path).filter("geometry IS NOT NULL").select("properties.*", "geometry")


def read_feature_collection(spark: SparkSession, path: str, properties: str, coordinates: str = POSITION) -> DataFrame:
    """Ordinary GeoJSON documents, one or more files; a document does not split, so land large ones as lines."""
    feature = f"struct<type:string,geometry:struct<type:string,coordinates:{coordinates}>,properties:struct<{properties}>>"
    docs = spark.read.schema(f"type string, features array<{feature}>").option("multiLine", True).json(path)
    return docs.select(F.explode("features").alias("f")).filter("f.geometry IS NOT NULL").select("f.properties.*", "f.geometry")


def read_csv_text(spark: SparkSession, path: str, columns: list[str], header: bool = True) -> DataFrame:
    """CSV, every column as text, rows with a wrong number of fields skipped."""
    schema = StructType()
    for c in columns:
        schema = schema.add(c, StringType())
    return (
        spark.read.schema(schema).option("header", header).option("mode", "DROPMALFORMED").option("columnPruning", False).csv(path)
    )


def read_geo_parquet(spark: SparkSession, path: str, metric: bool = False) -> DataFrame:
    """Parquet with WKB geometries of one part and one ring in degrees; ``coords`` in degrees or metres.

    Geometries with holes or several parts raise; ``read_geo_parts`` reads them.
    """
    df = spark.read.parquet(path).withColumn("coords", only_ring(parts_from_wkb("geometry"))).drop("geometry")
    if not metric:
        return df
    return df.withColumn("coords", F.transform("coords", lambda p: geo.to_metric(p["x"], p["y"])))


def read_geo_parts(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with any WKB ``geometry``: ``parts`` of rings of coordinates, holes after each outline."""
    return spark.read.parquet(path).withColumn("parts", parts_from_wkb("geometry")).drop("geometry")


OSM = """elements array<struct<type:string,id:bigint,lon:double,lat:double,tags:map<string,string>,geometry:array<struct<lon:double,lat:double>>>>"""


def land_documents(df: DataFrame, document: str, path: str, per_file: int = 1) -> None:
    """Writes one JSON document per row, indented or not, ``per_file`` rows to a file."""
    df.select(F.col(document).alias("value")).write.option("maxRecordsPerFile", per_file).mode("overwrite").text(path)


def _elements(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OSM).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode("elements").alias("e")).select("e.*")


def read_osm_ways(spark: SparkSession, path: str) -> DataFrame:
    """Ways with at least two points; tags picked by name."""
    w = _elements(spark, path).filter((F.col("type") == "way") & (F.size("geometry") >= 2))
    line = F.transform("geometry", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    return w.select(F.col("id").alias("osm_id"), *[F.col("tags")[t].alias(t) for t in ("highway", "name", "foot")], line.alias("line"))


def read_osm_crossings(spark: SparkSession, path: str) -> DataFrame:
    """Crossing nodes with a position, one per id."""
    n = _elements(spark, path).filter((F.col("type") == "node") & F.col("lon").isNotNull() & F.col("lat").isNotNull())
    return n.groupBy(F.col("id").alias("osm_id")).agg(F.min(F.struct("lon", "lat")).alias("p"), F.min(F.col("tags")["crossing"]).alias("crossing")).select("osm_id", "p.lon", "p.lat", "crossing")


def read_od_pairs(spark: SparkSession, path: str) -> DataFrame:
    place = "struct<name:string,center:array<double>>"
    docs = spark.read.schema(f"name string, pairs array<struct<id:string,label:string,verified:boolean,origin:{place},destination:{place}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    p = docs.select(F.explode("pairs").alias("p")).select("p.*")
    return p.select("id", "label", "verified", F.col("origin.center")[0].alias("olng"), F.col("origin.center")[1].alias("olat"),
                    F.col("destination.center")[0].alias("dlng"), F.col("destination.center")[1].alias("dlat"))


def newest_rows(spark: SparkSession, paths: list[str], schema: str, key: list[str]) -> DataFrame:
    """Many result files read as one; the newest file wins per key, the later name on a tie."""
    rows = spark.read.schema(schema).json(paths).select("*", "_metadata.file_modification_time", "_metadata.file_path")
    rest = [c for c in rows.columns if c not in (*key, "file_modification_time", "file_path")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("file_modification_time", "file_path")).alias("r")).select(*key, "r.*")


def read_pages(spark: SparkSession, path: str, schema: str, page_size: int) -> DataFrame:
    """All landed pages of a feature service; ``short_page`` marks rows of a page that is short but not the last.

    A fetcher stops asking at a short page. What has landed is read whole, and
    a short page in the middle, which says that rows are missing, is flagged.
    """
    rows = spark.read.schema(f"{schema}, page int").json(path)
    sizes = rows.groupBy("page").agg(F.count(F.lit(1)).alias("n_"))
    last = sizes.agg(F.max("page")).scalar()
    flagged = sizes.select("page", ((F.col("n_") < page_size) & (F.col("page") < last)).alias("short_page"))
    return rows.join(flagged, "page", "left").withColumn("short_page", F.coalesce("short_page", F.lit(False)))


