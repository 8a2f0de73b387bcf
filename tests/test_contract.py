"""Entry points, sources, streams, and the output expectations of the scored table."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strideframe.plans import bindings
from strideframe.sources import readers
from strideframe.streaming import sessions

SF = "/root/testdata/sf0.001"


def test_registry_is_consistent():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 180 and len(o) > 170


@pytest.mark.parametrize("name", ["qa_03_graffiti", "sc_06_accessibility", "agg_16_reporting_levels", "jn_01_counts_within_radius", "jn_06_line_length_in_corridor", "rq_10_greedy_distinct"])
def test_sample_of_queries_against_check_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("nation", "region", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    want = sorted(str(tuple(r[names.index(c)] for c in sorted(names))) for r in rel.fetchall())
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(str(tuple(r[c] for c in sorted(names))) for r in df.collect()) == want


def test_scored_table_expectations(spark):
    s = entry.queries()["sc_18_scored_table"](spark, SF).cache()
    n = bindings.layer(spark, SF, "features").count()
    assert s.count() == n == s.select("segment_id").distinct().count()
    ineligible = s.filter(~F.coalesce("score_eligible", F.lit(False))).count()
    assert s.filter("day_index_score IS NULL").count() == ineligible
    for c in ("accessibility_score", "heat_shade_score", "day_index_score", "score_lighting", "score_crash"):
        assert s.filter(~F.col(c).between(0, 100) | F.isnan(c)).count() == 0


def test_export_is_not_added_to_the_master(spark):
    segs = bindings.layer(spark, SF, "segments")
    assert segs.count() == bindings.table(spark, SF, "part").count()


def test_feature_collection_reader(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"id": 1, "name": "a"}, "geometry": {"type": "Point", "coordinates": [145.2, -38.0]}},
        {"type": "Feature", "properties": {"id": 2, "name": "b"}, "geometry": None}]}
    (tmp_path / "layer.geojson").write_text(json.dumps(doc, indent=1))
    rows = readers.read_feature_collection(spark, str(tmp_path / "layer.geojson"), "id:bigint,name:string").collect()
    assert [(r.id, r.geometry.coordinates) for r in rows] == [(1, [145.2, -38.0])]


def test_csv_reader_skips_rows_with_too_many_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,x\n2,y,z\n3,w\n")
    assert [r.k for r in readers.read_csv_text(spark, str(tmp_path / "a.csv"), ["k", "v"]).orderBy("k").collect()] == ["1", "3"]


def test_streamed_sessions_equal_batch_for_closed_ones(spark):
    batch = sessions.usage_sessions(sessions.with_event_time(bindings.table(spark, SF, "events")))
    stream = sessions.open_stream(spark, SF).withWatermark("at", "10 minutes")
    got = sessions.run_appends(sessions.usage_sessions(stream), "sessions")
    assert got.count() > 0
    assert got.exceptAll(batch).count() == 0


def test_indented_documents_are_read_whole(spark, tmp_path):
    doc = {"elements": [{"type": "way", "id": 7, "tags": {"highway": "path"}, "geometry": [{"lon": 1.0, "lat": 2.0}, {"lon": 1.5, "lat": 2.5}]}, {"type": "node", "id": 8, "lon": 1.0, "lat": 2.0, "tags": {"crossing": "zebra"}}]}
    (tmp_path / "osm.json").write_text(json.dumps(doc, indent=2))
    assert [r.osm_id for r in readers.read_osm_ways(spark, str(tmp_path / "osm.json")).collect()] == [7]
    assert [r.osm_id for r in readers.read_osm_crossings(spark, str(tmp_path / "osm.json")).collect()] == [8]
    place = {"name": "p", "center": [145.0, -38.0]}
    pairs = {"name": "sample", "pairs": [{"id": f"OD-{k}", "label": "x", "verified": True, "origin": place, "destination": place} for k in range(3)]}
    (tmp_path / "od.json").write_text(json.dumps(pairs, indent=2))
    assert readers.read_od_pairs(spark, str(tmp_path / "od.json")).count() == 3


def test_pages_after_a_short_one_are_kept_and_flagged(spark, tmp_path):
    rows = [(i, p) for p, n in ((0, 3), (1, 2), (2, 3), (3, 1)) for i in range(n)]
    spark.createDataFrame(rows, "id long, page int").write.json(f"{tmp_path}/pages")
    got = readers.read_pages(spark, f"{tmp_path}/pages", "id bigint", 3).collect()
    assert len(got) == len(rows) and {r.page for r in got if r.short_page} == {1}
