import base64
import hashlib

import pytest

from strideframe.llm import warc_bundles as wb


def _brute(rows):
    first = {}
    for k, h in rows:
        body = (h or "").encode()
        old = first.get(body, ())
        first[body] = (k,) if old == () or old[0] is None or (k is not None and k < old[0]) else old
    out = []
    for k, h in rows:
        body = (h or "").encode()
        f = first[body][0]
        out.append((k, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if k == f else "revisit", None if k == f else f))
    return sorted(out, key=str)


def _pages(spark, rows):
    return spark.createDataFrame([(k, f"http://h.example/{k}" if k else None, h, "x") for k, h in rows], "page_id long, url string, html string, digest string")


ROWS = [(3, "<p>a</p>"), (1, "<p>a</p>"), (2, None), (4, ""), (5, "é" * 5000), (None, "<p>a</p>"), (6, "only"), (None, "nobody else"), (7, "x\r\n\r\nWARC/1.1\r\n"), (1, "<p>a</p>"), (8, "long " * 300_000)]


@pytest.mark.parametrize("options", [{}, {"frame_bytes": 1, "bundle_bytes": 200}])
def test_round_trip(spark, options):
    folder, index = wb.archive(_pages(spark, ROWS), **options)
    got = wb.read_bundles(folder, index).collect()
    assert sorted(((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == _brute(ROWS)
    bodies = dict(ROWS)
    assert all(bytes(r.payload).decode() == (bodies[r.key] or "") for r in got if r.record_type == "response" and r.key is not None)
    assert index.count() == len(ROWS)


def test_one_record_is_read_by_its_frame(spark):
    folder, index = wb.archive(_pages(spark, ROWS), frame_bytes=100)
    for e in index.collect():
        head, body = wb.read_record(folder, e)
        assert head["WARC-Record-ID"] == e.record_id
        if head["WARC-Type"] == "response" and e.key is not None:
            assert body.decode() == (dict(ROWS)[e.key] or "")
    assert index.select("bundle", "frame_at").distinct().count() > 3


def test_small_payloads_are_all_responses(spark):
    folder, index = wb.archive(_pages(spark, ROWS), least=100)
    got = wb.read_bundles(folder, index).collect()
    assert {r.record_type for r in got} == {"response"}


def test_files_no_index_names_are_not_read(spark):
    folder, index = wb.archive(_pages(spark, ROWS))
    before = wb.read_bundles(folder, index).count()
    with open(folder.removeprefix("file://") + "/part-99999-1-00000.warc.zst", "wb") as f:
        f.write(b"left by a lost task")
    assert wb.read_bundles(folder, index).count() == before


def test_empty_table(spark):
    folder, index = wb.archive(_pages(spark, []))
    assert index.count() == 0 and wb.read_bundles(folder, index).count() == 0


def test_firsts_are_joined_alike_whatever_their_number(spark, monkeypatch):
    monkeypatch.setattr(wb, "BROADCAST_ROWS", 0)
    folder, index = wb.archive(_pages(spark, ROWS))
    got = wb.read_bundles(folder, index).collect()
    assert sorted(((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == _brute(ROWS)


def test_bundles_are_read_in_tasks_of_their_own(spark):
    folder, index = wb.archive(_pages(spark, [(k, f"page {k} " * 50) for k in range(400)]), bundle_bytes=2000, frame_bytes=500)
    records = wb.read_bundles(folder, index)
    bundles = index.select("bundle").distinct().count()
    assert bundles >= 8 and records.rdd.getNumPartitions() == bundles
