"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle is a run of
frames and, at its end, a skippable frame with the seek table (sizes of all
frames). An index maps each record identifier to its bundle, its frame's place
and its offset inside the frame, so one record is read by opening one frame.

Records with equal payloads are stored once: the smallest key is a response,
the others revisit it. Every task writes bundles of its own under names that
no other attempt uses; readers open only what the index names, so a lost or
repeated task leaves nothing that is read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.session import scratch_path, settle

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
LEVEL = 3
#: digests of repeated payloads that may travel whole (some 100 bytes each), and tasks that bundles are read in at most
BROADCAST_ROWS, MOST_TASKS = 200_000, 20_000
DATE = "1970-01-01T00:00:00Z"
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
INDEX = "key long, record_id string, bundle string, frame long, frame_at long, frame_bytes long, record_at long, record_bytes long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int | None, digest: str) -> str:
    """The identifier that a record of this key and payload has."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{key}:{digest}')}>"


def record(key: int | None, url: str | None, payload: bytes, first: int | None, is_first: bool, date: str = DATE) -> tuple[str, bytes]:
    """Identifier and bytes of a WARC/1.1 record; a revisit carries no payload."""
    digest = digest_of(payload)
    own = record_id(key, digest)
    head = [f"WARC-Type: {'response' if is_first else 'revisit'}", f"WARC-Record-ID: {own}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if key is not None:
        head.append(f"X-Record-Key: {key}")
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    if not is_first:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {record_id(first, digest)}")
        head.append(f"X-Refers-To-Key: {first}")
    body = payload if is_first else b""
    head.append(f"Content-Length: {len(body)}")
    return own, b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers and payload of the record at an offset, and the offset of the next."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    begin, size = stop + 4, int(head["Content-Length"])
    return head, data[begin:begin + size], begin + size + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frames_of(bundle) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of each frame, from the footer of an open bundle."""
    size = bundle.size()
    bundle.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", bundle.read(9))
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table")
    bundle.seek(size - 17 - 8 * count)
    table = bundle.read(8 + 8 * count)
    if struct.unpack("<I", table[:4])[0] != SKIPPABLE:
        raise ValueError("frames and seek table do not meet")
    at, out = 0, []
    for packed, whole in struct.iter_unpack("<II", table[8:]):
        out.append((at, packed, whole))
        at += packed
    if at != size - 17 - 8 * count:
        raise ValueError("frames and seek table do not meet")
    return out


class _Bundle:
    """One bundle being written: records gather in a frame, frames go to a temporary file."""

    def __init__(self, store: fs.FileSystem, folder: str, name: str, level: int):
        self.store, self.path, self.name, self.level = store, f"{folder}/{name}", name, level
        self.out = store.open_output_stream(self.path + ".part")
        self.frames: list[tuple[int, int]] = []
        self.at, self.frame, self.rows, self.index = 0, bytearray(), [], []

    def add(self, key: int | None, own: str, data: bytes, frame_bytes: int) -> None:
        self.rows.append((key, own, len(self.frame), len(data)))
        self.frame += data
        if len(self.frame) >= frame_bytes:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.rows:
            packed = zstandard.ZstdCompressor(level=self.level).compress(bytes(self.frame))
            self.out.write(packed)
            self.index += [(k, own, self.name, len(self.frames), self.at, len(packed), a, n) for k, own, a, n in self.rows]
            self.frames.append((len(packed), len(self.frame)))
            self.at += len(packed)
            self.frame, self.rows = bytearray(), []

    def finish(self) -> list[tuple]:
        self._close_frame()
        self.out.write(seek_table(self.frames))
        self.out.close()
        self.store.move(self.path + ".part", self.path)
        return self.index


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["key", "record_id", "bundle", "frame", "frame_at", "frame_bytes", "record_at", "record_bytes"])


def with_firsts(pages: DataFrame, key: str, payload: str, url: str | None, least: int) -> DataFrame:
    """key, url, payload (never null), first: the smallest key with that payload; is_first.

    Payloads of fewer than ``least`` bytes are all first. A null key counts as
    the largest; rows that share smallest key and payload are all first.
    """
    # the digest is null where the payload stands alone, so such rows meet nobody
    body = F.coalesce(F.col(payload), F.lit(""))
    base = pages.select(F.col(key).cast("bigint").alias("key"), (F.col(url) if url else F.lit(None).cast("string")).alias("url"), body.alias("payload"))
    base = base.withColumn("digest", F.when(F.octet_length("payload") >= least, F.sha1("payload")))
    firsts = base.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    firsts = settle(firsts, "firsts")
    # payloads stay where they are as long as the digests that repeat are few enough to travel
    few = firsts.count() <= BROADCAST_ROWS
    return base.join(F.broadcast(firsts) if few else firsts, "digest", "left").select("key", "url", "payload", "first", (F.col("first").isNull() | F.col("key").eqNullSafe(F.col("first"))).alias("is_first"))


def write_bundles(pages: DataFrame, folder: str, key: str = "page_id", payload: str = "html", url: str | None = "url", least: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL, date: str = DATE) -> DataFrame:
    """Writes one record per row into bundles in ``folder`` and returns the index.

    A null payload is an empty one; a null url leaves its header out. A payload
    of any length is one record; a bundle ends after the record that fills it.
    An empty table writes no bundle.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        open_, count = None, 0
        for batch in batches:
            for k, u, p, first, is_first in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if open_ is None:
                    open_ = _Bundle(store, root, f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{count:05d}.warc.zst", level)
                own, data = record(k, u, p.encode(), first, is_first, date)
                open_.add(k, own, data, frame_bytes)
                if open_.at >= bundle_bytes:
                    yield _index_batch(open_.finish())
                    open_, count = None, count + 1
        if open_ is not None:
            yield _index_batch(open_.finish())

    return settle(with_firsts(pages, key, payload, url, least).mapInArrow(scan, INDEX), "warc-index")


def read_bundles(folder: str, index: DataFrame) -> DataFrame:
    """Every record of the bundles that the index names: key, url, record_type, record_id, payload, payload_bytes, payload_digest, refers_to.

    A stored payload is checked against its header's digest. Tasks open bundles
    by name and hold one frame at a time; bundles are not shuffled, only their
    names, as a rule one to a task.
    """
    named = index.select("bundle").distinct()
    named = named.repartition(min(MOST_TASKS, max(1, named.count())))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_file(f"{root}/{name}") as f:
                    for at, packed, _ in frames_of(f):
                        f.seek(at)
                        rows = list(_records(zstandard.ZstdDecompressor().decompress(f.read(packed))))
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_RECORD_KINDS)], names=_RECORD_NAMES)

    return named.mapInArrow(scan, "key long, url string, record_type string, record_id string, payload binary, payload_bytes long, payload_digest string, refers_to long")


_RECORD_NAMES = ["key", "url", "record_type", "record_id", "payload", "payload_bytes", "payload_digest", "refers_to"]
_RECORD_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]


def _records(data: bytes) -> Iterator[tuple]:
    """The records of a frame; a stored payload that its digest does not fit raises."""
    at = 0
    while at < len(data):
        head, body, at = parse(data, at)
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        response = head["WARC-Type"] == "response"
        if response and (digest_of(body) != digest or len(body) != int(head["X-Payload-Length"])):
            raise ValueError(f"damaged record {head['WARC-Record-ID']}")
        key, refers = head.get("X-Record-Key"), head.get("X-Refers-To-Key")
        yield (None if key is None else int(key), head.get("WARC-Target-URI"), head["WARC-Type"], head["WARC-Record-ID"], body if response else None, int(head["X-Payload-Length"]), digest, None if refers is None else int(refers))


def read_record(folder: str, entry) -> tuple[dict[str, str], bytes]:
    """One record by its index entry: opens its frame alone."""
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/{entry['bundle']}") as f:
        f.seek(entry["frame_at"])
        data = zstandard.ZstdDecompressor().decompress(f.read(entry["frame_bytes"]))
    return parse(data, entry["record_at"])[:2]


def archive(pages: DataFrame, **options) -> tuple[str, DataFrame]:
    """Bundles in a fresh shared folder, and their index."""
    folder = scratch_path(pages.sparkSession, "warc")
    folder = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
    return folder, write_bundles(pages, folder, **options)
