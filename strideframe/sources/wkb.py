"""Well-known binary of all seven geometry kinds, as Arrow UDFs.

A geometry is a list of parts, a part a list of rings, a ring a list of
coordinates: a point or line has one part with one ring, a polygon one part
whose first ring is the outline and whose others are holes, multi-part kinds
have several parts. Rings are open in memory and closed in the bytes. Unknown
kinds, and kinds inside collections, raise.

Geometries of one kind and equal length in bytes are coded together in numpy;
only their layout (which bytes are headers) is looked at one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, StructType

COORDS = ArrayType(StructType().add("x", DoubleType()).add("y", DoubleType()))
PARTS = ArrayType(ArrayType(COORDS))
POINT, LINE, POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON = 1, 2, 3, 4, 5, 6
_SINGLE = {MULTIPOINT: POINT, MULTILINE: LINE, MULTIPOLYGON: POLYGON}
Rings = list[list[np.ndarray]]


def _part(rings: list[np.ndarray], kind: int) -> bytes:
    head = b"\x01" + kind.to_bytes(4, "little")
    if kind == POINT:
        return head + rings[0][0].astype("<f8").tobytes()
    closed = [np.vstack([r, r[:1]]) for r in rings] if kind == POLYGON else rings
    body = b"".join(len(r).to_bytes(4, "little") + r.astype("<f8").tobytes() for r in closed)
    return head + (len(closed).to_bytes(4, "little") if kind == POLYGON else b"") + body


def encode(parts: Rings, kind: int) -> bytes:
    """Little-endian bytes of one geometry."""
    if kind in _SINGLE:
        return b"\x01" + kind.to_bytes(4, "little") + len(parts).to_bytes(4, "little") + b"".join(_part(p, _SINGLE[kind]) for p in parts)
    if kind not in (POINT, LINE, POLYGON):
        raise ValueError(f"unknown geometry kind {kind}")
    if len(parts) != 1 or (kind != POLYGON and len(parts[0]) != 1):
        raise ValueError(f"geometry kind {kind} has one part")
    return _part(parts[0], kind)


def _number(raw: bytes, at: int, little: bool) -> int:
    return int.from_bytes(raw[at:at + 4], "little" if little else "big")


def _read_part(raw: bytes, at: int, want: int | None = None) -> tuple[list[np.ndarray], int]:
    little = raw[at] == 1
    kind, real = _number(raw, at + 1, little), np.dtype("<f8" if little else ">f8")
    if want is not None and kind != want or kind not in (POINT, LINE, POLYGON):
        raise ValueError(f"unknown geometry kind {kind}")
    at += 5
    if kind == POINT:
        return [np.frombuffer(raw, real, 2, at).reshape(1, 2)], at + 16
    count = 1
    if kind == POLYGON:
        count, at = _number(raw, at, little), at + 4
    rings = []
    for _ in range(count):
        n = _number(raw, at, little)
        xy = np.frombuffer(raw, real, 2 * n, at + 4).reshape(n, 2)
        rings.append(xy[:-1] if kind == POLYGON and n > 1 and (xy[0] == xy[-1]).all() else xy)
        at += 4 + 16 * n
    return rings, at


def decode(raw: bytes) -> Rings:
    """Parts of one geometry, each a list of open rings."""
    little = raw[0] == 1
    kind = _number(raw, 1, little)
    if kind not in _SINGLE:
        return [_read_part(raw, 0)[0]]
    parts, at = [], 9
    for _ in range(_number(raw, 5, little)):
        rings, at = _read_part(raw, at, _SINGLE[kind])
        parts.append(rings)
    return parts


def _array(a: pa.Array | pa.ChunkedArray) -> pa.Array:
    return a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a


def _simple(raws: list[bytes | None]) -> list[np.ndarray | None] | None:
    """Coordinates where all are little-endian points, lines or polygons of one ring; else None."""
    out: list[np.ndarray | None] = [None] * len(raws)
    groups: dict[tuple[bytes, int], list[int]] = {}
    for i, b in enumerate(raws):
        if b is not None:
            groups.setdefault((b[:9] if b[1:5] == b"\x03\0\0\0" else b[:5], len(b)), []).append(i)
    for (head, size), rows in groups.items():
        skip = {b"\x01\x01\0\0\0": 5, b"\x01\x02\0\0\0": 9, b"\x01\x03\0\0\0\x01\0\0\0": 13}.get(head)
        if skip is None or (size - skip) % 16:
            return None
        flat = np.frombuffer(b"".join(raws[i] for i in rows), np.uint8).reshape(len(rows), size)
        xy = np.ascontiguousarray(flat[:, skip:]).view("<f8").reshape(len(rows), -1, 2)
        if skip == 13:
            xy = xy[:, :-1]
        for i, c in zip(rows, xy, strict=True):
            out[i] = c
    return out


def _points(xy: list[np.ndarray]) -> pa.Array:
    flat = np.vstack(xy) if xy else np.zeros((0, 2))
    return pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["x", "y"])


def _lists(sizes: list[int | None], values: pa.Array) -> pa.Array:
    ends = np.cumsum([0] + [n or 0 for n in sizes])
    offsets = pa.array([None if n is None else int(e) for n, e in zip(sizes, ends[:-1], strict=True)] + [int(ends[-1])], pa.int32())
    return pa.ListArray.from_arrays(offsets, values)


@F.arrow_udf(BinaryType())
def parts_to_wkb(parts: pa.Array, kind: pa.Array) -> pa.Array:
    """Bytes of parts and rings; NULL and empty geometries are NULL."""
    parts = _array(parts)
    rings = parts.flatten()
    coords = rings.flatten()
    flat = coords.flatten()
    xy = np.column_stack([flat.field("x").to_numpy(zero_copy_only=False), flat.field("y").to_numpy(zero_copy_only=False)])

    def bounds(a: pa.Array) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.nan_to_num(a.value_lengths().to_numpy(zero_copy_only=False)).astype(int))])

    p, r, c = bounds(parts), bounds(rings), bounds(coords)
    out = []
    for i, k in enumerate(kind.to_pylist()):
        shape = [[xy[c[j]:c[j + 1]] for j in range(r[q], r[q + 1])] for q in range(p[i], p[i + 1])]
        out.append(encode(shape, int(k)) if shape else None)
    return pa.array(out, pa.binary())


@F.arrow_udf(PARTS)
def parts_from_wkb(raw: pa.Array) -> pa.Array:
    """Parts, rings and coordinates of any geometry."""
    raws = _array(raw).to_pylist()
    simple = _simple(raws)
    shapes: list[Rings | None] = [None if c is None else [[c]] for c in simple] if simple is not None else [None if b is None else decode(b) for b in raws]
    parts = [p for s in shapes if s is not None for p in s]
    rings = [r for p in parts for r in p]
    coords = _lists([len(r) for r in rings], _points(rings))
    return _lists([None if s is None else len(s) for s in shapes], _lists([len(p) for p in parts], coords))


def to_wkb(coords: Column, kind: Column) -> Column:
    """Bytes of a geometry with one part and one ring, from its coordinates."""
    return parts_to_wkb(F.when(F.size(coords) > 0, F.array(F.array(coords))), kind)


def only_ring(parts: Column) -> Column:
    """Coordinates of a geometry with one part and one ring; anything else raises, so nothing is lost unseen."""
    whole = (F.size(parts) == 1) & (F.size(F.get(parts, F.lit(0))) == 1)
    return F.when(parts.isNull(), None).when(whole, parts[0][0]).otherwise(F.raise_error(F.lit("geometry has several parts or holes: read its parts")))
