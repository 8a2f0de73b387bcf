"""K-means assignment over blocks of a space-filling curve with bounding boxes.

Vectors are ordered along a Hilbert curve, range-partitioned by their place on
it and packed into blocks; a block carries its vectors, the smallest and
largest value per component, and its componentwise sum. A round sends out only
the centroids: for each block, distances from the centroids to its box leave a
few candidates, and only these are compared with its vectors. A block with one
candidate is settled from its sum without opening a vector.

All arithmetic is on whole numbers. The blocks are written to the shared folder
once and read by every round, so a lost task repeats one file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.session import settle, shuffle_width

K, ROUNDS, COMPONENTS, SCALE = 16, 3, 64, 64
BLOCK_ROWS = 512
#: bits of a component's place on the curve
CURVE_BITS = 6
#: quantised components are held within this bound, so squared distances fit a long
LARGEST = 1 << 27


def usable(vector: Column, components: int = COMPONENTS) -> Column:
    """A vector of the wanted length with only finite components."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & (F.size(vector) == components) & finite, F.lit(False))


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) per component, held within ``LARGEST``."""
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x.cast("double"), F.lit(1e12)), F.lit(-1e12)) * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))


def curve_keys(cells: np.ndarray, bits: int = CURVE_BITS) -> np.ndarray:
    """Place of each row of ``cells`` (values below 2**bits) on the Hilbert curve, as rows of bytes in big-endian order.

    Works on the coordinates themselves: undo the rotations level by level,
    Gray-decode across the axes, then interleave the bits.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(n):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    carry = np.zeros_like(x[0])
    q = top
    while q > 1:
        carry ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= carry
    planes = ((x[None, :, :] >> np.arange(bits - 1, -1, -1)[:, None, None]) & 1).astype(np.uint8)
    return np.packbits(planes.reshape(bits * n, -1).T, axis=1)


def _rows(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _with_curve_key(vectors: DataFrame, low: int, high: int, components: int, bits: int) -> DataFrame:
    span = high - low + 1

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _rows(batch.column("v"), components).astype(np.int64)
                keys = curve_keys(((v - low) << bits) // span, bits)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k.tobytes() for k in keys], pa.binary())], names=[*batch.schema.names, "key"])

    return vectors.mapInArrow(keyed, "vec_id bigint,v array<int>,key binary")


def zone_blocks(vectors: DataFrame, components: int = COMPONENTS, block_rows: int = BLOCK_ROWS, bits: int = CURVE_BITS) -> DataFrame:
    """``(vec_id, v)`` in blocks along the curve: ids, vectors, box and sum of each.

    Equal places on the curve are dealt on by a running number, so many copies
    of one vector fill as many blocks and partitions as they need.
    """
    ends = vectors.agg(F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")).first()
    keyed = _with_curve_key(vectors, ends["low"] or 0, ends["high"] or 0, components, bits).withColumn("deal", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(shuffle_width(vectors.sparkSession), "key", "deal").sortWithinPartitions("key", "deal").select("vec_id", "v")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def block(rows: pa.Table) -> pa.RecordBatch:
            v = _rows(rows.column("v"), components).astype(np.int32)
            ids = rows.column("vec_id").combine_chunks()
            cols = [pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([v.tobytes()], pa.binary()), pa.array([v.min(axis=0).tobytes()], pa.binary()), pa.array([v.max(axis=0).tobytes()], pa.binary()), pa.array([v.sum(axis=0, dtype=np.int64).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["ids", "vectors", "low", "high", "total"])

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= block_rows:
                rows = pa.Table.from_batches(held)
                for lo in range(0, count - block_rows + 1, block_rows):
                    yield block(rows.slice(lo, block_rows))
                rest = rows.slice(count - count % block_rows)
                held, count = rest.to_batches(), rest.num_rows
        if count:
            yield block(pa.Table.from_batches(held))

    return ordered.mapInArrow(pack, "ids array<bigint>,vectors binary,low binary,high binary,total binary")


def box_candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to a vector of the box, ties included."""
    low, high = low.astype(np.int64), high.astype(np.int64)
    below, above = low - centroids, centroids - high
    outside = np.maximum(np.maximum(below, above), 0)
    farthest = np.maximum(np.abs(below), np.abs(above))
    least = (outside * outside).sum(axis=1)
    return np.flatnonzero(least <= (farthest * farthest).sum(axis=1).min())


def squared_distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors by centroids."""
    largest = max(int(np.abs(v).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if v.shape[1] * (2 * largest) ** 2 < 1 << 53:
        a, b = v.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    out = np.empty((len(v), len(centroids)), np.int64)
    for i, c in enumerate(centroids):
        d = v.astype(np.int64) - c
        out[:, i] = (d * d).sum(axis=1)
    return out


def nearest(v: np.ndarray, centroids: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest of the numbered centroids for each vector, and its squared distance; ties to the smaller number."""
    d = squared_distances(v, centroids[numbers])
    at = d.argmin(axis=1)
    return numbers[at], d[np.arange(len(v)), at]


def _blocks(batches: Iterator[pa.RecordBatch], components: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    for batch in batches:
        lows, highs = batch.column("low").to_pylist(), batch.column("high").to_pylist()
        for i in range(batch.num_rows):
            yield batch, i, np.frombuffer(lows[i], np.int32), np.frombuffer(highs[i], np.int32)


def _vectors(batch: pa.RecordBatch, i: int, components: int) -> np.ndarray:
    return np.frombuffer(batch.column("vectors")[i].as_py(), np.int32).reshape(-1, components)


def moved(blocks: DataFrame, centroids: list[list[int]], components: int = COMPONENTS) -> list[list[int]]:
    """Centroids after one round: the exact floor of the mean of each one's vectors; one without vectors stays.

    A task sums what it reads, so a centroid and component cost one row per
    task; the driver gets a sum per centroid and component.
    """
    at = np.array(centroids, dtype=np.int64).reshape(-1, components)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(at.shape, np.int64), np.zeros(len(at), np.int64)
        for batch, i, low, high in _blocks(batches, components):
            numbers = box_candidates(low, high, at)
            if len(numbers) == 1:
                total[numbers[0]] += np.frombuffer(batch.column("total")[i].as_py(), np.int64)
                count[numbers[0]] += len(batch.column("ids")[i])
                continue
            v = _vectors(batch, i, components)
            got, _ = nearest(v, at, numbers)
            for c in np.unique(got):
                total[c] += v[got == c].sum(axis=0, dtype=np.int64)
                count[c] += int((got == c).sum())
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, components), pa.int32()), pa.array(np.tile(np.arange(components), len(some)), pa.int32()), pa.array(total[some].ravel(), pa.int64()), pa.array(np.repeat(count[some], components), pa.int64())], names=["cluster", "component", "total", "count"])

    exact = "decimal(38,0)"
    found = blocks.mapInArrow(sums, "cluster int,component int,total bigint,count bigint").groupBy("cluster", "component").agg(F.sum(F.col("total").cast(exact)).alias("total"), F.sum("count").alias("count"))
    after = [list(c) for c in centroids]
    for r in found.collect():
        after[r["cluster"]][r["component"]] = int(r["total"]) // r["count"]
    return after


def assigned(blocks: DataFrame, centroids: list[list[int]], components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, cluster, distance)`` of every vector."""
    at = np.array(centroids, dtype=np.int64).reshape(-1, components)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, low, high in _blocks(batches, components):
            got, d = nearest(_vectors(batch, i, components), at, box_candidates(low, high, at))
            yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(got, pa.int32()), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(scan, "vec_id bigint,cluster int,distance bigint")


def first_centroids(vectors: DataFrame, k: int = K) -> list[list[int]]:
    """The ``k`` vectors whose numbers hash smallest; a null number hashes as an empty one, equal hashes go by the vector."""
    order = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r["v"]) for r in vectors.orderBy(order, "v").limit(k).collect()]


def clusters(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Cluster of every usable vector after ``rounds`` rounds and one more assignment.

    Vectors that are null, of another length, or hold a null or non-finite
    component take no part. Quantised components beyond ``LARGEST`` count as
    that. Repeated rows are rows of their own, a null ``vec_id`` is kept; fewer
    vectors than ``k`` give as many centroids; an empty table gives an empty one.

    Returns ``vec_id``, ``cluster``, ``distance`` (squared), ``cluster_inertia``
    and ``inertia`` (null where a sum passes a long), and ``centroid`` (its
    components).
    """
    spark = embeddings.sparkSession
    vectors = embeddings.filter(usable(F.col(vector), components)).select(F.col(vec_id).cast("long").alias("vec_id"), quantised(F.col(vector), scale).alias("v"))
    centroids = first_centroids(vectors, k)
    blocks = settle(zone_blocks(vectors, components, block_rows), "zone-blocks")
    for _ in range(rounds if centroids else 0):
        centroids = moved(blocks, centroids, components)
    found = settle(assigned(blocks, centroids, components), "assigned")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = [(r["cluster"], int(r["s"])) for r in found.groupBy("cluster").agg(exact.alias("s")).collect()]
    total = sum(s for _, s in sums)
    fits = lambda s: s if s < 1 << 63 else None
    table = spark.createDataFrame([(c, fits(s), fits(total), centroids[c]) for c, s in sums], "cluster int,cluster_inertia bigint,inertia bigint,centroid array<bigint>")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
