"""Exact top-k inner products by pivot elimination.

Distances of every vector to a few pivots are computed once. For a query q and
a row x, ``max |d(q,p) - d(x,p)|`` over the pivots bounds their distance from
below, and with both norms that bounds the inner product from above. Rows are
evaluated in the order of that bound, best first, until the k-th score found
cannot be beaten; the answer is exact.

Rows and queries are packed into blocks of bounded size. Every block of
queries meets every block of rows in a task of its own, and the k best per
block are merged per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strideframe.session import settle

PIVOTS = 32
#: vectors that pivots are chosen from
PIVOT_SAMPLE = 2000
BLOCK_ROWS, BLOCK_QUERIES = 4096, 512
CHUNK = 64


def quantised(vector: Column) -> Column:
    """floor(256 * x) per component, as doubles with whole values."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("double"))


def usable(vector: Column) -> Column:
    """A vector that is not null and has only finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))


def _first_by_hash(vectors: DataFrame, sample: int) -> list:
    """The first ``sample`` vectors in order of their key's hash.

    Few more than those are sorted, and one task of an executor merges them: a
    limit that is collected brings that many rows of every partition to the driver.
    """
    keyed = vectors.select(F.xxhash64("vec_id").alias("h"), "vec_id", "v")
    share = 4 * sample / max(1, vectors.count())
    while share < 1 and (low := keyed.filter(F.col("h") < int(-(2**63) + share * 2**64))).count() < sample:
        share *= 4
    pool = settle((low if share < 1 else keyed).orderBy("h", "vec_id", "v").limit(sample), "pivot-pool")
    return [r.v for r in sorted(pool.collect(), key=lambda r: (r.h, r.vec_id, r.v))]


def choose_pivots(vectors: DataFrame, count: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> np.ndarray:
    """Pivots far from one another, among at most ``sample`` vectors in a fixed shuffled order."""
    pool = _matrix(_first_by_hash(vectors, sample))
    if not len(pool):
        return pool
    chosen, far = [0], np.linalg.norm(pool - pool[0], axis=1)
    while len(chosen) < min(count, len(pool)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(pool - pool[chosen[-1]], axis=1))
    return pool[chosen]


def _matrix(rows: list, width: int = 0) -> np.ndarray:
    """Rows as a matrix; shorter ones are filled up with zeros."""
    width = max([width, *map(len, rows)]) if rows else width
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _widened(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def pivot_distances(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    width = max(m.shape[1], pivots.shape[1])
    a, b = _widened(m, width), _widened(pivots, width)
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def block_top(query: np.ndarray, query_far: np.ndarray, query_id: int, rows: np.ndarray, far: np.ndarray, norm: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (vec_id, score) of a block for one query, ties to the smaller id.

    Rows come in order of their bound, equal bounds by id, and are evaluated in
    chunks; a chunk is the last once its first row cannot beat the k-th so far.
    """
    least = np.abs(far - query_far).max(axis=1) if far.shape[1] else np.zeros(len(rows))
    own = float(query @ query)
    # rounding of the distances is far below one unit of score; one unit of slack keeps the bound safe
    slack = 1 + 1e-9 * (own + norm)
    bound = np.floor((own + norm - least * least) / 2 + slack)
    bound[ids == query_id] = -np.inf
    order = np.lexsort((ids, -bound))
    best: list[tuple[float, int]] = []
    at, step = 0, CHUNK
    while at < len(order):
        first = order[at]
        if bound[first] == -np.inf or len(best) == k and (-bound[first], ids[first]) > best[-1]:
            break
        take = order[at:at + step]
        take = take[bound[take] > -np.inf]
        best = sorted(best + list(zip((-(rows[take] @ query)).tolist(), ids[take].tolist(), strict=True)))[:k]
        at, step = at + step, step * 2
    return [(i, int(-s)) for s, i in best]


def _packed(df: DataFrame, block: Column, name: str, pivots: np.ndarray) -> DataFrame:
    """One row per block: ids, vectors and pivot distances as bytes."""

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id", kind="stable")
        m = _matrix(list(part["v"]))
        return pd.DataFrame({name: [key[0]], "ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "width": [m.shape[1]], "m": [m.tobytes()], "far": [pivot_distances(m, pivots).tobytes()]})

    return df.withColumn(name, block).groupBy(name).applyInPandas(pack, f"{name} long, ids binary, width long, m binary, far binary")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each query, ties to the smaller vec_id.

    ``is_query`` marks queries by ``vec_id``. Vectors that are null or hold null
    or non-finite components, and rows without vec_id, take no part; an empty
    vector scores 0. Vectors of different length meet as if filled up with
    zeros. Rows with the query's own vec_id are its own and left out; repeated
    rows of another vec_id all count, repeated queries are answered once (a
    vec_id with several vectors: by its least). Fewer rows than k give them all.
    """
    base = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    base = settle(base.select("vec_id", quantised(F.col("v")).alias("v")), "vectors")
    anchor = choose_pivots(base, pivots)
    asked = settle(base.select(F.col("vec_id"), "v").filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    n, m = base.count(), asked.count()
    row_blocks, query_blocks = max(1, -(-n // block_rows)), max(1, -(-m // block_queries))
    rows = settle(_packed(base, F.pmod(F.xxhash64("vec_id", "v"), F.lit(row_blocks)).cast("long"), "row_block", anchor), "row-blocks")
    ask = settle(_packed(asked, F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("long"), "query_block", anchor), "query-blocks")
    ask = ask.select("query_block", *[F.col(c).alias(f"q_{c}") for c in ("ids", "width", "m", "far")], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))).alias("row_block"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                ids, q_ids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                x = np.frombuffer(r["m"]).reshape(len(ids), -1) if r["width"] else np.zeros((len(ids), 0))
                q = np.frombuffer(r["q_m"]).reshape(len(q_ids), -1) if r["q_width"] else np.zeros((len(q_ids), 0))
                far, q_far = np.frombuffer(r["far"]).reshape(len(ids), -1), np.frombuffer(r["q_far"]).reshape(len(q_ids), -1)
                width = max(x.shape[1], q.shape[1])
                x, q = _widened(x, width), _widened(q, width)
                norm = (x * x).sum(axis=1)
                got = [(int(i), v, s) for i, a, b in zip(q_ids, q, q_far, strict=True) for v, s in block_top(a, b, int(i), x, far, norm, ids, k)]
                yield pa.RecordBatch.from_arrays([pa.array([g[j] for g in got], pa.int64()) for j in range(3)], names=["query_id", "vec_id", "score"])

    # Spark would count the query blocks before they are repeated, and broadcast every copy
    found = ask.join(rows.hint("merge"), "row_block").select("ids", "width", "m", "far", "q_ids", "q_width", "q_m", "q_far").mapInArrow(meet, "query_id long, vec_id long, score long")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
