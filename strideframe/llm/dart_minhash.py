"""Near-duplicates of documents by weighted min-hashing with darts.

Each shingle of a document owns a region: its weight on one axis, an endless
rank on the other. Hashing throws darts into that plane at unit density, the
same darts for a shingle in every document. A dart counts for a document if it
lands below the shingle's weight, it aims at one of ``SIZE`` coordinates, and
each coordinate keeps the dart of least rank. About ``SIZE * ln(SIZE)`` darts
per document are enough, whatever its length, and two documents agree on a
coordinate with the probability of their weighted Jaccard similarity.

Coordinates are joined in bands. A bucket is never expanded into pairs: its
most connected member is compared with the others on exact shingle weights, and
what links is one component from then on. Only in buckets that still hold
several components are the members outside the largest one compared with all
others, block against block, so every two texts that share a bucket end up in
one component or are known to be too far apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from strideframe.llm import textbytes as tb
from strideframe.session import settle

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
SIZE = BANDS * ROWS
#: lowest slab of ranks, as a power of two; slabs double up to a height of TALLEST
FLOOR, TALLEST = -6, 32.0
#: members of a bucket that one comparison block holds, and bytes of their shingles: outliers, and all
BLOCK_OUT, BLOCK_ALL = 256, 1024
BLOCK_OUT_BYTES, BLOCK_ALL_BYTES = 2 << 20, 8 << 20
#: rows that carry texts or shingles go to Python in batches of this size
BATCH = "4m"

_U = np.uint64
_SCALE = 2.0**-64


def _poisson_steps(area: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... darts on an area, until they are 1 to double precision."""
    out, p, k = [], np.exp(-area), 0
    total = p
    while total < 1 - 1e-15 and k < 200:
        out.append(total)
        k += 1
        p *= area / k
        total += p
    return np.array(out)


def _cells(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit steps of the weight axis: for each element and step its row and the step number."""
    steps = np.ceil(weights).astype(np.int64)
    row = np.repeat(np.arange(len(weights)), steps)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(steps) - steps, steps)


def throw(keys: np.ndarray, weights: np.ndarray, bounds: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Signatures of weighted sets: ``size`` dart ids for each set with elements.

    Set i owns elements ``bounds[i]:bounds[i + 1]``; a set without elements gets
    zeros. The rank axis is opened slab by slab for the sets that still have an
    empty coordinate, so the result is the exact minimum.
    """
    sets = len(bounds) - 1
    best = np.full((sets, size), np.inf)
    ids = np.zeros((sets, size), dtype=np.uint64)
    owner = np.repeat(np.arange(sets), np.diff(bounds))
    row, step = _cells(weights)
    seed = tb.mix(keys[row] + step.astype(np.uint64) * tb.BASE)
    limit = (weights[row] - step).astype(np.float64)
    who = owner[row]
    open_ = np.diff(bounds) > 0
    slab, low, high = 0, 0.0, 2.0**FLOOR
    while open_.any():
        mine = np.flatnonzero(open_[who])
        height = high - low
        area_seed = tb.mix(seed[mine] ^ tb.mix(np.array([slab * 2 + 1], np.uint64) * tb.BASE))
        count = np.searchsorted(_poisson_steps(height), area_seed * _SCALE, "right")
        some = np.flatnonzero(count)
        if len(some):
            times = count[some]
            dart = np.repeat(some, times)
            nth = np.arange(len(dart)) - np.repeat(np.cumsum(times) - times, times)
            dart_id = tb.mix(area_seed[dart] + (nth.astype(np.uint64) + _U(1)) * BAND_STEP)
            aim = tb.mix(dart_id ^ _U(0xA5A5A5A5A5A5A5A5))
            across = tb.mix(dart_id ^ _U(0x3C3C3C3C3C3C3C3C)) * _SCALE
            hit = across < limit[mine[dart]]
            dart_id, aim, dart = dart_id[hit], aim[hit], dart[hit]
            rank = low + height * (tb.mix(dart_id) * _SCALE)
            flat = who[mine[dart]] * size + (aim % _U(size)).astype(np.int64)
            order = np.lexsort((dart_id, rank, flat))
            flat, rank, dart_id = flat[order], rank[order], dart_id[order]
            first = np.ones(len(flat), dtype=bool)
            first[1:] = flat[1:] != flat[:-1]
            flat, rank, dart_id = flat[first], rank[first], dart_id[first]
            better = rank < best.ravel()[flat]
            best.ravel()[flat[better]] = rank[better]
            ids.ravel()[flat[better]] = dart_id[better]
        open_ &= np.isinf(best).any(axis=1)
        slab, low, high = slab + 1, high, high * 2 if high < TALLEST else high + TALLEST
    return ids


BAND_STEP = _U(0xD6E8FEB86659FD93)


def shingles(w: tb.Words, n: int, size: int = SHINGLE, counted: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of n texts, their weights, and the range of each text.

    Fewer words than ``size`` make one shingle of them all; no word makes none.
    """
    count = np.diff(w.bounds)
    made = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    text = np.repeat(np.arange(n), made)
    begin = np.arange(len(text)) - np.repeat(np.cumsum(made) - made, made) + w.bounds[:-1][text]
    stop = np.minimum(begin + size, w.bounds[1:][text])
    h = np.zeros(len(text), dtype=np.uint64)
    for k in range(size):
        there = begin + k < stop
        h = np.where(there, tb.mix(h + BAND_STEP) ^ w.hash[np.minimum(begin + k, max(0, len(w.hash) - 1))] if len(w.hash) else h, h)
    h = tb.mix(h)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(first)
    weight = np.diff(np.concatenate((at, [len(h)]))).astype(np.float64) if counted else np.ones(len(at))
    return h[at], weight, np.searchsorted(text[at], np.arange(n + 1))


def fingerprints(w: tb.Words, n: int) -> list[bytes | None]:
    """128-bit digest of each text's word sequence; None without words."""
    return [hashlib.blake2b(w.hash[w.bounds[i]:w.bounds[i + 1]].tobytes(), digest_size=16).digest() if w.bounds[i + 1] > w.bounds[i] else None for i in range(n)]


def bands(ids: np.ndarray, count: int = BANDS) -> np.ndarray:
    """One key per band: the dart ids of its coordinates, hashed together with the band's number."""
    sets, size = ids.shape
    rows = size // count
    key = np.zeros((sets, count), dtype=np.uint64)
    for r in range(rows):
        key = tb.mix(key + BAND_STEP) ^ ids[:, r::rows][:, :count]
    return tb.mix(key + np.arange(count, dtype=np.uint64) * tb.BASE).view(np.int64)


def sketch(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, n_bands: int = BANDS, rows: int = ROWS, counted: bool = False) -> DataFrame:
    """doc_id, fp (digest of the words, null without words) and the band keys, row by row."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = tb.column(batch, "t")
            for t in tb.slices(col):
                w = tb.words(t)
                h, weight, bounds = shingles(w, t.n, size, counted)
                keys = bands(throw(h, weight, bounds, n_bands * rows), n_bands)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(t.first, t.n), pa.array(fingerprints(w, t.n), pa.binary()), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), n_bands).cast(pa.list_(pa.int64()))],
                    names=["doc_id", "fp", "keys"])

    return docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).mapInArrow(scan, f"doc_id {kind}, fp binary, keys array<bigint>")


def _weights_of(docs: DataFrame, size: int, counted: bool) -> DataFrame:
    """fp and its shingles in hash order, packed: 8 bytes of hash, 4 of weight each."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in tb.slices(tb.column(batch, "t")):
                w = tb.words(t)
                h, weight, bounds = shingles(w, t.n, size, counted)
                packed = [h[a:b].tobytes() + weight[a:b].astype(np.float32).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(fingerprints(w, t.n), pa.binary()), pa.array(packed, pa.binary())], names=["fp", "packed"])

    return docs.select("t").mapInArrow(scan, "fp binary, packed binary")


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(packed) // 12
    return np.frombuffer(packed, np.uint64, n), np.frombuffer(packed, np.float32, n, 8 * n).astype(float)


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two packed shingle lists."""
    (x, wx), (y, wy) = _unpacked(a), _unpacked(b)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    low = float(np.minimum(wx[i], wy[j]).sum())
    return low / (float(wx.sum()) + float(wy.sum()) - low) if len(x) and len(y) else 0.0


def _verified(pairs: DataFrame, packed: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose exact similarity is at least ``least``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similarity(p.as_py(), q.as_py()) >= least for p, q in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    left = packed.select(F.col("fp").alias("a"), F.col("packed").alias("p"))
    right = packed.select(F.col("fp").alias("b"), F.col("packed").alias("q"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "p", "q").mapInArrow(scan, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """fp and root for every node of the links, root being the least node of its component.

    Each round every node takes the least root among its neighbours, roots then
    follow their own root; rounds end when no root changes.
    """
    both = settle(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    roots = settle(both.groupBy(F.col("a").alias("fp")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("fp").alias("b"), "root"), "b").groupBy(F.col("a").alias("fp")).agg(F.min("root").alias("near"))
        step = roots.join(near, "fp").select("fp", F.least("root", "near").alias("next"), "root")
        jump = step.select(F.col("fp").alias("next"), F.col("next").alias("far"))
        step = settle(step.join(jump, "next", "left").select("fp", F.least("next", F.coalesce("far", "next")).alias("root"), F.col("root").alias("old")), "roots")
        if step.filter(F.col("root") != F.col("old")).isEmpty():
            return step.select("fp", "root")
        roots = step.select("fp", "root")


def members(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, least: float = SIMILARITY, n_bands: int = BANDS, rows: int = ROWS, counted: bool = False) -> DataFrame:
    """One row per document: doc_id, class_id, fp, head (fp of the kept text).

    See ``classes`` for the meaning.
    """
    made = settle(sketch(docs, doc_id, text, size, n_bands, rows, counted), "sketch", BATCH)
    texts = made.filter("fp IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"))
    texts = settle(texts, "texts")
    listed = texts.select("fp", F.explode("keys").alias("key"))
    shared = listed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    spots = settle(listed.join(shared, "key"), "spots")
    degree = spots.groupBy("fp").agg(F.sum("n").alias("degree"))
    ids = texts.join(spots.select("fp").distinct(), "fp", "left_semi").select("fp", "doc_id")
    wanted = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(ids.select(F.col("doc_id").alias("w")).distinct(), F.expr("i <=> w"), "left_semi")
    packed = settle(_weights_of(wanted, size, counted).join(ids.select("fp"), "fp", "left_semi").dropDuplicates(["fp"]), "packed", BATCH)
    spots = settle(spots.select("key", "fp").join(degree, "fp"), "spots")
    links = settle(_verified(settle(_leader_pairs(spots), "pairs"), packed, least), "links", BATCH)
    rest = settle(_split_links(spots, components(links), packed, least), "links", BATCH)
    links = links.unionByName(rest)
    return _result(made, texts, components(links))


def _leader_pairs(spots: DataFrame) -> DataFrame:
    """Pairs of each bucket's leader, its member with most company overall, with the other members."""
    lead = spots.groupBy("key").agg(F.max_by("fp", F.struct("degree", "fp")).alias("lead"))
    pairs = spots.join(lead, "key").filter("fp <> lead")
    return pairs.select(F.least("fp", "lead").alias("a"), F.greatest("fp", "lead").alias("b")).distinct()


def _split_links(spots: DataFrame, roots: DataFrame, packed: DataFrame, least: float) -> DataFrame:
    """Links between components that share a bucket, one per outlier and component.

    Outliers of a bucket are its members outside its largest component; they
    meet all members of other components. Both sides are cut into blocks of
    bounded size. Buckets of two are settled, their only pair was compared.
    """
    known = spots.join(roots, "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    known = known.join(packed.select("fp", F.octet_length("packed").alias("bytes")), "fp")
    sizes = known.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    main = F.max(F.struct("n", "root", "bytes"))
    split = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), main.alias("m")).filter("n > 2 AND m.n < n")

    def blocks(n, size, most: int, most_bytes: int):
        return F.ceil(F.greatest(n / most, size / most_bytes))

    n, size = F.col("n"), F.col("bytes")
    split = split.select("key", F.col("m.root").alias("main"), blocks(n - F.col("m.n"), size - F.col("m.bytes"), BLOCK_OUT, BLOCK_OUT_BYTES).alias("outs"), blocks(n, size, BLOCK_ALL, BLOCK_ALL_BYTES).alias("alls"))
    known = known.drop("bytes")
    marked = settle(known.join(split, "key"), "split")
    share = F.xxhash64("fp")
    full = marked.join(packed, "fp").select("key", "fp", "root", "main", "outs", "alls", "packed")
    left = full.filter("root <> main").withColumn("o", F.pmod(share, "outs")).withColumn("m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("alls") - 1)))
    right = full.withColumn("m", F.pmod(share, "alls")).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("outs") - 1)))
    unit, rest = ["key", "o", "m"], ["fp", "root", "packed"]

    def meet(outs: pa.Table, alls: pa.Table) -> pa.Table:
        if not outs.num_rows or not alls.num_rows:
            return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
        sets = [_unpacked(p.as_py()) for p in alls.column("packed")]
        sizes = np.array([len(x) for x, _ in sets])
        flat, weight = np.concatenate([x for x, _ in sets] or [np.zeros(0, np.uint64)]), np.concatenate([w for _, w in sets] or [np.zeros(0)])
        vocab, at = np.unique(flat, return_inverse=True)
        total = np.array([w.sum() for _, w in sets])
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        names, owner = alls.column("fp").to_pylist(), alls.column("root").to_pylist()
        found: dict[tuple[bytes, bytes], bytes] = {}
        for fp, root, p in zip(*[outs.column(f"out_{c}").to_pylist() for c in rest], strict=True):
            x, w = _unpacked(p)
            mine = np.zeros(len(vocab))
            spot = np.minimum(np.searchsorted(vocab, x), len(vocab) - 1)
            there = vocab[spot] == x
            mine[spot[there]] = w[there]
            low = np.add.reduceat(np.minimum(mine[at], weight), begin)
            for k in np.flatnonzero(low >= least * (total + w.sum() - low) * (1 - 1e-12)):
                if owner[k] != root:
                    found[fp, owner[k]] = min(found.get((fp, owner[k]), names[k]), names[k])
        return pa.table({"a": pa.array([min(k[0], v) for k, v in found.items()], pa.binary()), "b": pa.array([max(k[0], v) for k, v in found.items()], pa.binary())})

    # own names for one side: both come from the same rows
    left = left.select(*[F.col(c).alias(f"out_{c}") for c in [*unit, *rest]])
    pairs = left.groupBy(*[f"out_{c}" for c in unit]).cogroup(right.select(*unit, *rest).groupBy(*unit)).applyInArrow(meet, "a binary, b binary")
    return pairs.distinct()


def _result(made: DataFrame, texts: DataFrame, roots: DataFrame) -> DataFrame:
    tied = roots.join(texts.select("fp", "doc_id"), "fp")
    best = tied.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.min_by("fp", F.struct(F.col("doc_id").isNull(), "doc_id", "fp")).alias("head"))
    tied = tied.join(best, "root").select("fp", "class_id", "head")
    member = texts.select("fp", "doc_id").join(tied, "fp", "left").select("fp", F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("head", "fp").alias("head"))
    alone = made.filter("fp IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), "fp", F.col("fp").alias("head"))
    return made.filter("fp IS NOT NULL").select("doc_id", "fp").join(member, "fp").select("doc_id", "class_id", "fp", "head").union(alone)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, least: float = SIMILARITY, n_bands: int = BANDS, rows: int = ROWS, counted: bool = False) -> DataFrame:
    """One row per document: doc_id, class_id, is_kept.

    ``class_id`` is the least doc_id of the class; ``is_kept`` marks the rows of
    the class's kept text that carry class_id. Equal word sequences are
    one text. Texts without words (null, empty, punctuation only) form no class:
    class_id is their own id and they are kept. Fewer words than ``size`` make
    one shingle. A null doc_id takes part and counts as the largest. Repeated
    rows give repeated rows. ``counted`` weighs a shingle by its count instead
    of 1. An empty table gives an empty result.
    """
    m = members(docs, doc_id, text, size, least, n_bands, rows, counted)
    return m.select("doc_id", "class_id", (F.expr("fp <=> head") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("is_kept"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, least: float = SIMILARITY, n_bands: int = BANDS, rows: int = ROWS, counted: bool = False) -> DataFrame:
    """The documents with one row of each class left, all columns kept.

    The row of the least doc_id stays; of fully repeated rows one stays; rows
    without words all stay.
    """
    head = members(docs, doc_id, text, size, least, n_bands, rows, counted).filter("fp IS NOT NULL AND fp = head").groupBy("fp").agg(F.min("class_id").alias("id"))
    i, fp = tb.free_name(docs.columns, "kept_id"), tb.free_name(docs.columns, "text_digest")
    field = docs.schema.names.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[bytes | None] = []
            for t in tb.slices(batch.column(field)):
                made += fingerprints(tb.words(t), t.n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, fp])

    wordless = F.col(text).isNull() | ~F.col(text).rlike("[0-9A-Za-z]|[^\\x00-\\x7F]")
    marked = docs.filter(~wordless).mapInArrow(scan, StructType([*docs.schema.fields, StructField(fp, BinaryType())]))
    head = head.select(F.col("fp").alias(fp), F.col("id").alias(i))
    kept = marked.join(head, fp).filter(F.col(doc_id).eqNullSafe(F.col(i))).dropDuplicates([fp])
    return kept.select(*docs.columns).union(docs.filter(wordless))
