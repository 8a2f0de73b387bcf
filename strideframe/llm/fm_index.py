"""Benchmark decontamination with a full-text index per training shard.

A shard is a run of whole documents of one partition. Its words become symbols,
a suffix array gives the Burrows-Wheeler order, a wavelet matrix answers rank
queries on it, and every sixteenth suffix position is kept. Test phrases (all
windows of ten consecutive words of an item) are searched backward, all at
once; surviving intervals are located by walking to the next kept position;
hit words are merged into removal spans.

Nothing is shuffled and nothing but test items travels: items go out in blocks
of bounded size, and each further block is one more pass over the same rows,
written before the next block is sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm import textbytes as tb
from strideframe.session import discard, settle

WINDOW = 10
SHARD_WORDS = 250_000
KEEP_EVERY = 16
#: text of test items that one pass carries; a window costs about 100 bytes of memory, and there are fewer windows than half the bytes
BLOCK_BYTES = 4 << 20


def suffix_array(sym: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; only undecided groups are sorted again.

    No two suffixes may be equal, which distinct separators ensure.
    """
    n = len(sym)
    narrow = np.int32 if n < 1 << 31 else np.int64
    sa = np.argsort(sym, kind="stable").astype(narrow)
    lead = np.ones(n, dtype=bool)
    lead[1:] = sym[sa[1:]] != sym[sa[:-1]]
    rank = np.zeros(n + 1, dtype=narrow)
    rank[sa] = np.maximum.accumulate(np.where(lead, np.arange(n, dtype=narrow), 0))
    step = 1
    while True:
        single = lead.copy()
        single[:-1] &= lead[1:]
        open_ = np.flatnonzero(~single)
        if not len(open_):
            return sa
        pos = sa[open_]
        key = rank[pos].astype(np.int64) * (n + 1) + np.where(pos + step < n, rank[np.minimum(pos + step, n)] + 1, 0)
        order = np.argsort(key)
        pos, key = pos[order], key[order]
        sa[open_] = pos
        fresh = np.ones(len(pos), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        lead[open_] = fresh
        rank[pos] = np.maximum.accumulate(np.where(fresh, open_, 0))
        step *= 2


class WaveletMatrix:
    """Rank and access on a symbol sequence, one bit row per binary digit."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.rows: list[tuple[np.ndarray, np.ndarray, int]] = []
        n = len(seq)
        pad = -(-(n + 1) // 64) * 64
        for level in range(self.levels - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(bool)
            full = np.zeros(pad, dtype=np.uint8)
            full[:n] = bit
            packed = np.packbits(full, bitorder="little").view(np.uint64)
            ahead = np.zeros(len(packed), dtype=np.int32 if n < 1 << 31 else np.int64)
            np.cumsum(np.bitwise_count(packed[:-1]), out=ahead[1:])
            self.rows.append((packed, ahead, n - int(bit.sum())))
            seq = np.concatenate((seq[~bit], seq[bit]))

    @staticmethod
    def _ones(row: tuple[np.ndarray, np.ndarray, int], i: np.ndarray) -> np.ndarray:
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return row[1][word] + np.bitwise_count(row[0][word] & mask)

    def descend(self, sym: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i of the sequence lands among the sorted symbols, followed along ``sym``."""
        for k, row in enumerate(self.rows):
            ones = self._ones(row, i)
            i = np.where((sym >> (self.levels - 1 - k)) & 1, row[2] + ones, i - ones)
        return i

    def follow(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at position i, and where that occurrence lands."""
        sym = np.zeros(len(i), dtype=np.int64)
        for row in self.rows:
            bit = (row[0][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)
            ones = self._ones(row, i)
            i = np.where(bit, row[2] + ones, i - ones)
            sym = (sym << 1) | bit.astype(np.int64)
        return sym, i


class ShardIndex:
    """Index over the words of some documents; phrases never run across two documents."""

    def __init__(self, hashes: list[np.ndarray], keep_every: int = KEEP_EVERY):
        docs = len(hashes)
        sizes = np.array([len(h) for h in hashes], dtype=np.int64)
        #: word w of document d is token starts[d] + w; each document ends with a separator
        self.starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1] if docs else np.zeros(0, np.int64)
        n = int(sizes.sum()) + docs
        stop = self.starts + sizes
        flat = np.zeros(n, dtype=np.uint64)
        is_word = np.ones(n, dtype=bool)
        is_word[stop] = False
        flat[is_word] = np.concatenate(hashes) if docs else flat
        self.vocab, ids = np.unique(flat[is_word], return_inverse=True)
        order_sym = np.empty(n, dtype=np.int32 if n < 1 << 31 else np.int64)
        order_sym[stop] = np.arange(docs)
        order_sym[is_word] = ids + docs
        sa = suffix_array(order_sym)
        sym = np.zeros(n, dtype=np.int32)
        sym[is_word] = ids + 1
        self.n = n
        self.less = np.concatenate(([0], np.cumsum(np.bincount(sym, minlength=len(self.vocab) + 1))))
        self.tree = WaveletMatrix(sym[sa - 1], len(self.vocab) + 1)
        kept = np.zeros(n, dtype=bool)
        kept[::keep_every] = True
        kept[self.starts] = True
        self.kept = kept[sa]
        self.kept_before = np.cumsum(self.kept, dtype=sa.dtype) - 1
        self.kept_position = sa[self.kept]

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of words, 0 for a word that the shard lacks."""
        if not len(self.vocab):
            return np.zeros(hashes.shape, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.vocab, hashes), len(self.vocab) - 1)
        return np.where(self.vocab[at] == hashes, at + 1, 0)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of equally long phrases: (phrase, low, high) of those that occur."""
        sym = self.symbols(phrases)
        live = np.flatnonzero((sym > 0).all(axis=1))
        sym = sym[live]
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.n, dtype=np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            if not len(live):
                break
            c = sym[:, k]
            floor = self.tree.descend(c, np.zeros(len(c), np.int64))
            base = self.less[c] - floor
            low, high = base + self.tree.descend(c, low), base + self.tree.descend(c, high)
            ok = low < high
            live, sym, low, high = live[ok], sym[ok], low[ok], high[ok]
        return live, low, high

    def locate(self, slot: np.ndarray) -> np.ndarray:
        """Token positions of suffix slots, by stepping back to kept ones."""
        out = np.full(len(slot), -1, dtype=np.int64)
        todo, at, steps = np.arange(len(slot)), slot.copy(), 0
        while len(todo):
            hit = self.kept[at]
            out[todo[hit]] = self.kept_position[self.kept_before[at[hit]]] + steps
            todo, at = todo[~hit], at[~hit]
            if len(todo):
                sym, landed = self.tree.follow(at)
                at = self.less[sym] + landed - self.tree.descend(sym, np.zeros(len(sym), np.int64))
            steps += 1
        return out


class Phrases:
    """Distinct windows of some test items, by length, with the items that hold them.

    Everything is arrays: a row of word hashes per window, and the places of its
    items in ``names`` as one flat list with offsets.
    """

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        self.names = sorted({x for x, _ in items}, key=lambda x: (x is None, x))
        at = {x: i for i, x in enumerate(self.names)}
        rows: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        for t in tb.slices(pa.array([x for _, x in items], pa.large_string())):
            w = tb.words(t)
            count = np.diff(w.bounds)
            who = np.array([at[items[t.first + i][0]] for i in range(t.n)], dtype=np.int32)
            for size in np.unique(np.minimum(count, window)):
                mine = np.flatnonzero(np.minimum(count, window) == size)
                if size:
                    made = count[mine] - size + 1
                    text = np.repeat(mine, made)
                    begin = w.bounds[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(made) - made, made)
                    rows.setdefault(int(size), []).append(np.lib.stride_tricks.sliding_window_view(w.hash, size)[begin])
                    owners.setdefault(int(size), []).append(who[text])
        self.sets = [(size, *self._distinct(np.concatenate(rows.pop(size)), np.concatenate(owners.pop(size)))) for size in sorted(rows)]

    def _distinct(self, rows: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct rows, and per row a range of ``owners``."""
        whole = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel()
        _, first, number = np.unique(whole, return_index=True, return_inverse=True)
        pair = np.unique(number.astype(np.int64) * len(self.names) + owner)
        return rows[first], np.searchsorted(pair // len(self.names), np.arange(len(first) + 1)).astype(np.int32), (pair % len(self.names)).astype(np.int32)


def shard_hits(hashes: list[np.ndarray], phrases: Phrases) -> tuple[list[np.ndarray], list[set]]:
    """Per document which words are hit, and the ids of the items that occur."""
    index = ShardIndex(hashes)
    edge = np.zeros(index.n + 1, dtype=np.int32)
    found: list[set] = [set() for _ in hashes]
    for size, table, begin, owners in phrases.sets:
        which, low, high = index.search(table)
        if not len(which):
            continue
        span = high - low
        slot = np.repeat(low - np.concatenate(([0], np.cumsum(span)[:-1])), span) + np.arange(span.sum())
        position = index.locate(slot)
        np.add.at(edge, position, 1)
        np.add.at(edge, position + size, -1)
        doc = np.searchsorted(index.starts, position, "right") - 1
        for d, p in np.unique(np.stack((doc, np.repeat(which, span))), axis=1).T:
            found[d].update(phrases.names[k] for k in owners[begin[p]:begin[p + 1]])
    covered = np.cumsum(edge[:-1]) > 0
    return [covered[s:s + len(h)] for s, h in zip(index.starts, hashes, strict=True)], found


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _shards(batches: Iterator[pa.RecordBatch], text: str, shard_words: int) -> Iterator[tuple[pa.Table, list[str | None], list[np.ndarray]]]:
    """Rows in shards: the table, its texts, and each text's word hashes. One shard is held at a time."""
    rows: list[pa.RecordBatch] = []
    hashes: list[np.ndarray] = []
    total = 0

    def shard() -> tuple[pa.Table, list[str | None], list[np.ndarray]]:
        nonlocal rows, hashes, total
        table, made = pa.Table.from_batches(rows), hashes
        rows, hashes, total = [], [], 0
        return table, table.column(text).to_pylist(), made

    for batch in batches:
        lo = 0
        for t in tb.slices(tb.column(batch, text)):
            w = tb.words(t)
            # copies, so that a text's hashes do not keep its whole slice
            hashes += [w.hash[w.bounds[i]:w.bounds[i + 1]].copy() for i in range(t.n)]
            total += len(w.hash)
            if total >= shard_words:
                hi = t.first + t.n
                rows.append(batch.slice(lo, hi - lo))
                lo = hi
                yield shard()
        if lo < batch.num_rows:
            rows.append(batch.slice(lo))
        del batch
    if rows:
        yield shard()
    tb.give_back()


def _hits_of_shard(texts: list[str | None], hashes: list[np.ndarray], phrases: Phrases) -> tuple[list[np.ndarray], list[set]]:
    """Equal word sequences of a shard are indexed once."""
    slot: dict[bytes, int] = {}
    at = [slot.setdefault(h.tobytes(), len(slot)) for h in hashes]
    first = {}
    for i, s in enumerate(at):
        first.setdefault(s, i)
    hit, found = shard_hits([hashes[first[s]] for s in range(len(slot))], phrases)
    return [hit[s] for s in at], [found[s] for s in at]


def _char_runs(text: str | None, hit: np.ndarray) -> list[tuple[int, int]]:
    if text is None or not hit.any():
        return []
    t = next(tb.slices(pa.array([text], pa.large_string())))
    w = tb.words(t)
    chars = tb.char_starts(t.data)
    begin, stop = _runs(hit)
    return [(int(chars[w.start[a]]), int(chars[w.end[b - 1]])) for a, b in zip(begin, stop, strict=True)]


def cut(text: str, runs: list[tuple[int, int]]) -> str:
    """The text without the runs; a line break stands where one was."""
    out, at = [], 0
    for a, b in runs:
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return "\n".join(x.strip(" ") for x in out).strip("\n") if runs else text


def item_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, str]]]:
    """Test items in blocks of about ``block_bytes``, so that what one pass carries is bounded.

    The bound is per block, plus the longest single item. A null text has no words.
    """
    slim = _slim(items, item_id, text)
    count = _block_count(items, item_id, text, block_bytes)
    for k in range(count):
        part = slim if count == 1 else slim.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def _slim(items: DataFrame, item_id: str, text: str) -> DataFrame:
    return items.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text")).filter("text IS NOT NULL").distinct()


def _block_count(items: DataFrame, item_id: str, text: str, block_bytes: int) -> int:
    size = _slim(items, item_id, text).agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return -(-size // block_bytes) or 1


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW,
               shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Which words of each document stand in a window of a test item.

    Returns the ``keep`` columns, ``n_words``, ``n_hit``, ``items`` (ids as
    strings, distinct, sorted, a null id left out), ``n_items`` (a null id
    counts as one) and ``runs`` (merged removal spans, in characters, end
    exclusive). A word is a run of digits, letters a-z after lower-casing A-Z,
    and non-ASCII characters. Null and empty texts have no words; repeated rows
    get equal results; without items nothing is hit. One row out per row in.
    """
    schema = docs.select(*keep).schema.simpleString()[7:-1]
    runs = "array<struct<start:bigint,stop:bigint>>"
    out_schema = f"{schema}{',' if schema else ''}n_words bigint,n_hit bigint,items array<string>,n_items bigint,runs {runs}"
    if _block_count(items, "item_id", text, block_bytes) > 1:
        return _many_blocks(docs, items, text, keep, window, shard_words, block_bytes, out_schema)
    shared = docs.sparkSession.sparkContext.broadcast(next(item_blocks(items, text=text, block_bytes=block_bytes)))
    inner = tb.free_name(list(keep), "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(shared.value, window)
        for table, texts, hashes in _shards(batches, inner, shard_words):
            hit, found = _hits_of_shard(texts, hashes, phrases)
            yield from _emit(table, keep, texts, hashes, hit, found)

    return docs.select(*keep, F.col(text).alias(inner)).mapInArrow(scan, out_schema)


def _emit(table: pa.Table, keep: tuple[str, ...], texts: list, hashes: list, hit: list, found: list) -> Iterator[pa.RecordBatch]:
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    spans = [[{"start": a, "stop": b} for a, b in _char_runs(x, h)] for x, h in zip(texts, hit, strict=True)]
    named = [sorted(x for x in f if x is not None) for f in found]
    cols = [table.column(c) for c in keep]
    cols += [pa.array([len(h) for h in hashes], pa.int64()), pa.array([int(h.sum()) for h in hit], pa.int64()), pa.array(named, pa.list_(pa.string())), pa.array([len(f) for f in found], pa.int64()), pa.array(spans, runs_type)]
    yield from pa.table(cols, names=[*keep, "n_words", "n_hit", "items", "n_items", "runs"]).to_batches()


def _bits(packed: bytes | None, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool) if packed else np.zeros(n, bool)


def _search_blocks(df: DataFrame, items: DataFrame, text: str, item_text: str, seen: str, ids: str | None, window: int, shard_words: int, block_bytes: int) -> DataFrame:
    """One pass per block over rows that carry the words hit (bits in ``seen``) and the items found so far.

    Each pass is written before the next block is collected, so driver and
    tasks hold one block at any time.
    """
    settled = None
    for block in item_blocks(items, text=item_text, block_bytes=block_bytes):
        shared = df.sparkSession.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            phrases = Phrases(shared.value, window)
            for table, texts, hashes in _shards(batches, text, shard_words):
                hit, found = _hits_of_shard(texts, hashes, phrases)
                hit = [h | _bits(b, len(h)) for h, b in zip(hit, table.column(seen).to_pylist(), strict=True)]
                at = table.schema.get_field_index(seen)
                table = table.set_column(at, table.schema.field(at), pa.array([np.packbits(h).tobytes() if h.any() else b"" for h in hit], pa.binary()))
                if ids:
                    at = table.schema.get_field_index(ids)
                    table = table.set_column(at, table.schema.field(at), pa.array([list(f | set(x)) for f, x in zip(found, table.column(ids).to_pylist(), strict=True)], table.schema.field(at).type))
                yield from table.to_batches()

        df = settle(df.mapInArrow(scan, df.schema), "leaks")
        shared.destroy()
        if settled is not None:
            discard(settled)
        settled = df
    return df


def _many_blocks(docs: DataFrame, items: DataFrame, text: str, keep: tuple[str, ...], window: int, shard_words: int, block_bytes: int, out_schema: str) -> DataFrame:
    """What all blocks hit, one after another."""
    inner = tb.free_name(list(keep), "text")
    seen = tb.free_name([*keep, inner], "seen")
    ids = tb.free_name([*keep, inner, seen], "ids")
    df = docs.select(*keep, F.col(text).alias(inner), F.lit(b"").cast("binary").alias(seen), F.array().cast("array<string>").alias(ids))
    df = _search_blocks(df, items, inner, text, seen, ids, window, shard_words, block_bytes)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts, hashes in _shards(batches, inner, shard_words):
            hit = [_bits(b, len(h)) for b, h in zip(table.column(seen).to_pylist(), hashes, strict=True)]
            yield from _emit(table, keep, texts, hashes, hit, [set(x) for x in table.column(ids).to_pylist()])

    return df.mapInArrow(emit, out_schema)


def _without_many_blocks(docs: DataFrame, items: DataFrame, text: str, window: int, shard_words: int, block_bytes: int) -> DataFrame:
    """Hits of all blocks are cut together; texts that changed are searched again in all blocks until none is hit."""
    columns = docs.columns
    seen = tb.free_name(columns, "seen")
    todo, done = docs, None
    while True:
        found = _search_blocks(todo.withColumn(seen, F.lit(b"").cast("binary")), items, text, text, seen, None, window, shard_words, block_bytes)
        clean = found.filter(F.octet_length(seen) == 0).select(*columns)
        done = clean if done is None else done.unionByName(clean)
        changed = found.filter(F.octet_length(seen) > 0)
        if changed.isEmpty():
            return done

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.get_field_index(text)
                texts = batch.column(at).to_pylist()
                for i, bits in enumerate(batch.column(batch.schema.get_field_index(seen)).to_pylist()):
                    t = next(tb.slices(pa.array([texts[i]], pa.large_string())))
                    texts[i] = cut(texts[i], _char_runs(texts[i], _bits(bits, len(tb.words(t).hash))))
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
                yield batch.select(columns)

        todo = changed.mapInArrow(scan, docs.schema)


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with every hit word cut out, all their columns kept.

    Cutting may bring words together into a new window, so changed texts are
    searched again until nothing is hit. Hits of all blocks are cut together. A text that was all benchmark becomes
    empty; null stays null; rows without hits are untouched.
    """
    if _block_count(items, "item_id", text, block_bytes) > 1:
        return _without_many_blocks(docs, items, text, window, shard_words, block_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(next(item_blocks(items, text=text, block_bytes=block_bytes)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(shared.value, window)
        for table, texts, hashes in _shards(batches, text, shard_words):
            todo = np.arange(len(texts))
            while len(todo):
                hit, _ = _hits_of_shard([texts[i] for i in todo], [hashes[i] for i in todo], phrases)
                todo, hit = zip(*[(i, h) for i, h in zip(todo, hit, strict=True) if h.any()], strict=True) if any(h.any() for h in hit) else ([], [])
                for i, h in zip(todo, hit, strict=True):
                    texts[i] = cut(texts[i], _char_runs(texts[i], h))
                    t = next(tb.slices(pa.array([texts[i]], pa.large_string())))
                    hashes[i] = tb.words(t).hash
            at = table.schema.get_field_index(text)
            yield from table.set_column(at, table.schema.field(at), pa.array(texts, table.schema.field(at).type)).to_batches()

    return docs.mapInArrow(scan, docs.schema)
