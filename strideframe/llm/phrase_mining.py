r"""Collocations counted over a prefix-free parse of the corpus.

Texts are parsed into chunks that begin and end at trigger windows, which their
own three words decide, so equal passages give equal chunks wherever they
stand. Neighbouring chunks share the trigger window: a phrase of up to four
words lies whole in the chunk in whose body it begins, and is counted there
alone. Equal chunks are counted once, weighted by their frequency in the parse.

The dictionary of distinct chunks is packed into shards of bounded size. Each
shard counts its phrases with numpy on exact word numbers:

1. words and pairs leave as (48-bit hash, count), dealt by hash; a hash whose
   total stays below the threshold cannot belong to a frequent phrase,
2. each shard gets back the hashes that reached it, and sends the texts and
   exact counts of just these words and pairs, and of the three- and four-word
   phrases all of whose pairs are among them.

Totals of step 2 are exact whatever hashes collide: a collision lets a phrase
through to be counted, it never hides one. No word, pair or chunk needs a task
of its own, since every shard sends one row for each of its distinct phrases.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strideframe.llm import textbytes as tb
from strideframe.session import discard, scratch_path, settle

MIN_COUNT, MAX_WORDS, TOP = 30, 4, 2000
NESTED_PERCENT, SCORE_SCALE = 80, 2_000_000
#: words of a trigger window, and so of the overlap: one less than the longest phrase
OVERLAP = MAX_WORDS - 1
#: one window in so many is a trigger; a body never passes LONGEST_BODY words
TRIGGER_EVERY, LONGEST_BODY = 32, 4096
SHARD_WORDS, BUCKET_WORDS = 4_000_000, 2_000_000
#: ranks are taken per share of a language first
RANK_SHARES = 64

#: what ends a piece, and what parts words
BREAKS = np.zeros(256, dtype=bool)
for _c in b".,;:!?\n\x0b\x0c\r":
    BREAKS[_c] = True
WORD = ~BREAKS
WORD[32] = WORD[9] = False

_M = np.uint64(0x9E3779B97F4A7C15)


def _windows(h: np.ndarray) -> np.ndarray:
    """Hash of the trigger window that begins at each word (wrong at the last ones, which begin none)."""
    out = h
    for k in range(1, OVERLAP):
        ahead = np.zeros_like(h)
        ahead[:-k] = h[k:]
        out = tb.mix(out * _M + ahead)
    return out


def body_starts(h: np.ndarray, bounds: np.ndarray, every: int = TRIGGER_EVERY, longest: int = LONGEST_BODY) -> np.ndarray:
    """Words at which chunk bodies begin, for texts whose words are ``bounds`` ranges of ``h``.

    A text's first word begins one, and so does each trigger window that lies
    whole in the text; longer bodies are cut every ``longest`` words.
    """
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    room = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    begins = (_windows(h) % np.uint64(every) == 0) & (room >= OVERLAP)
    begins[bounds[:-1][np.diff(bounds) > 0]] = True
    starts = np.flatnonzero(begins)
    gap = np.diff(np.append(starts, n))
    if gap.max() > longest:
        more = [np.arange(s + longest, s + g, longest) for s, g in zip(starts[gap > longest], gap[gap > longest], strict=True)]
        more = np.concatenate(more)
        starts = np.sort(np.concatenate((starts, more[room[more] >= OVERLAP])))
    return starts


def _gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.LargeBinaryArray:
    """Byte ranges of ``data``, which may overlap, as one Arrow array."""
    size = end - start
    offs = np.concatenate(([0], np.cumsum(size)))
    flat = data[np.repeat(start - offs[:-1], size) + np.arange(offs[-1])]
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offs.astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, text)`` to ``(lang, chunk, is_last)``."""
    for batch in batches:
        langs = batch.column("lang")
        for t in tb.slices(tb.column(batch, "text")):
            w = tb.words(t, table=WORD)
            starts = body_starts(w.hash, w.bounds)
            if not len(starts):
                continue
            owner = np.searchsorted(w.bounds, starts, "right") - 1
            stop = w.bounds[owner + 1]
            following = np.append(starts[1:], len(w.hash))
            is_last = following >= stop
            end = w.end[np.where(is_last, stop, following + OVERLAP) - 1]
            chunk = _gather(tb.LOWER[t.data], w.start[starts], end).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(owner + t.first)), chunk, pa.array(is_last)], names=["lang", "chunk", "is_last"])


def dictionary(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Distinct chunks of the parse: ``(lang, chunk, is_last, freq)``; a null language is ``und``."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).filter("text IS NOT NULL")
    return rows.mapInArrow(_parse, "lang string,chunk binary,is_last boolean").groupBy("lang", "chunk", "is_last").agg(F.count(F.lit(1)).alias("freq"))


def _press(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpress(raw: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


class _Shard:
    """Words of some chunks as numbers into an exact vocabulary, with what the counts need.

    ``ids`` numbers each word, ``joined`` says that the next word follows in the
    same piece and chunk, ``weight`` is the chunk's frequency for words of its
    body and 0 for those of the shared window.
    """

    COLUMNS = "shard bigint,n_words bigint,langs array<string>,lang_of binary,words array<binary>,ids binary,joined binary,weight binary"

    def __init__(self, langs: list[str], lang_of: np.ndarray, words: pa.Array, ids: np.ndarray, joined: np.ndarray, weight: np.ndarray):
        self.langs, self.lang_of, self.words, self.ids, self.joined, self.weight = langs, lang_of, words, ids, joined, weight

    @classmethod
    def of(cls, rows: pa.Table) -> _Shard:
        """From dictionary rows: words are split again, and numbered per language."""
        langs = pc.unique(rows.column("lang")).to_pylist()
        lang = pc.index_in(rows.column("lang"), value_set=pa.array(langs)).to_numpy()
        freq, is_last = rows.column("freq").to_numpy(), rows.column("is_last").to_numpy()
        texts, owner, joined, weight, at = [], [], [], [], 0
        for t in tb.slices(rows.column("chunk").combine_chunks().cast(pa.large_binary()).view(pa.large_string())):
            w = tb.words(t, lower=False, table=WORD)
            size = np.diff(w.bounds)
            breaks = np.concatenate(([0], np.cumsum(BREAKS[t.data])))
            j = np.zeros(len(w.start), dtype=bool)
            j[:-1] = breaks[w.start[1:]] == breaks[w.start[:-1]]
            j[w.bounds[1:][size > 0] - 1] = False
            chunk = np.repeat(np.arange(t.n), size)
            left = w.bounds[1:][chunk] - np.arange(len(chunk))
            rows_at = chunk + at
            texts.append(_gather(t.data, w.start, w.end))
            owner.append(lang[rows_at].astype(np.int32))
            joined.append(j)
            weight.append(np.where(is_last[rows_at] | (left > OVERLAP), freq[rows_at], 0))
            at += t.n
        coded = pa.chunked_array(texts, pa.large_binary()).combine_chunks().dictionary_encode()
        owner = np.concatenate(owner)
        pair, ids = np.unique(coded.indices.to_numpy().astype(np.int64) * len(langs) + owner, return_inverse=True)
        return cls(langs, (pair % len(langs)).astype(np.int32), coded.dictionary.take(pa.array(pair // len(langs))), ids.astype(np.int32), np.concatenate(joined), np.concatenate(weight))

    def pack(self, number: int) -> pa.RecordBatch:
        cols = [pa.array([number], pa.int64()), pa.array([len(self.ids)], pa.int64()), pa.array([self.langs], pa.list_(pa.string())), pa.array([_press(self.lang_of)], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(self.words)], pa.int32()), self.words.cast(pa.binary())),
                pa.array([_press(self.ids)], pa.binary()), pa.array([_press(np.packbits(self.joined))], pa.binary()), pa.array([_press(self.weight)], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["shard", "n_words", "langs", "lang_of", "words", "ids", "joined", "weight"])

    @classmethod
    def unpack(cls, batch: pa.RecordBatch | pa.Table, i: int) -> _Shard:
        one = {n: batch.column(n)[i] for n in batch.schema.names}
        ids = _unpress(one["ids"].as_py(), np.int32)
        joined = np.unpackbits(_unpress(one["joined"].as_py(), np.uint8), count=len(ids)).astype(bool)
        return cls(one["langs"].as_py(), _unpress(one["lang_of"].as_py(), np.int32), one["words"].values.cast(pa.large_binary()), ids, joined, _unpress(one["weight"].as_py(), np.int64))

    def word_hashes(self) -> np.ndarray:
        every = np.ones(256, dtype=bool)
        salt = tb.mix(np.array([zlib.crc32(x.encode()) for x in self.langs], dtype=np.uint64))
        found = [tb.words(t, lower=False, table=every).hash for t in tb.slices(self.words.view(pa.large_string()))]
        return tb.mix(np.concatenate(found) + salt[self.lang_of]) if found else np.zeros(0, np.uint64)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Summed weight of each word, and number of words in bodies per language."""
        per_word = _sums(self.ids, self.weight, len(self.words))
        return per_word, _sums(self.lang_of, per_word, len(self.langs))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where pairs begin, their number there, and per pair: first word, second word, summed weight.

        Pairs that lie in shared windows alone weigh 0; phrases that begin before them reach into them.
        """
        at = np.flatnonzero(self.joined)
        size = max(1, len(self.words))
        key, number, total = _grouped(self.ids[at].astype(np.int64) * size + self.ids[at + 1], self.weight[at])
        return at, number, key // size, key % size, total


def _sums(number: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.int64)
    if len(number):
        order = np.argsort(number, kind="stable")
        head = np.flatnonzero(np.diff(number[order], prepend=-1))
        out[number[order][head]] = np.add.reduceat(weight[order], head)
    return out


def _grouped(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the place of each element's key among them, and the summed weight per key."""
    distinct, number = np.unique(key, return_inverse=True)
    return distinct, number, _sums(number, weight, len(distinct))


def _shards(dictionary: DataFrame, shard_words: int) -> DataFrame:
    """The dictionary packed: one row per about ``shard_words`` words."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, count = [], 0
        for batch in batches:
            size = max(1, batch.column("chunk").nbytes // 6)
            step = max(1, batch.num_rows * shard_words // size)
            for lo in range(0, batch.num_rows, step):
                held.append(batch.slice(lo, step))
                count += size * held[-1].num_rows // batch.num_rows
                if count >= shard_words:
                    yield _Shard.of(pa.Table.from_batches(held)).pack(number)
                    held, count, number = [], 0, number + 1
        if held:
            yield _Shard.of(pa.Table.from_batches(held)).pack(number)

    return dictionary.mapInArrow(pack, _Shard.COLUMNS)


def _hashes(shard: _Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple]:
    """48-bit hashes of a shard's words and pairs, and their summed weights."""
    w = shard.word_hashes()
    per_word, _ = shard.counts()
    pairs = shard.pairs()
    _, _, first, second, total = pairs
    return w >> np.uint64(16), per_word, tb.mix(w[first] * _M + w[second]) >> np.uint64(16), total, pairs


def _deal(buckets: int):
    """Words and pairs of each shard by the leading bits of their hash."""
    shift = np.uint64(48 - (buckets - 1).bit_length())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                w, per_word, p, total, _ = _hashes(_Shard.unpack(batch, i))
                h, n = np.concatenate((w[per_word > 0], p)), np.concatenate((per_word[per_word > 0], total))
                order = np.argsort(h)
                h, n = h[order], n[order]
                bucket = (h >> shift).astype(np.int64)
                cut = np.flatnonzero(np.diff(bucket, prepend=-1))
                raw = h.view(np.uint8).reshape(-1, 8)[:, :6]
                ends = np.append(cut[1:], len(h))
                small = [n[a:b].astype(np.uint8 if n[a:b].max() < 256 else np.int64).tobytes() for a, b in zip(cut, ends, strict=True)]
                cols = [pa.array(bucket[cut]), pa.array(np.repeat(batch.column("shard")[i].as_py(), len(cut))), pa.array([raw[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()), pa.array(small, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["bucket", "shard", "hashes", "counts"])

    return deal


def _read_hashes(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view(np.uint64)


def _frequent(min_count: int):
    """Of one bucket, the hashes that reach ``min_count`` in all, for each shard that holds them."""

    def found(rows: pa.Table) -> pa.Table:
        hashes = [_read_hashes(x.as_py()) for x in rows.column("hashes")]
        counts = [np.frombuffer(x.as_py(), np.uint8 if len(x.as_py()) == len(h) else np.int64).astype(np.int64) for x, h in zip(rows.column("counts"), hashes, strict=True)]
        distinct, _, total = _grouped(np.concatenate(hashes), np.concatenate(counts))
        keep = distinct[total >= min_count]
        kept = [np.intersect1d(h, keep).tobytes() for h in hashes]
        some = [i for i, k in enumerate(kept) if k]
        return pa.table([rows.column("shard").take(pa.array(some, pa.int64())), pa.array([kept[i] for i in some], pa.binary())], names=["shard", "hashes"])

    return found


def _phrases(shard: _Shard, passed: np.ndarray) -> pa.Table:
    """Exact counts within a shard of the phrases that may be frequent; words per language as phrases of 0 words."""
    w, per_word, p, total, (at, number, first, second, _) = _hashes(shard)
    words = shard.words.view(pa.large_string())
    langs = pa.array(shard.langs, pa.string())
    take = lambda x: words.take(pa.array(x))
    join = lambda a, b: pc.binary_join_element_wise(a, b, pa.scalar(" ", pa.large_string()))
    pieces: list[tuple[np.ndarray, int, pa.Array, np.ndarray]] = []
    ok = np.isin(w, passed) & (per_word > 0)
    pieces.append((shard.lang_of[ok], 1, take(np.flatnonzero(ok)), per_word[ok]))
    ok = np.isin(p, passed)
    own = ok & (total > 0)
    pieces.append((shard.lang_of[first[own]], 2, join(take(first[own]), take(second[own])), total[own]))
    # a longer phrase needs a pair that passed at each of its words but the last
    passes = np.zeros(len(shard.ids) + MAX_WORDS, dtype=bool)
    passes[at] = ok[number]
    live = ok[number] & (shard.weight[at] > 0)
    begin, number = at[live], number[live]
    for size in range(3, MAX_WORDS + 1):
        live = passes[begin + size - 2]
        begin, number = begin[live], number[live]
        key, number, total = _grouped(number.astype(np.int64) * len(words) + shard.ids[begin + size - 1], shard.weight[begin])
        example = np.zeros(len(key), dtype=np.int64)
        example[number] = begin
        text = take(shard.ids[example])
        for k in range(1, size):
            text = join(text, take(shard.ids[example + k]))
        pieces.append((shard.lang_of[shard.ids[example]], size, text, total))
    _, per_lang = shard.counts()
    pieces.append((np.arange(len(shard.langs)), 0, pa.array([""] * len(shard.langs), pa.large_string()), per_lang))
    return pa.concat_tables([pa.table([langs.take(pa.array(lang)), pa.array(np.full(len(n), size), pa.int32()), text.cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "size", "phrase", "n"]) for lang, size, text, n in pieces])


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, shard_words: int = SHARD_WORDS, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """``(lang, size, phrase, n)`` of every phrase of one to four words with at least ``min_count`` occurrences.

    Rows of size 0 carry the number of all word occurrences of a language. Null
    and empty texts have no words; repeated rows count each time.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "phrase-shards")
    _shards(dictionary(docs, text, lang), shard_words).write.option("compression", "uncompressed").parquet(path)
    shards = spark.read.schema(_Shard.COLUMNS).parquet(path)
    words = shards.select(F.sum("n_words").alias("n")).first()["n"] or 0
    buckets = 1 << max(0, int(words // bucket_words).bit_length())
    passed = shards.mapInArrow(_deal(buckets), "bucket bigint,shard bigint,hashes binary,counts binary").groupBy("bucket").applyInArrow(_frequent(min_count), "shard bigint,hashes binary")

    def exact(shard: pa.Table, hashes: pa.Table) -> pa.Table:
        known = [np.frombuffer(x.as_py(), np.uint64) for x in hashes.column("hashes")]
        return pa.concat_tables([_phrases(_Shard.unpack(shard, i), np.concatenate(known) if known else np.zeros(0, np.uint64)) for i in range(shard.num_rows)])

    counted = shards.groupBy("shard").cogroup(passed.groupBy("shard")).applyInArrow(exact, "lang string,size int,phrase string,n bigint")
    total = settle(counted.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).filter((F.col("size") == 0) | (F.col("n") >= min_count)), "phrase-counts")
    discard(shards)
    return total


def _not_nested(candidates: DataFrame, percent: int) -> DataFrame:
    """Candidates that lie in no longer one that is nearly as frequent. The most frequent longer one decides, so a maximum per phrase travels."""
    words = F.split("phrase", " ")
    inner = [F.array_join(F.slice(words, i + 1, k), " ") for size in range(3, MAX_WORDS + 1) for k in range(2, size) for i in range(size - k + 1)]
    spans = [(size, k, i) for size in range(3, MAX_WORDS + 1) for k in range(2, size) for i in range(size - k + 1)]
    parts = F.filter(F.array(*[F.when(F.col("size") == size, part) for (size, _, _), part in zip(spans, inner, strict=True)]), lambda p: p.isNotNull())
    held = candidates.filter(F.col("size") > 2).select("lang", F.explode(parts).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("holder"))
    wide = "decimal(20,0)"
    nested = F.coalesce(F.col("holder").cast(wide) * 100 >= F.col("n").cast(wide) * percent, F.lit(False))
    return candidates.join(held, ["lang", "phrase"], "left").filter(~nested).drop("holder")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, top: int = TOP, nested_percent: int = NESTED_PERCENT, shard_words: int = SHARD_WORDS, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    r"""The ``top`` phrases of two to four words per language whose weakest cut binds best.

    Words are runs without space and tab within pieces that ``.,;:!?`` and line
    ends part, A-Z lower-cased. A phrase with count a is cut after its first k
    words into parts with counts l and r; its score is the least
    floor(2000000 a / (l + r)) over the cuts, ties to the smallest k. Phrases
    under ``min_count``, and those inside a longer one with at least
    ``nested_percent`` per cent of their count, are left out.

    Returns ``lang`` (null: ``und``), ``rank``, ``phrase``, ``a``, ``l``, ``r``,
    ``n`` (all words of the language) and ``score``; ties go to the greater
    count, then to the smaller phrase. Null, empty and wordless texts add
    nothing; repeated rows count each; an empty table gives an empty one.
    """
    counts = phrase_counts(docs, text, lang, min_count, shard_words, bucket_words)
    candidates = _not_nested(counts.filter(F.col("size") >= 2), nested_percent)
    words = F.split("phrase", " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"head": F.array_join(F.slice(words, F.lit(1), F.col("k")), " "), "tail": F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ")})
    parts = counts.filter((F.col("size") >= 1) & (F.col("size") < MAX_WORDS))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"]).join(parts.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    score = F.expr(f"cast({SCORE_SCALE} AS decimal(7,0)) * cast(n AS decimal(19,0)) div (cast(l AS decimal(19,0)) + cast(r AS decimal(19,0)))")
    best = cuts.select("lang", "phrase", F.col("n").alias("a"), F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    scored = best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(RANK_SHARES))
    few = scored.withColumn("share", share).withColumn("place", F.row_number().over(W.partitionBy("lang", "share").orderBy(*order))).filter(F.col("place") <= top)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    totals = counts.filter(F.col("size") == 0).select("lang", F.col("n").alias("words"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
