"""Lines that many documents share, dropped wherever they stand.

Lines are exploded and normalised, their 128-bit digests counted once per
document, and those over the threshold are dropped; what is left of a document
is put together again by position. All of it is DataFrame functions.

A document travels once, as (digest of its text, text), to meet the positions
it loses; before that only digests do. Equal texts lose equal lines, so the
digest of the text names a document and copies need no number of their own.
Counts are summed per task first. Lines that more than one in ``HEAVY_SHARE``
of all lines equal are few by arithmetic (at most ``HEAVY_SHARE`` digests), so
they are broadcast and never meet in one task; the others are joined by digest.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm import textbytes as tb
from strideframe.session import settle

MIN_CHARS, MIN_DOCS = 1, 10
#: one in so many lines is a heavy one; no more digests than this can be heavy
HEAVY_SHARE = 10_000
WHITE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(WHITE))
    # lower() does the same to plain ASCII, many times as fast
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def keyed_lines(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``(row, fp, pos, digest)`` of every line whose key has ``min_chars`` or more; written, as row numbers are drawn here."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = docs.select(F.monotonically_increasing_id().alias("row"), whole.alias("whole")).select("row", _digest(F.col("whole")).alias("fp"), F.posexplode(F.split("whole", "\n", -1)).alias("pos", "line"))
    # the key has as many characters as the bare line, which is cheaper to ask for
    keyed = lines.filter(F.length(F.btrim("line", F.lit(WHITE))) >= min_chars)
    return settle(keyed.select("row", "fp", "pos", _digest(line_key(F.col("line"))).alias("digest")), "lines")


def shared_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(digest, n_docs)`` of the line keys that at least ``min_docs`` documents hold; each row is a document."""
    return lines.select("digest", "row").distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") >= min_docs)


def _lost_positions(lines: DataFrame, min_docs: int) -> DataFrame:
    """``(fp, lost)``: the positions that a text loses, for the texts that lose any."""
    shared = settle(shared_lines(lines, min_docs), "shared-lines")
    heavy_from = (shared.agg(F.sum("n_docs").alias("n")).first()["n"] or 0) // HEAVY_SHARE + 1
    heavy = shared.filter(F.col("n_docs") >= heavy_from).select("digest", F.lit(True).alias("is_heavy"))
    light = shared.filter(F.col("n_docs") < heavy_from).select("digest")
    told = lines.select("fp", "pos", "digest").join(F.broadcast(heavy), "digest", "left")
    lost = told.filter("is_heavy").select("fp", "pos").unionByName(told.filter("is_heavy IS NULL").join(light, "digest").select("fp", "pos"))
    return lost.groupBy("fp").agg(F.collect_set("pos").alias("lost"))


def without_shared_lines(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    r"""Documents without the lines whose key stands in ``min_docs`` documents or more.

    Texts are split at ``\n``; a line's key has ASCII white space stripped and
    A-Z lower-cased; keys under ``min_chars`` code points are never dropped. A
    line counts once per row however often the row repeats it; each row is a
    document, so repeated rows count each and get equal results.

    Returns the ``keep`` columns, ``n_lines`` (before), ``n_dropped`` and
    ``kept_text`` (other lines in their order, joined by ``\n``; empty if none
    is left). Null and empty texts are one empty line. One row out per row in;
    an empty table gives an empty one.
    """
    taken = list(keep)
    names = [tb.free_name(taken, n) for n in ("fp", "whole")]
    fp, whole = names
    lost = _lost_positions(keyed_lines(docs, text, min_chars), min_docs).withColumnRenamed("fp", fp)
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(whole)).withColumn(fp, _digest(F.col(whole)))
    lines = F.split(F.col(whole), "\n", -1)
    gone = F.coalesce(F.col("lost"), F.array().cast("array<int>"))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    kept = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    return rows.join(lost, fp, "left").select(*keep, F.size(lines).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"), F.when(F.size(gone) == 0, F.col(whole)).otherwise(kept).alias("kept_text"))
