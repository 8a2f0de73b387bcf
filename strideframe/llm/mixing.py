"""Mixing sources to target weights along a curriculum.

Every source has a weight that changes over training time. Its integral over
the whole run sets the source's share of all words, its running integral says
how much of that share is due by a given time. Documents of a source stand one
after another in a fixed shuffled order; the words before a document are its
demand, and inverting the running integral turns that demand into the time at
which it is read. A source with a target above its size is read again, up to
``MOST_PASSES`` times. Sorting by time gives the training order.

A source may hold any share of the rows: offsets come from sums per slice of
the shuffled order, so no window holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strideframe.llm.textbytes import free_name
from strideframe.session import settle, shuffle_width

MOST_PASSES = 3
#: rows per slice of a source's order
SLICE_ROWS = 4_000
WORD = "[^\\x20\\x09-\\x0D]+"
#: per rank of source, repeating: weight at the start and at the end of training, straight between
SCHEDULES = ((1.5, 0.5), (2.0, 2.0), (1.5, 4.5))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(units: DataFrame, schedules: tuple[tuple[float, float], ...] = SCHEDULES, passes: int = MOST_PASSES) -> DataFrame:
    """source, source_size, w0, w1 (its schedule) and target, one row per source.

    Sources in code point order, null last, take the schedules in turn. A target
    is the source's share of all words by integrated weight; it stops at
    ``passes`` times the source's size and the rest is shared by weight again
    until none is above. Sources are filled in order of size over weight, so
    the final level is where the running sums meet: one sort, no rounds.
    """
    spark = units.sparkSession
    sums = settle(units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), "sources")
    sums = _running(sums, [F.col("source").asc_nulls_last()], {"rank": F.lit(1).cast("bigint")})
    turns = spark.createDataFrame([(k, float(a), float(b), (a + b) / 2.0) for k, (a, b) in enumerate(schedules)], "turn bigint, w0 double, w1 double, weight double")
    sums = sums.withColumn("turn", F.pmod(F.col("rank") - 1, F.lit(len(schedules)))).join(F.broadcast(turns), "turn")
    sums = settle(sums.select("source", "source_size", "w0", "w1", "weight", (F.col("source_size") * passes).cast("double").alias("most")), "sources")
    fill = settle(_running(sums, [(F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last()], {"most_to": F.col("most"), "weight_to": F.col("weight")}), "fill")
    whole = fill.agg(F.sum("weight").alias("weight"), F.sum("source_size").cast("double").alias("size")).first()
    level = (F.lit(whole["size"]) - (F.col("most_to") - F.col("most"))) / (F.lit(whole["weight"]) - (F.col("weight_to") - F.col("weight")))
    # a source is open, not filled to the brim, if the level of those from it on stays below its brim
    open_ = fill.withColumn("level", level).filter(F.col("most") > F.col("weight") * F.col("level"))
    level = open_.agg(F.min_by("level", F.struct(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")).alias("level")).first()["level"]
    filled = fill.withColumn("target", F.col("most") if level is None else F.least(F.col("most"), F.col("weight") * F.lit(level)))
    return filled.select("source", "source_size", "w0", "w1", "target")


def _running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Running sums over all rows in a total order, by range slices and their offsets."""
    base = df.columns
    df = settle(df.repartitionByRange(*order).withColumn("slice", F.spark_partition_id()), "slices")
    inner = W.partitionBy("slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = df.select("*", *[F.sum(c).over(inner).alias(n) for n, c in sums.items()])
    total = df.groupBy("slice").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    ahead = total.select("slice", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_ahead") for n in sums])
    return local.join(ahead, "slice").select(*base, *[(F.col(n) + F.col(f"{n}_ahead")).alias(n) for n in sums])


def _due(demand: Column, a: Column, b: Column) -> Column:
    """Time in 0..1 at which a share 0..1 of a source's demand is due: the inverse of its weight's integral from a to b."""
    mean, rise = (a + b) / 2, b - a
    straight = (F.sqrt(a * a + 2 * rise * mean * demand) - a) / rise
    return F.when(rise == 0, demand).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), straight)))


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", schedules: tuple[tuple[float, float], ...] = SCHEDULES,
         passes: int = MOST_PASSES, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Per distinct (doc_id, source, size): these, copies, source_size, target, w0, w1, begins, counts, n_passes, taken.

    Rows equal in all three stand one after another, their number in ``copies``.
    ``begins`` are the words before the first of them in each pass, ``counts``
    how many of them that pass takes: those whose middle lies within the target,
    so a source misses its target by half a document at most, however many
    copies a document has. ``n_passes`` and ``taken`` are the passes and words
    taken of a copy, the mean where copies differ. Null text and empty text have size 0 and are never
    taken. A null source is a source of its own. The order within a source is by
    md5 of doc_id (null: of the empty text), then doc_id and size, so reruns agree.
    """
    units = docs.groupBy(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size")).agg(F.count("*").alias("copies"))
    units = settle(units.withColumn("shuffled", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "units")
    targets = settle(source_targets(units, schedules, passes), "targets")
    counted = units.groupBy("source").agg(F.count("*").alias("n"))
    wide = counted.agg(F.max("n").alias("n")).first()["n"] or 0
    bits = max(0, (wide // slice_rows).bit_length())
    cut = F.substring("shuffled", 1, (bits + 3) // 4)
    units = units.withColumn("slice", cut)
    amount = F.col("size") * F.col("copies")
    per = units.groupBy("source", "slice").agg(F.sum(amount).alias("part"))
    per = per.withColumn("ahead", F.coalesce(F.sum("part").over(W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inner = W.partitionBy("source", "slice").orderBy("shuffled", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = units.withColumn("to", F.sum(amount).over(inner))
    keyed = [F.expr("l.source <=> r.source"), F.expr("l.slice = r.slice")]
    placed = placed.alias("l").join(per.alias("r"), keyed[0] & keyed[1]).select("l.*", "r.ahead").drop("slice")
    placed = placed.alias("l").join(targets.alias("r"), F.expr("l.source <=> r.source")).select("l.*", "r.source_size", "r.w0", "r.w1", "r.target")
    start = F.col("ahead") + F.col("to") - amount
    begins = F.transform(F.sequence(F.lit(0), F.lit(passes - 1)), lambda k: (start + k * F.col("source_size")).cast("double"))
    room = F.transform("begins", lambda x: F.floor(F.try_divide(F.col("target") - x, F.col("size")) + 0.5))
    counts = F.when(F.col("size") > 0, F.transform(room, lambda n: F.greatest(F.lit(0), F.least(F.col("copies"), n)))).otherwise(F.transform("begins", lambda x: F.lit(0).cast("bigint")))
    out = placed.withColumn("begins", begins).select("doc_id", "source", "size", "copies", "source_size", "target", "w0", "w1", "begins", counts.alias("counts"))
    out = out.withColumn("n_passes", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, n: a + n) / F.col("copies"))
    return out.withColumn("taken", F.col("size") * F.col("n_passes"))


def _positions(unit: Column, nth: Column) -> Column:
    """Training times, with the pass, at which the ``nth`` (from 0) of equal documents is read."""
    passes = F.transform(unit["begins"], lambda x, k: F.struct((k + 1).alias("pass"), F.get(unit["counts"], k).alias("count"), x.alias("begin")))
    taken = F.filter(passes, lambda p: p["count"] > nth)
    return F.transform(taken, lambda p: F.struct(p["pass"].alias("pass"), _due((p["begin"] + nth * unit["size"]) / unit["target"], unit["w0"], unit["w1"]).alias("position")))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """One row per document with its part in the mix, sorted by first training time.

    ``taken`` is its size times the passes that take it. Documents that are not
    taken come last.
    """
    p = plan(docs, **options).withColumn("nth", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    p = p.withColumn("positions", _positions(F.struct("size", "target", "w0", "w1", "begins", "counts"), F.col("nth")))
    p = p.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("positions")).cast("bigint").alias("taken"), F.get("positions", F.lit(0))["position"].alias("first_position"))
    return in_order(p, F.col("first_position").asc_nulls_last(), F.col("doc_id").asc_nulls_last())


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """Rows in ranges of the order, sorted inside each range."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def _numbered(rows: DataFrame, unit: str, nth: str) -> DataFrame:
    """Rows numbered from 0 within their ``unit``; one of any size is spread over all parts."""
    part = free_name(rows.columns, "part")
    dealt = settle(rows.repartition(shuffle_width(rows.sparkSession)).withColumn(part, F.spark_partition_id()), "copies")
    local = dealt.withColumn(nth, F.row_number().over(W.partitionBy(unit, part).orderBy(part)) - 1)
    ahead = F.coalesce(F.sum("n").over(W.partitionBy(unit).orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = dealt.groupBy(unit, part).agg(F.count(F.lit(1)).alias("n")).select(unit, part, ahead.alias("ahead"))
    return local.join(sums, [unit, part]).select(*rows.columns, (F.col(nth) + F.col("ahead")).alias(nth))


def training_order(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The documents as training reads them: one row per pass taken, in order of ``position``.

    All columns are kept; ``position`` (0..1) and ``pass`` (from 1) follow, under
    a longer name if the documents have such a column. Documents that the mix
    does not take are left out; of equal ones as many are read as it takes. Null
    and empty texts have size 0 and are left out too; null ids and sources are
    values like others; an empty table gives an empty one. The documents are
    read twice, once for their sizes and once for their texts.
    """
    p = plan(docs, doc_id, text, source, **options).filter("exists(counts, c -> c > 0)")
    mix, nth, read, key, at, turn = (free_name(docs.columns, n) for n in ("mix_unit", "mix_nth", "mix_read", "mix_key", "position", "pass"))
    own = [free_name(docs.columns, f"mix_{n}") for n in ("doc_id", "source", "size")]
    unit = F.col(mix)
    sized = docs.withColumn(nth, word_count(F.col(text)))
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(own[0])) & F.col(f"`{source}`").cast("string").eqNullSafe(F.col(own[1])) & (F.col(nth) == F.col(own[2]))
    p = p.select(*[F.col(n).alias(o) for n, o in zip(("doc_id", "source", "size"), own, strict=True)], F.struct("size", "copies", "target", "w0", "w1", "begins", "counts").alias(mix))
    met = sized.join(p, same).drop(nth)
    single = met.filter(unit["copies"] == 1).withColumns({key: F.lit(""), nth: F.lit(0).cast("bigint")})
    many = met.filter(unit["copies"] > 1).withColumn(key, F.to_json(F.struct(*own)))
    met = single.unionByName(_numbered(many, key, nth))
    out = met.withColumn(read, F.explode(_positions(unit, F.col(nth)))).select(*docs.columns, F.col(read)["position"].alias(at), F.col(read)["pass"].alias(turn))
    return in_order(out, F.col(at), F.col(doc_id))
