"""Ranks, running totals and quantiles that never put a group into one task.

A plain window without partitions, or partitioned by a key that holds a third
of all rows, sorts that whole group in one task. Everything here first shrinks
the data to distinct values, cuts them into ranges of about equal width, works
inside each range and adds an offset per range. The offset table has at most
(groups x ranges) rows. A NULL group is a group like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle, shuffle_width

#: most parts that a hot key is split into
MAX_SHARES = 1024
#: distinct values per range, and split points that one list may hold
RANGE_ROWS, MAX_MARKS = 250_000, 4096


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL; the key columns appear once."""
    l, r = left.alias("l_"), right.alias("r_")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"l_.{k}").eqNullSafe(F.col(f"r_.{k}"))
    rest = [F.col(f"r_.{c}") for c in right.columns if c not in keys]
    return l.join(r, same, how).select(*[F.col(f"l_.{c}") for c in left.columns], *rest)


def range_bounds(df: DataFrame, value: str, ranges: int | None = None) -> Column:
    """Array of split points as a scalar subquery.

    Their number follows the measured number of rows; only above
    ``MAX_MARKS * RANGE_ROWS`` distinct values do ranges grow instead.
    """
    n = ranges or min(MAX_MARKS, max(2, shuffle_width(df.sparkSession), -(-df.count() // RANGE_ROWS)))
    marks = F.array(*[F.lit(i / n) for i in range(1, n)])
    return df.agg(F.percentile_approx(F.col(value).cast("double"), marks, max(10000, 8 * n))).scalar()


def cumulative_counts(
    df: DataFrame, value: str, group: Sequence[str] = (), weight: Column | None = None
) -> DataFrame:
    """Distinct values with count, number of rows before them and group total.

    Columns: ``group..., value, cnt, before, total``. NULL values are left out.
    """
    group = list(group)
    live = df.filter(F.col(value).isNotNull())
    cnt = F.count(F.lit(1)) if weight is None else F.sum(weight)
    # read three times: for their number, for the split points, and for the ranges
    counts = settle(live.groupBy(*group, value).agg(cnt.alias("cnt")), "distinct-values")
    bounds = F.coalesce(range_bounds(counts, value), F.array().cast("array<double>"))
    cut = (
        counts.withColumn("bounds_", bounds)
        .withColumn("rng_", F.size(F.filter("bounds_", lambda b: b < F.col(value))))
        .drop("bounds_")
    )
    inside = Window.partitionBy(*group, "rng_").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("in_", F.coalesce(F.sum("cnt").over(inside), F.lit(0)))
    sums = cut.groupBy(*group, "rng_").agg(F.sum("cnt").alias("sum_"))
    across = Window.partitionBy(*(group or [F.lit(0)])).orderBy("rng_")
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    offsets = sums.select(
        *group,
        "rng_",
        F.coalesce(F.sum("sum_").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off_"),
        F.sum("sum_").over(whole).alias("total"),
    )
    return null_safe_join(local, offsets, [*group, "rng_"]).select(
        *group, value, "cnt", (F.col("in_") + F.col("off_")).alias("before"), "total"
    )


def exact_quantiles(
    df: DataFrame, value: str, qs: dict[str, float], group: Sequence[str] = ()
) -> DataFrame:
    """Interpolated quantiles, exact, one row per group (one row in all without groups)."""
    cum = cumulative_counts(df, value, group)
    aggs = []
    for name, q in qs.items():
        pos = F.lit(float(q)) * (F.col("total") - 1)
        aggs += [
            F.max(F.when((F.col("before") <= F.floor(pos)) & (F.floor(pos) < F.col("before") + F.col("cnt")), F.col(value))).alias(f"{name}_lo"),
            F.max(F.when((F.col("before") <= F.ceil(pos)) & (F.ceil(pos) < F.col("before") + F.col("cnt")), F.col(value))).alias(f"{name}_hi"),
            F.max(pos - F.floor(pos)).alias(f"{name}_fr"),
        ]
    picked = cum.groupBy(*group).agg(*aggs)
    return picked.select(
        *group,
        *[
            (F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_fr")).alias(n)
            for n in qs
        ],
    )


HOT_KEYS = 128


def spread_left_join(left: DataFrame, right: DataFrame, key: str, weight: str = "cnt") -> DataFrame:
    """Left join on ``key`` where a few keys may own most of the left rows.

    ``right`` has one row per key and ``weight`` = how many left rows it has.
    Keys with at least 1/``HOT_KEYS`` of those rows cannot number more than
    ``HOT_KEYS``; that bounded list travels as a map, left rows of such keys
    (and of NULL) take a share by row hash, and the right row is repeated per
    share. Everything else is a plain shuffle join, in one pass over ``left``.
    """
    width = max(2, min(MAX_SHARES, shuffle_width(left.sparkSession)))
    total = right.agg(F.sum(weight)).scalar()
    shares = F.greatest(F.lit(1), F.ceil(F.col(weight) * width / total)).cast("int")
    sized = right.withColumn("hot_", F.col(weight) * HOT_KEYS >= total).withColumn(
        "shares_", F.when(F.col("hot_"), shares).otherwise(1)
    )
    hot = sized.filter("hot_").agg(F.map_from_entries(F.collect_list(F.struct(key, "shares_")))).scalar()
    simple = [c for c, t in left.dtypes if not t.startswith(("map", "array", "struct", "variant"))]
    mine = F.when(F.col(key).isNull(), F.lit(width)).otherwise(F.coalesce(F.col("hot_")[F.col(key)], F.lit(1)))
    salted = left.withColumn("hot_", hot).withColumn("share_", F.pmod(F.xxhash64(*simple), mine).cast("int")).drop("hot_")
    copies = sized.withColumn("share_", F.explode(F.sequence(F.lit(0), F.col("shares_") - 1))).drop("hot_", "shares_", weight)
    return salted.join(copies, [key, "share_"], "left").drop("share_")


def percentile_ranks(df: DataFrame, ranks: dict[str, str], eligible: Column | None = None, key: str | None = None) -> DataFrame:
    """Average-tie rank / n among eligible rows that have a value, 0.5 for all others.

    ``ranks`` maps output column to value column. All values are counted in one
    pass. With a ``key`` that is unique per row only (key, value) pairs meet the
    table of values, for all ranks at once, and the wide rows are joined once;
    without one they meet it rank by rank.
    """
    ok = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    pairs = F.explode(F.array(*[
        F.struct(F.lit(out).alias("which"), F.col(v).cast("double").alias("val_")) for out, v in ranks.items()
    ]))
    long = df.filter(ok).select(*([key] if key else []), pairs.alias("p_")).select(*([key] if key else []), "p_.*")
    place = ((F.col("before") + (F.col("cnt") + 1) / 2) / F.col("total")).alias("rank_")
    if key:
        long = settle(long.filter("val_ IS NOT NULL"), "values")
        keyed = F.concat_ws(" ", "which", F.col("val_").cast("string"))
        cum = settle(cumulative_counts(long.drop(key), "val_", ["which"]).select(keyed.alias("prv_"), "cnt", place), "ranks")
        met = spread_left_join(long.withColumn("prv_", keyed), cum, "prv_")
        wide = met.groupBy(key).agg(*[F.max(F.when(F.col("which") == out, F.col("rank_"))).alias(out) for out in ranks])
        return df.join(wide, key, "left").withColumns({out: F.coalesce(out, F.lit(0.5)) for out in ranks})
    cum = settle(cumulative_counts(long, "val_", ["which"]), "ranks")
    done = df
    for out, v in ranks.items():
        one = cum.filter(F.col("which") == out).select(F.col("val_").alias("prv_"), "cnt", place)
        keyed = done.withColumn("prv_", F.when(ok, F.col(v).cast("double")))
        joined = spread_left_join(keyed, one, "prv_")
        done = joined.withColumn(out, F.coalesce("rank_", F.lit(0.5))).drop("prv_", "rank_")
    return done


def percentile_rank(df: DataFrame, value: str, out: str, eligible: Column | None = None, key: str | None = None) -> DataFrame:
    return percentile_ranks(df, {out: value}, eligible, key)


def row_numbers(df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str = "ord") -> DataFrame:
    """Place of every row in its group, from 1, in an order without ties.

    Rows are cut into ranges of (group, order); places inside a range are a
    window over the range, and ranges before it add their counts. The ranges are
    written, so their numbers hold; a group of any size is as many ranges as it
    needs.
    """
    group = list(group)
    part = f"{out}_part_"
    cut = settle(df.repartitionByRange(shuffle_width(df.sparkSession), *group, *order).withColumn(part, F.spark_partition_id()), "ranges")
    local = cut.withColumn("in_", F.row_number().over(Window.partitionBy(*group, part).orderBy(*order)))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*group, part).agg(F.count(F.lit(1)).alias("n_"))
    offsets = sums.select(*group, part, F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("off_"))
    return null_safe_join(local, offsets, [*group, part]).withColumn(out, F.col("in_") + F.col("off_")).drop(part, "in_", "off_")


def chunked_total(
    df: DataFrame, group: Sequence[str], pos: str, value: Column, out: str, chunk: int = 65536
) -> DataFrame:
    """Running sum of ``value`` by integer position, groups cut into chunks of positions."""
    group = list(group)
    cut = df.withColumn("chk_", F.floor(F.col(pos) / chunk)).withColumn("val_", value)
    inner = Window.partitionBy(*group, "chk_").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn("run_", F.sum("val_").over(inner))
    sums = cut.groupBy(*group, "chk_").agg(F.sum("val_").alias("sum_"))
    across = Window.partitionBy(*group).orderBy("chk_").rowsBetween(Window.unboundedPreceding, -1)
    off = sums.select(*group, "chk_", F.coalesce(F.sum("sum_").over(across), F.lit(0.0)).alias("off_"))
    return (
        null_safe_join(local, off, [*group, "chk_"])
        .withColumn(out, F.col("run_") + F.col("off_"))
        .drop("chk_", "val_", "run_", "off_")
    )


def with_halo(
    df: DataFrame, group: Sequence[str], pos: str, before: int, after: int, chunk: int = 65536
) -> tuple[DataFrame, Window, Column]:
    """Cut long ordered groups into chunks that overlap by the frame of a window.

    Returns the enlarged rows, a window over one chunk, and the condition that
    keeps each row once after the window functions ran.
    """
    home = F.floor(F.col(pos) / chunk)
    first = F.floor((F.col(pos) - after) / chunk)
    last = F.floor((F.col(pos) + before) / chunk)
    spread = df.withColumn("chk_", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    return spread, Window.partitionBy(*group, "chk_").orderBy(pos), F.col("chk_") == home


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """k first rows per group; Spark cuts to k per group before and after the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def group_min(df: DataFrame, group: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Attach group aggregates by partial aggregation and a join, not by a window."""
    return null_safe_join(df, df.groupBy(*group).agg(*aggs), list(group))
