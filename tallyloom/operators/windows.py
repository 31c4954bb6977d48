"""Ranking, running totals and ordered-sequence checks.

Windows are always partitioned; a running total over a whole table goes by buckets of the order, so no
single task holds all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a range bucket is to have, and how many buckets there are at least and at most.
BUCKET_ROWS = 500_000
BUCKETS = (16, 4096)


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank; groups are cut before the shuffle."""
    ranked = df.withColumn(rank_col, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col(rank_col) <= k)


def round_robin(df: DataFrame, by: str, order: Sequence[Column], priority: Sequence[str], n: int) -> DataFrame:
    """n rows taken in turn from the groups of ``by``, which come in the order of ``priority``.

    Taking turns is the order (rank within the group, priority), so it is one window and one top-n.
    """
    place = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(by))
    ranked = top_per_group(df.where(F.col(by).isin(*priority)), [by], order, n, "__rank")
    return ranked.withColumn("__place", place).orderBy("__rank", "__place").limit(n).drop("__rank", "__place")


def bucket_count(rows: int) -> int:
    """Buckets for so many rows."""
    return min(BUCKETS[1], max(BUCKETS[0], -(-rows // BUCKET_ROWS)))


def bucket_of(df: DataFrame, order_col: str, buckets: int | None = None) -> Column:
    """Range bucket of a numeric order column, from approximate quantiles (at most ``buckets`` numbers reach the driver)."""
    buckets = bucket_count(df.count()) if buckets is None else buckets
    cuts = sorted(set(df.approxQuantile(order_col, [i / buckets for i in range(1, buckets)], 0.25 / buckets))) if buckets > 1 else []
    return F.array_size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>"), lambda c: c <= F.col(order_col)))


def running_totals(df: DataFrame, by: Sequence[str], order_col: str, sums: Sequence[str], *, descending: bool = False, buckets: int | None = None) -> DataFrame:
    """Adds ``{c}_upto`` (running sum, own row included), ``{c}_total`` and ``prev_{order}`` per group.

    Order values must be distinct within a group.  Buckets are summed first (a few rows for each group), their
    offsets are joined back, and the window runs within (group, bucket).
    """
    df = df.withColumn("__bucket", bucket_of(df, order_col, buckets))
    sign = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    edge = F.min(order_col) if descending else F.max(order_col)
    per = df.groupBy(*by, "__bucket").agg(*[F.sum(c).alias(f"__{c}") for c in sums], edge.alias("__edge"))
    over = Window.partitionBy(*by).orderBy(sign("__bucket"))
    before, whole = over.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    offsets = per.select(
        *[F.col(c).alias(f"__by_{c}") for c in by], F.col("__bucket").alias("__b"),
        *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__before_{c}") for c in sums],
        *[F.sum(f"__{c}").over(whole).alias(f"{c}_total") for c in sums], F.lag("__edge").over(over).alias("__edge_before"),
    )
    on = [F.col("__bucket") == F.col("__b"), *[F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]]
    joined = df.join(offsets, on)
    inner = Window.partitionBy(*by, "__bucket").orderBy(sign(order_col))
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = joined.withColumns({
        **{f"{c}_upto": F.col(f"__before_{c}") + F.sum(c).over(upto) for c in sums},
        f"prev_{order_col}": F.coalesce(F.lag(order_col).over(inner), F.col("__edge_before")),
    })
    return out.drop("__bucket", "__b", "__edge_before", *[f"__by_{c}" for c in by], *[f"__before_{c}" for c in sums])


def average_rank(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Adds ``avg_rank``: the mean rank of equal values, null for null ones.

    Ranks come from running counts of the distinct values, which are joined back.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).cast("double").alias("__v")).agg(F.count("*").alias("n"))
    ranks = running_totals(counts, by, "__v", ["n"]).select(
        *[F.col(c).alias(f"__r_{c}") for c in by], "__v", (F.col("n_upto") - (F.col("n") - 1) / F.lit(2.0)).alias("avg_rank")
    )
    on = [F.col(col).cast("double") == F.col("__v"), *[F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in by]]
    return df.join(ranks, on, "left").drop("__v", *[f"__r_{c}" for c in by])


def sequence_gaps(df: DataFrame, by: Sequence[str], index_col: str, offset_col: str, length_col: str) -> DataFrame:
    """Rows whose index isn't the last one plus 1, or whose offset isn't where the last row ended (0 at first).

    Rows of equal index go by offset.  Range buckets of the index are looked at apart, the first row of each beside the
    last row of the bucket before it, so no task holds a group.
    """
    df = df.withColumn("__bucket", bucket_of(df, index_col))
    last = F.struct(F.col(index_col).alias("i"), F.col(offset_col).alias("o"), (F.col(offset_col) + F.col(length_col)).alias("end"))
    ends = df.groupBy(*by, "__bucket").agg(F.max(last).alias("__last"))
    before = F.lag("__last").over(Window.partitionBy(*by).orderBy("__bucket"))
    ends = ends.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__bucket").alias("__b"), before.alias("__before"))
    joined = df.join(ends, [F.col("__bucket") == F.col("__b"), *[F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]])
    w = Window.partitionBy(*by, "__bucket").orderBy(index_col, offset_col)
    previous = F.when(F.row_number().over(w) == 1, F.col("__before")).otherwise(F.lag(last).over(w))
    flagged = joined.withColumn("__previous", previous).withColumns({
        "expected_index": F.coalesce(F.col("__previous.i") + 1, F.lit(0)), "expected_offset": F.coalesce(F.col("__previous.end"), F.lit(0)),
    }).drop("__bucket", "__b", "__before", "__previous", *[f"__by_{c}" for c in by])
    return flagged.where((F.col(index_col) != F.col("expected_index")) | (F.col(offset_col) != F.col("expected_offset")))


def failure_runs(df: DataFrame, by: Sequence[str], order: Sequence[str], failed: Column, limit: int) -> DataFrame:
    """Adds ``run`` (consecutive failures up to the row) and ``stopped`` (a run reached the limit before the row)."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    f = F.coalesce(failed, F.lit(False)).cast("int")
    df = df.withColumn("__island", F.sum(1 - f).over(rows))
    run = F.sum(f).over(Window.partitionBy(*by, "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    df = df.withColumn("run", run)
    hit = F.max((F.col("run") >= limit).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("stopped", F.coalesce(hit, F.lit(0)) == 1).drop("__island")


def best_so_far(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, patience: int) -> DataFrame:
    """Adds ``best`` (least value so far), ``improved`` (strictly below all before), ``stale`` and ``stop``."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("improved", before.isNull() | (F.col(value) < before))
    df = df.withColumns({
        "best": F.min(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "__island": F.sum(F.col("improved").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    })
    stale = F.row_number().over(Window.partitionBy(*by, "__island").orderBy(*order)) - 1
    return df.withColumn("stale", stale).withColumn("stop", F.col("stale") >= patience).drop("__island")
