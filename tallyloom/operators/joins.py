"""Joins with coverage and equality contracts.

Nothing is broadcast by hint: sides grow with the data, and the engine broadcasts what it has measured.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _same(a: str, b: str, columns: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns])


def inventory(local: DataFrame, meta: DataFrame, *, shard_col: str, id_col: str, compare: Sequence[str]) -> DataFrame:
    """Rows, distinct ids and metadata matches of each shard, by a left join on the id.

    A match needs every compared column to be equal and not null.  Metadata that repeats an id fans out, as in SQL.
    """
    joined = local.alias("l").join(meta.alias("m"), F.col(f"l.{id_col}") == F.col(f"m.{id_col}"), "left")
    equal = reduce(Column.__and__, [F.coalesce(F.col(f"l.{c}") == F.col(f"m.{c}"), F.lit(False)) for c in compare])
    return joined.groupBy(F.col(f"l.{shard_col}").alias("shard")).agg(
        F.count("*").alias("rows"), F.countDistinct(F.col(f"l.{id_col}")).alias("ids"),
        F.sum(F.when(F.col(f"m.{id_col}").isNotNull() & equal, 1).otherwise(0)).alias("matches"),
    )


def covered(split: DataFrame, local: DataFrame, *, id_col: str, compare: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of a split that are present locally, and those present with other metadata (which callers reject)."""
    joined = split.alias("s").join(local.alias("l"), F.col(f"s.{id_col}") == F.col(f"l.{id_col}"))
    same = _same("s", "l", compare)
    return joined.where(same).select("s.*"), joined.where(~same).select("s.*")


def coverage(split: DataFrame, local: DataFrame, id_col: str) -> DataFrame:
    """Rows of the split, those found locally, and their share."""
    found = split.join(local.select(id_col).distinct().withColumn("__here", F.lit(1)), id_col, "left")
    return found.agg(
        F.count("*").alias("rows"), F.count("__here").alias("present"),
        F.when(F.count("*") > 0, F.count("__here") / F.count("*")).otherwise(0.0).alias("coverage"),
    )


def lookup_issues(rows: DataFrame, meta: DataFrame, *, id_col: str, compare: Sequence[str]) -> DataFrame:
    """``(id, issue)``: ids that the metadata lacks, and ids whose compared columns differ."""
    joined = rows.alias("r").join(meta.withColumn("__here", F.lit(1)).alias("m"), F.col(f"r.{id_col}") == F.col(f"m.{id_col}"), "left")
    issue = F.when(F.col("m.__here").isNull(), "missing").when(~_same("r", "m", compare), "mismatch")
    return joined.select(F.col(f"r.{id_col}").alias(id_col), issue.alias("issue")).where("issue IS NOT NULL")


def wanted_rows(rows: DataFrame, wanted: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """The wanted rows, and the wanted ids that no row has."""
    return rows.join(wanted, id_col, "left_semi"), wanted.join(rows, id_col, "left_anti")


def unknown_rows(rows: DataFrame, known: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose columns together occur in no known row; null equals null."""
    a, b = rows.alias("a"), known.select(*columns).distinct().alias("b")
    return a.join(b, _same("a", "b", columns), "left_anti")


def membership(rows: DataFrame, splits: DataFrame, id_col: str, split_col: str = "split") -> DataFrame:
    """Rows with the split of their id, null outside all splits."""
    return rows.join(splits.select(id_col, split_col), id_col, "left")


def positional_mismatches(a: DataFrame, b: DataFrame, index_col: str, columns: Sequence[str]) -> DataFrame:
    """One row: positions of either table, and those that differ or that only one table has."""
    l, r = a.withColumn("__l", F.lit(1)).alias("l"), b.withColumn("__r", F.lit(1)).alias("r")
    joined = l.join(r, F.col(f"l.{index_col}") == F.col(f"r.{index_col}"), "full")
    bad = F.col("__l").isNull() | F.col("__r").isNull() | ~_same("l", "r", columns)
    return joined.agg(F.count("*").alias("positions"), F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("mismatches"))


def aligned(order: DataFrame, a: DataFrame, b: DataFrame, *, id_col: str, position_col: str, values: Sequence[str]) -> DataFrame:
    """The requested ids in order with the values of both tables and whether they agree."""
    l = a.select(id_col, *[F.col(v).alias(f"{v}_a") for v in values])
    r = b.select(id_col, *[F.col(v).alias(f"{v}_b") for v in values])
    same = reduce(Column.__and__, [F.col(f"{v}_a").eqNullSafe(F.col(f"{v}_b")) for v in values])
    return order.select(position_col, id_col).join(l, id_col).join(r, id_col).withColumn("same", same)


def request_order(requests: DataFrame, rows: DataFrame, *, id_col: str, position_col: str) -> DataFrame:
    """The row of each request, repeated ids included, with a count of rows that the id has (must be 1)."""
    counts = rows.groupBy(id_col).agg(F.count("*").alias("rows_of_id"))
    return requests.select(position_col, id_col).join(rows, id_col, "left").join(counts, id_col, "left").withColumn("rows_of_id", F.coalesce("rows_of_id", F.lit(0)))
