"""Set algebra between partitions, with counts and sorted examples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairwise_overlap(df: DataFrame, split_col: str, key_col: str, n_examples: int = 10) -> DataFrame:
    """``(left_split, right_split, overlap, examples)`` for each pair of partitions that share keys.

    One pass: the partitions of each key are collected (at most as many as there are partitions) and paired.
    """
    sets = df.where(F.col(key_col).isNotNull()).groupBy(key_col).agg(F.array_sort(F.collect_set(split_col)).alias("s")).where("size(s) > 1")
    pairs = sets.select(F.col(key_col).cast("string").alias("k"), F.posexplode("s").alias("p", "left_split"), "s")
    pairs = pairs.select("k", "left_split", F.explode(F.slice(F.col("s"), F.col("p") + 2, F.size("s"))).alias("right_split"))
    counts = pairs.groupBy("left_split", "right_split").agg(F.count("*").alias("overlap"))
    return counts.join(least_values(pairs, ["left_split", "right_split"], "k", n_examples), ["left_split", "right_split"])


def least_values(df: DataFrame, by: Sequence[str], col: str, n: int) -> DataFrame:
    """The least n values of each group as a sorted array; ranked with a limit per group, so groups aren't gathered."""
    from pyspark.sql import Window

    ranked = df.select(*by, col).distinct().withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(col)))
    return ranked.where(F.col("__rn") <= n).groupBy(*by).agg(F.array_sort(F.collect_list(col)).alias("examples"))


def set_difference(actual: DataFrame, expected: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row ``(missing, extra)`` for two sets of rows, by one grouped pass over both."""
    tagged = expected.select(*columns, F.lit(1).alias("e"), F.lit(0).alias("a")).unionByName(
        actual.select(*columns, F.lit(0).alias("e"), F.lit(1).alias("a"))
    )
    rows = tagged.groupBy(*columns).agg(F.max("e").alias("e"), F.max("a").alias("a"))
    return rows.agg(
        F.coalesce(F.sum(F.when(F.col("a") == 0, 1)), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.when(F.col("e") == 0, 1)), F.lit(0)).alias("extra")
    )


def difference_rows(actual: DataFrame, expected: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct rows missing from ``actual`` and distinct rows that are extra in it."""
    a, e = actual.select(*columns).distinct(), expected.select(*columns).distinct()
    return e.exceptAll(a), a.exceptAll(e)


def outside_allowed(df: DataFrame, split_col: str, category_col: str, allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """``(split, invalid)``: the categories of each constrained partition beyond the allowed ones, where there are any."""
    rule = F.lit(None).cast("array<string>")
    for split, categories in allowed.items():
        rule = F.when(F.col(split_col) == split, F.array(*[F.lit(c) for c in categories]).cast("array<string>")).otherwise(rule)
    sets = df.groupBy(split_col).agg(F.collect_set(category_col).alias("s"))
    bad = F.array_sort(F.array_except("s", rule)).alias("invalid")
    return sets.select(F.col(split_col).alias("split"), bad).where("size(invalid) > 0")


def membership_matrix(df: DataFrame, key_col: str, set_col: str, names: Sequence[str]) -> DataFrame:
    """One row per key with a flag for each named set."""
    flags = [F.max(F.when(F.col(set_col) == n, 1).otherwise(0)).alias(n) for n in names]
    return df.groupBy(key_col).agg(*flags)


def set_algebra(df: DataFrame, key_col: str, set_col: str, a: str, b: str) -> DataFrame:
    """One row: keys only in a, only in b, in both, and in either."""
    m = membership_matrix(df.where(F.col(set_col).isin(a, b)), key_col, set_col, [a, b])
    has = lambda x, y: F.coalesce(F.sum(F.when((F.col(f"`{a}`") == x) & (F.col(f"`{b}`") == y), 1)), F.lit(0))
    return m.agg(has(1, 0).alias("only_a"), has(0, 1).alias("only_b"), has(1, 1).alias("both"), F.count("*").alias("either"))


def content_leaks(df: DataFrame, *, hash_col: str, id_col: str, split_col: str, roles: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``(hash, roles, ids)`` of content that crosses roles of one family under more than one id.

    ``roles`` maps a split to its family and role; two splits of one role don't conflict, and one id in both
    isn't a leak.
    """
    family, role = F.lit(None).cast("string"), F.lit(None).cast("string")
    for split, (f, r) in roles.items():
        family = F.when(F.col(split_col) == split, F.lit(f)).otherwise(family)
        role = F.when(F.col(split_col) == split, F.lit(r)).otherwise(role)
    rows = df.where(F.col(hash_col).isNotNull()).select(F.col(hash_col).alias("hash"), F.col(id_col).alias("i"), family.alias("f"), role.alias("r")).where("r IS NOT NULL").distinct()
    ids = rows.select("hash", "i").distinct().groupBy("hash").agg(F.count("*").alias("ids"))
    per = rows.select("hash", "f", "r").distinct().groupBy("hash", "f").agg(F.count("*").alias("n"), F.collect_set("r").alias("rs"))
    crossing = per.groupBy("hash").agg(F.max("n").alias("n"), F.array_sort(F.flatten(F.collect_list("rs"))).alias("roles")).where("n > 1")
    return crossing.join(ids.where("ids > 1"), "hash").select("hash", "roles", "ids")


def replaced_counts(baseline: DataFrame, selected: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows removed from a baseline, and rows that replace them."""
    return set_difference(selected, baseline, columns).select(F.col("missing").alias("removed"), F.col("extra").alias("replacements"))
