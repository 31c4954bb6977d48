"""Deterministic allocation, quotas, splits and samples.

Orders come from stable keys, so a result depends on neither input order nor partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import keys
from tallyloom.operators.windows import bucket_count, round_robin, top_per_group

RATIOS = {"train": 0.70, "dev": 0.15, "test": 0.15}


def largest_remainder(df: DataFrame, by: Sequence[str], weight: str, total: Column, order: Sequence[Column], name: str = "quota") -> DataFrame:
    """Adds an integer share of ``total`` by weight: floors first, then 1 to the largest remainders.

    Ties go by ``order``.  A negative weight, or weights of sum 0 with a total above 0, is an error.
    """
    whole = Window.partitionBy(*by)
    df = df.withColumns({"__w": F.col(weight).cast("long"), "__t": total.cast("long")})
    df = df.withColumns({"__sum": F.sum("__w").over(whole), "__bad": F.min("__w").over(whole) < 0})
    bad = F.col("__bad") | (F.col("__t") < 0) | ((F.col("__sum") <= 0) & (F.col("__t") > 0))
    share = F.col("__t") * F.col("__w")
    floor = F.when(bad, F.raise_error(F.lit("weights must be at least 0 with a sum above 0")).cast("long")).when(F.col("__sum") == 0, 0).otherwise(F.expr("__t * __w div __sum"))
    df = df.withColumns({"__floor": floor, "__rest": F.when(F.col("__sum") > 0, share % F.col("__sum")).otherwise(0)})
    left = F.col("__t") - F.sum("__floor").over(whole)
    rank = F.row_number().over(whole.orderBy(F.col("__rest").desc(), *order))
    extra = F.when((rank <= left) & (F.col("__sum") > 0), 1).otherwise(0)
    return df.withColumn(name, F.col("__floor") + extra).drop("__w", "__t", "__sum", "__bad", "__floor", "__rest")


def allocate_counts(total: int, ratios: Mapping[str, float] = RATIOS) -> dict[str, int]:
    """Share of each part by largest remainder of the products; ties in the declared order."""
    exact = {k: total * r for k, r in ratios.items()}
    out = {k: int(v) for k, v in exact.items()}
    names = sorted(ratios, key=lambda k: out[k] - exact[k])  # stable: ties keep the declared order
    for k in names[: total - sum(out.values())]:
        out[k] += 1
    return out


def split_entities(entities: DataFrame, seed: int, *, entity_col: str = "entity", stratum_col: str = "stratum", ratios: Mapping[str, float] = RATIOS) -> DataFrame:
    """``(entity, stratum, split)``: each stratum's entities in stable order, cut by its allocation.

    Allocations are a scalar per stratum (strata are few); entities never leave the executors.  Ranks come from buckets
    of the key, so no task sorts a stratum.
    """
    keyed = entities.withColumn("__key", keys.entity_key(seed, F.col(stratum_col), F.col(entity_col)))
    buckets = bucket_count(entities.count())
    keyed = keyed.withColumn("__bucket", F.floor(F.conv(F.substring("__key", 1, 8), 16, 10).cast("long") * buckets / F.lit(float(1 << 32))))
    sizes = keyed.groupBy(F.col(stratum_col).alias("__s"), F.col("__bucket").alias("__b")).agg(F.count("*").alias("__size"))
    w = Window.partitionBy("__s")
    upto = w.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__s", "__b", F.coalesce(F.sum("__size").over(upto), F.lit(0)).alias("__before"), F.sum("__size").over(w).alias("__n"))
    placed = keyed.join(sizes, F.col(stratum_col).eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    inside = F.row_number().over(Window.partitionBy(stratum_col, "__bucket").orderBy("__key", entity_col))
    ranked = placed.withColumn("__rn", F.col("__before") + inside)
    names, n = list(ratios), F.col("__n")
    exact = {k: n * F.lit(float(r)) for k, r in ratios.items()}
    floors = {k: F.floor(v).cast("long") for k, v in exact.items()}
    left = n - sum((floors[k] for k in names[1:]), floors[names[0]])
    rest = {k: exact[k] - floors[k] for k in names}
    split, upto = F.lit(names[-1]), []
    for i, k in enumerate(names):
        ahead = [(rest[o] > rest[k]) if j > i else (rest[o] >= rest[k]) for j, o in enumerate(names) if o != k]
        rank = sum((a.cast("int") for a in ahead[1:]), ahead[0].cast("int")) if ahead else F.lit(0)
        size = floors[k] + F.when(rank < left, 1).otherwise(0)
        upto.append(size if not upto else upto[-1] + size)
    for k, end in reversed(list(zip(names[:-1], upto[:-1]))):
        split = F.when(F.col("__rn") <= end, F.lit(k)).otherwise(split)
    return ranked.select(F.col(entity_col).alias("entity"), F.col(stratum_col).alias("stratum"), split.alias("split"))


def protocol_partitions(rows: DataFrame, assigned: DataFrame, rules: Sequence[tuple[str, str, Sequence[str], Sequence[str]]], *, entity_col: str, category_col: str) -> DataFrame:
    """Rows of every partition whose rule fits, with ``partition``; a row may be in several.

    A rule is (partition, split or ``*``, strata, categories), empty lists meaning any.
    """
    joined = rows.join(assigned.select(F.col("entity").alias("__e"), "stratum", "split"), rows[entity_col] == F.col("__e")).drop("__e")
    hits = []
    for name, split, strata, categories in rules:
        fits = F.lit(True) if split == "*" else F.col("split") == split
        fits = fits & F.col("stratum").isin(*strata) if strata else fits
        fits = fits & F.col(category_col).isin(*categories) if categories else fits
        hits.append(F.when(fits, F.lit(name)))
    return joined.withColumn("partition", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())))


def two_level_quota(full: DataFrame, total: int, *, split_col: str, category_col: str, splits: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """``(split, category, quota)``: total to splits by their full sizes, then to categories by theirs.

    Weights are the full distribution, not what is locally available.  Category pairs without rows get 0.
    """
    spark = full.sparkSession
    grid = spark.sql(
        f"SELECT * FROM (SELECT posexplode(array({', '.join(repr(s) for s in splits)})) AS (so, {split_col}))"
        f" CROSS JOIN (SELECT posexplode(array({', '.join(repr(c) for c in categories)})) AS (co, {category_col}))"
    )
    counts = full.groupBy(split_col, category_col).agg(F.count("*").alias("n"))
    cells = grid.join(counts, [split_col, category_col], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sizes = cells.groupBy(split_col, "so").agg(F.sum("n").alias("size"))
    sized = largest_remainder(sizes.withColumn("__all", F.lit(0)), ["__all"], "size", F.lit(total), [F.col("so")], "split_quota")
    cells = cells.join(sized.select(split_col, "split_quota"), split_col)
    out = largest_remainder(cells, [split_col], "n", F.col("split_quota"), [F.col("co")])
    return out.select(split_col, category_col, "quota")


def quota_sample(candidates: DataFrame, quotas: DataFrame, seed: int, *, id_col: str, by: Sequence[str]) -> DataFrame:
    """Of each group the first rows by stable key, as many as its quota; a zero quota gives none.

    Groups are cut at the largest quota before the shuffle.
    """
    most = quotas.agg(F.max("quota")).first()[0] or 0
    order = [keys.row_key(seed, F.col(id_col)), F.col(id_col).cast("string")]
    ranked = top_per_group(candidates, by, order, int(most), "__rn")
    return ranked.join(quotas, list(by)).where(F.col("__rn") <= F.col("quota")).drop("__rn", "quota")


def shortfalls(candidates: DataFrame, quotas: DataFrame, by: Sequence[str]) -> DataFrame:
    """Groups with fewer candidates than their quota: ``required``, ``available``, ``missing``."""
    have = candidates.groupBy(*by).agg(F.count("*").alias("available"))
    joined = quotas.join(have, list(by), "left").withColumn("available", F.coalesce("available", F.lit(0)))
    short = joined.where(F.col("available") < F.col("quota"))
    return short.select(*by, F.col("quota").alias("required"), "available", (F.col("quota") - F.col("available")).alias("missing"))


def balanced_subset(df: DataFrame, seed: int, split: str, per_class: int, *, id_col: str, category_col: str, negative: str, positives: Sequence[str]) -> DataFrame:
    """As many negatives as positives, the positives in turn from their categories, with ``position`` in stable order."""
    key = lambda purpose: keys.purpose_key(seed, split, purpose, F.col(id_col))
    tie = F.col(id_col).cast("string")
    low = df.where(F.col(category_col) == negative).orderBy(key(negative), tie).limit(per_class)
    high = round_robin(df, category_col, [keys.purpose_key(seed, split, F.col(category_col), F.col(id_col)), tie], positives, per_class)
    both = low.unionByName(high).withColumn("__all", F.lit(0))
    w = Window.partitionBy("__all").orderBy(key("manifest"), tie)  # at most 2 * per_class rows
    return both.withColumn("position", F.row_number().over(w) - 1).drop("__all")


def first_by_key(df: DataFrame, seed: int, n: int, id_col: str) -> DataFrame:
    """The first n rows by stable key."""
    return df.orderBy(keys.row_key(seed, F.col(id_col)), F.col(id_col).cast("string")).limit(n)


def epoch_batches(df: DataFrame, seed: int, epoch: int, batch: int, *, id_col: str, cursor: int = 0, drop_last: bool = False) -> DataFrame:
    """``(position, batch)`` of each row in the epoch's stable shuffle, from batch ``cursor`` on.

    The order is by the first 52 bits of the key; positions come from bucketed ranks, so no task sorts all rows.
    """
    keyed = df.withColumn("__hex", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col(id_col).cast("string")), 256))
    keyed = keyed.withColumn("__order", F.conv(F.substring("__hex", 1, 13), 16, 10).cast("double"))
    buckets = bucket_count(df.count())
    keyed = keyed.withColumn("__bucket", F.floor(F.col("__order") / F.lit(float(1 << 52)) * buckets))  # keys are spread evenly
    sizes = keyed.groupBy("__bucket").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(F.lit(0)).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    sizes = sizes.select(F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy("__hex", F.col(id_col).cast("string")))
    placed = keyed.join(F.broadcast(sizes), F.col("__bucket") == F.col("__b"))  # a row for each bucket
    placed = placed.withColumn("position", F.col("__before") + inside - 1).withColumn("batch", F.floor(F.col("position") / batch))
    out = placed.where(F.col("batch") >= cursor).drop("__hex", "__order", "__bucket", "__b", "__before")
    if drop_last:
        total = df.agg(F.count("*").alias("__total"))
        out = out.crossJoin(F.broadcast(total)).where((F.col("batch") + 1) * batch <= F.col("__total")).drop("__total")  # one row
    return out


def even_positions(n: Column, count: int) -> Column:
    """Positions ``i * (n - 1) // (count - 1)``: evenly spaced over n rows, both ends included."""
    i = F.sequence(F.lit(0), F.lit(count - 1))
    return F.transform(i, lambda k: F.floor(k * (n - 1) / F.lit(count - 1)).cast("long")) if count > 1 else F.array(F.lit(0).cast("long"))


def strided_positions(n: Column, stride: int, count: int) -> Column:
    """Positions ``min(i * stride, n - 1)``."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.least(i * stride, n - 1).cast("long"))


def head_with_both(df: DataFrame, n: int, *, index_col: str, target_col: str) -> DataFrame:
    """The first n rows by position; if a class is missing its first row takes the last place."""
    head = df.orderBy(index_col).limit(n)
    first = df.groupBy(target_col).agg(F.min(index_col).alias(index_col))
    lacking = first.join(head.select(target_col).distinct(), target_col, "left_anti")
    added = df.join(lacking, [target_col, index_col], "left_semi")
    flag = lacking.agg(F.count("*").alias("__k"))
    kept = head.withColumn("__rn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(index_col))).crossJoin(F.broadcast(flag))  # n rows
    kept = kept.where((F.col("__rn") <= F.greatest(F.lit(n) - F.col("__k"), F.lit(0))) | (F.lit(n) <= 1)).drop("__rn", "__k")
    return kept.unionByName(added)


def wanted_representatives(df: DataFrame, *, by: str, wanted: Sequence[str], index_col: str, target_col: str) -> DataFrame:
    """``(position, index)`` of the first row of each wanted value of ``by``, in the order wanted; absent values give none.

    If no such row has target 1, the first row of all with target 1 follows; if there is none either, nothing does.
    One map-side combined pass; nulls of ``by`` are no value, null positions are left out.
    """
    rows = df.where(F.col(index_col).isNotNull())
    place = F.when(F.col(by).isin(*wanted), F.array_position(F.array(*map(F.lit, wanted)), F.col(by))).cast("int")
    positive = F.coalesce(F.col(target_col) == 1, F.lit(False))
    first = F.min(F.struct(F.col(index_col).alias("i"), (~positive).alias("other")))
    heads = rows.where(place.isNotNull()).groupBy(place.alias("position")).agg(first.alias("f"))
    heads = heads.select("position", F.col("f.i").alias("index"), (~F.col("f.other")).alias("positive"))
    has = heads.agg(F.coalesce(F.max(F.col("positive").cast("int")), F.lit(0)).alias("has"))
    spare = rows.where(positive).agg(F.min(index_col).alias("index")).crossJoin(F.broadcast(has))  # two single rows
    spare = spare.where((F.col("has") == 0) & F.col("index").isNotNull()).select(F.lit(len(wanted) + 1).alias("position"), "index")
    return heads.select("position", "index").unionByName(spare)


def representatives(df: DataFrame, by: str, order: Sequence[Column]) -> DataFrame:
    """The first row of each value of ``by``."""
    return top_per_group(df, [by], order, 1).drop("rank")
