"""Profiles, distributions, quantiles and spread measures.

Counts use one map-side combined pass.  Doubles come back unrounded.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import cleaned, first_part
from tallyloom.operators.windows import running_totals


def profile(df: DataFrame, *, id_col: str, entity_col: str, category_col: str, categories: Sequence[str] = (), path_check: bool = False) -> DataFrame:
    """One row of integrity counts.

    ``rows``, ``exact_duplicate_rows``, ``duplicate_ids`` (occurrences beyond the first, blanks aside), ``entities``,
    ``missing_*``, ``invalid_categories`` (if categories are given) and ``prefix_mismatches`` (the id's first path part
    isn't the entity).  Rows are first counted by their three values, so the wide distinct counts work on what is left.
    """
    i, e, c = (cleaned(F.col(x)) for x in (id_col, entity_col, category_col))
    rows = df.select(i.alias("i"), e.alias("e"), c.alias("c")).groupBy("i", "e", "c").agg(F.count("*").alias("n"))
    n = F.col("n")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    bad = ~F.col("c").isin(*categories) & (F.col("c") != "") if categories else F.lit(False)
    prefix = (F.col("i") != "") & (F.col("e") != "") & (first_part(F.col("i")) != F.col("e")) if path_check else F.lit(False)
    by_id = rows.groupBy("i").agg(F.sum("n").alias("n"))
    ids = by_id.agg(F.coalesce(F.sum(F.when(F.col("i") != "", n - 1)), F.lit(0)).alias("duplicate_ids"))
    entities = rows.where("e <> ''").select("e").distinct().agg(F.count("*").alias("entities"))
    main = rows.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(n - 1), F.lit(0)).alias("exact_duplicate_rows"),
        *[total(F.col(k) == "").alias(f"missing_{name}") for k, name in (("i", "id"), ("e", "entity"), ("c", "category"))],
        total(bad).alias("invalid_categories"), total(prefix).alias("prefix_mismatches"),
    )
    return main.crossJoin(ids).crossJoin(entities)  # three single rows


def rows_per_entity(df: DataFrame, entity_col: str) -> DataFrame:
    """Minimum, median (mean of the middle two) and maximum of the rows of an entity; zeros for no rows."""
    counts = df.groupBy(entity_col).agg(F.count("*").alias("n"))  # row counts repeat, so their distinct values are few
    zero = lambda c: F.coalesce(c, F.lit(0))
    return counts.agg(
        zero(F.min("n")).alias("min_rows"), F.coalesce(exact_quantile("n", 0.5), F.lit(0.0)).alias("median_rows"),
        zero(F.max("n")).alias("max_rows"), F.count("*").alias("entities"),
    )


def exact_quantile(col: str | Column, p: float) -> Column:
    """Linearly interpolated quantile as an aggregate; its buffer holds the distinct values, so they should be few.

    ``linear_quantiles`` has no such bound.
    """
    return F.percentile(F.col(col) if isinstance(col, str) else col, F.lit(p))


def _ranked(df: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    """Distinct values with ``n``, ``n_upto`` and ``n_total`` of their group; running counts go by range buckets."""
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).cast("double").alias(col)).agg(F.count("*").alias("n"))
    return running_totals(counts, by, col, ["n"])


def linear_quantiles(df: DataFrame, col: str, ps: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Per group the linearly interpolated quantile for each name of ``ps``, and ``n``, the number of values.

    The two order statistics next to ``p (n - 1)`` are read off running counts, so no task holds a group.
    """
    return _ranked(df, col, by).groupBy(*by).agg(*_at_places(col, ps), F.max("n_total").alias("n"))


def _at_places(col: str, ps: Mapping[str, float]) -> list[Column]:
    """Aggregates over distinct values with running counts: the interpolated quantile for each name of ``ps``."""
    first, total = F.col("n_upto") - F.col("n"), F.col("n_total")
    at = lambda rank: F.max(F.when((first <= rank) & (rank < F.col("n_upto")), F.col(col)))
    out = []
    for name, p in ps.items():
        place = F.lit(p) * (total - 1)
        low, high = F.floor(place), F.ceil(place)
        after, before = F.max(place - low), F.max(high - place)
        out.append(F.when(after == 0, at(low)).otherwise(before * at(low) + after * at(high)).alias(name))
    return out


def nearest_rank(df: DataFrame, col: str, p: float, by: Sequence[str] = ()) -> DataFrame:
    """The value of rank ``ceil(p n)``: not interpolated, so not the same as ``linear_quantiles``."""
    found = _ranked(df, col, by).where(F.col("n_upto") >= F.ceil(F.lit(p) * F.col("n_total"))).groupBy(*by)
    return found.agg(F.min(col).alias("value"), F.max("n_total").alias("n"))


def distribution(df: DataFrame, category_col: str, negative: str | None = None) -> DataFrame:
    """Rows and percentage of each category, with the binary target of the category if ``negative`` is named."""
    counts = df.groupBy(F.col(category_col).alias("category")).agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows").alias("total"))
    out = counts.crossJoin(F.broadcast(total))  # one row
    out = out.select("category", "rows", (F.lit(100.0) * F.col("rows") / F.col("total")).alias("percent"))
    return out if negative is None else out.withColumn("target", target(F.col("category"), negative))


def target(category: Column, negative: str) -> Column:
    """0 for the negative category, 1 for all others."""
    return F.when(category == negative, 0).otherwise(1)


def entity_patterns(df: DataFrame, entity_col: str, category_col: str, patterns: Mapping[str, Sequence[str]]) -> DataFrame:
    """``(entity, categories, stratum)``: the stratum whose category set is the entity's; null for other sets."""
    sets = df.groupBy(F.col(entity_col).alias("entity")).agg(F.array_sort(F.collect_set(category_col)).alias("categories"))
    stratum = F.lit(None).cast("string")
    for name, members in patterns.items():
        stratum = F.when(F.col("categories") == F.array(*[F.lit(m) for m in sorted(members)]), F.lit(name)).otherwise(stratum)
    return sets.withColumn("stratum", stratum)


def paired_structure(df: DataFrame, entity_col: str, category_col: str, key: Column, left: str, right: str) -> DataFrame:
    """Per entity with either category: rows of both, and how many keys are common or one-sided."""
    rows = df.where(F.col(category_col).isin(left, right)).select(F.col(entity_col).alias("entity"), F.col(category_col).alias("c"), key.alias("k"))
    keys = rows.groupBy("entity", "k").agg(
        F.count(F.when(F.col("c") == left, 1)).alias("l"), F.count(F.when(F.col("c") == right, 1)).alias("r")
    )
    hit = lambda cond: F.coalesce(F.sum(F.when(cond & F.col("k").isNotNull(), 1)), F.lit(0))
    out = keys.groupBy("entity").agg(
        F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows"), hit((F.col("l") > 0) & (F.col("r") > 0)).alias("common_keys"),
        hit((F.col("l") > 0) & (F.col("r") == 0)).alias("left_only_keys"), hit((F.col("l") == 0) & (F.col("r") > 0)).alias("right_only_keys"),
    )
    return out.withColumns({"same_count": F.col("left_rows") == F.col("right_rows"), "same_keys": (F.col("left_only_keys") + F.col("right_only_keys")) == 0})


def against_reference(counts: DataFrame, reference: Mapping[str, int], total: str = "total") -> DataFrame:
    """Observed ``counts(category, rows)`` beside reference numbers, with a total row over the reference."""
    values = ", ".join(f"('{k}', {v}L)" for k, v in reference.items())
    ref = counts.sparkSession.sql(f"SELECT * FROM VALUES {values} AS r(category, reference)")
    joined = ref.join(counts, "category", "left").select("category", "reference", F.coalesce("rows", F.lit(0)).alias("observed"))
    rolled = joined.rollup("category").agg(F.sum("reference").alias("reference"), F.sum("observed").alias("observed"))
    named = rolled.withColumn("category", F.coalesce("category", F.lit(total)))
    return named.withColumns({
        "difference": F.col("observed") - F.col("reference"),
        "percent": F.when(F.col("reference") != 0, F.lit(100.0) * F.col("observed") / F.col("reference")),
    })


def numeric_summaries(df: DataFrame, measures: Sequence[str], flags: Sequence[str], groupings: Sequence[Sequence[str]]) -> DataFrame:
    """Count, minimum, median, mean, 95th percentile and maximum of each measure and counts of each flag.

    All groupings come from one pass by GROUPING SETS; columns outside a row's grouping are null, and
    ``grouping`` tells null values from absent columns.  Quantiles are read off running counts of the distinct values,
    a pass for each measure, so no buffer holds a group's values.
    """
    columns = list(dict.fromkeys(c for g in groupings for c in g))
    sets = [[F.col(c) for c in g] for g in groupings]
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for m in measures:
        aggregates += [F.min(m).alias(f"{m}_min"), F.avg(m).alias(f"{m}_mean"), F.max(m).alias(f"{m}_max")]
    aggregates += [F.sum(F.col(f).cast("long")).alias(f"{f}_count") for f in flags]
    # the position of a name in the binary grouping mask follows the order of the columns
    out = df.groupingSets(sets, *[F.col(c) for c in columns]).agg(F.grouping_id().alias("grouping"), *aggregates)
    by, order = ["grouping", *columns], [*columns, "grouping", "rows"]
    for m in measures:
        values = df.where(F.col(m).isNotNull()).select(*columns, F.col(m).cast("double").alias("__v"))
        counts = values.groupingSets([[*s, F.col("__v")] for s in sets], *[F.col(c) for c in columns], F.col("__v"))
        # the value is in every grouping and the mask's last bit
        counts = counts.agg(F.shiftright(F.grouping_id(), 1).alias("grouping"), F.count("*").alias("n"))
        places = _at_places("__v", {f"{m}_median": 0.5, f"{m}_p95": 0.95})
        found = running_totals(counts, by, "__v", ["n"]).groupBy(*[F.col(c).alias(f"__q_{c}") for c in by]).agg(*places)
        on = [F.col(c).eqNullSafe(F.col(f"__q_{c}")) for c in by]
        out = out.join(found, on, "left").drop(*[f"__q_{c}" for c in by])
        order += [f"{m}_{x}" for x in ("min", "median", "mean", "p95", "max")]
    return out.select(*order, *[f"{f}_count" for f in flags])


def duration_stats(df: DataFrame, category_col: str, samples: Column, rate: Column) -> DataFrame:
    """Seconds by category: count, minimum, median, mean, 95th percentile, maximum, total hours; bad rates aside."""
    d = df.where((rate > 0) & samples.isNotNull()).select(F.col(category_col).alias("category"), (samples / rate).alias("s"))
    plain = d.groupBy("category").agg(
        F.count("*").alias("rows"), F.min("s").alias("min_seconds"), F.avg("s").alias("mean_seconds"), F.max("s").alias("max_seconds"),
        (F.sum("s") / 3600.0).alias("total_hours"),
    )
    found = linear_quantiles(d, "s", {"median_seconds": 0.5, "p95_seconds": 0.95}, ["category"]).drop("n").withColumnRenamed("category", "__c")
    joined = plain.join(found, plain["category"].eqNullSafe(found["__c"]))
    return joined.select("category", "rows", "min_seconds", "median_seconds", "mean_seconds", "p95_seconds", "max_seconds", "total_hours")


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    """Rows of each combination."""
    return df.groupBy(*columns).agg(F.count("*").alias("rows"))


def split_summary(df: DataFrame, split_col: str, id_col: str, entity_col: str) -> DataFrame:
    """Rows, distinct ids, repeated occurrences and distinct entities of each split."""
    per = df.groupBy(split_col).agg(
        F.count("*").alias("rows"), F.countDistinct(id_col).alias("ids"), F.countDistinct(entity_col).alias("entities")
    )
    return per.withColumn("duplicate_occurrences", F.col("rows") - F.col("ids"))


def cv_population(col: str) -> Column:
    """Aggregate: population deviation over mean, a ratio."""
    return F.stddev_pop(col) / F.avg(col)


def cv_sample_percent(col: str) -> Column:
    """Aggregate: sample deviation over mean in percent; 0 for a single value."""
    return F.coalesce(F.lit(100.0) * F.when(F.count(col) > 1, F.stddev_samp(col)) / F.avg(col), F.lit(0.0))


def pooled_throughput(items: str, seconds: str) -> Column:
    """Aggregate: all items over all seconds."""
    return F.sum(items) / F.sum(seconds)


def median_throughput(items: str, seconds: str) -> Column:
    """Aggregate: median of the runs' own throughputs."""
    return F.percentile(F.col(items) / F.col(seconds), F.lit(0.5))


def conservative_cost(seconds: str) -> Column:
    """Aggregate: the worst repeat."""
    return F.max(seconds)
