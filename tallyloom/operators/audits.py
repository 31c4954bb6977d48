"""Audits composed of the other operators: snapshots, sample levels, parity of two stores, repeated reads, chunk indexes.

Each yields issue rows or a small summary; samples are read once and never leave the executors.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import arrays, keys
from tallyloom.functions.hashing import additive_digest, content_hash
from tallyloom.operators import dedup, joins, stats, validation
from tallyloom.operators.windows import top_per_group

POLICIES = ("none", "peak", "rms_dbfs")


def metadata_audit(df: DataFrame, *, id_col: str, entity_col: str, category_col: str, categories: Sequence[str], patterns: Mapping[str, str] | None = None) -> DataFrame:
    """Issues of the table rules and, if patterns are given, of ids against their category's pattern."""
    found = validation.table_issues(df, id_col=id_col, entity_col=entity_col, category_col=category_col, categories=categories)
    if patterns:
        found = validation.all_issues(found, validation.pattern_issues(df, id_col=id_col, entity_col=entity_col, category_col=category_col, patterns=patterns))
    return found


def samples_audit(rows: DataFrame, meta: DataFrame, *, id_col: str, samples_col: str, rate_col: str, compare: Sequence[str]) -> DataFrame:
    """Issues of stored samples: null or empty arrays, rates that aren't positive, repeated ids, other metadata."""
    samples, rate, i = F.col(samples_col), F.col(rate_col), F.col(id_col)
    rule = lambda code, bad: validation.issue(rows, "samples", code, bad, i)
    lookups = joins.lookup_issues(rows.select(id_col, *compare), meta.select(id_col, *compare), id_col=id_col, compare=compare)
    return validation.all_issues(
        rule("null_samples", samples.isNull()), rule("empty_samples", F.size(samples) == 0), rule("bad_rate", rate.isNull() | (rate <= 0)),
        validation.issue(validation.repeated(rows.select(F.col(id_col).cast("string")), [id_col]), "samples", "duplicate_id", F.lit(True), F.col(id_col)),
        validation.issue(lookups, "samples", "missing_metadata", F.col("issue") == "missing", i),
        validation.issue(lookups, "samples", "metadata_mismatch", F.col("issue") == "mismatch", i),
    )


def duplicate_audit(rows: DataFrame, *, id_col: str, samples_col: str, rate_col: str, crossing: Sequence[str], strict: bool = False) -> DataFrame:
    """Groups of equal samples: a 64-bit hash over all rows, the byte hash only where that one repeats.

    Two arrays that differ in the sign of a zero share the cheap hash and part under the exact one.
    """
    cheap = F.xxhash64(F.col(samples_col))
    base = rows.select(id_col, samples_col, rate_col, *crossing).withColumn("__cheap", cheap)
    many = base.groupBy("__cheap").agg(F.count("*").alias("n")).where("n > 1").select("__cheap")
    hashed = base.join(many, "__cheap", "left_semi").withColumn("content", content_hash(F.col(samples_col), F.col(rate_col)))
    hashed = hashed.drop(samples_col)
    if strict:
        pure = hashed.groupBy("__cheap").agg(F.countDistinct("content").alias("n")).where("n = 1").select("__cheap")
        hashed = hashed.join(pure, "__cheap", "left_semi")
    return dedup.duplicate_groups(hashed, hash_col="content", id_col=id_col, crossing=crossing)


def sampled_levels(rows: DataFrame, *, id_col: str, category_col: str, samples_col: str, rate_col: str, per_category: int, seed: int) -> DataFrame:
    """Level statistics of a stable sample of each category (the sample is the feature: a quick listening check)."""
    picked = top_per_group(rows.select(id_col, category_col), [category_col], [keys.row_key(seed, F.col(id_col)), F.col(id_col)], per_category).drop("rank")
    full = rows.join(picked.select(id_col), id_col, "left_semi")
    return full.select(id_col, category_col, arrays.waveform_summary(F.col(samples_col), F.col(rate_col)).alias("s")).select(id_col, category_col, "s.*")


def amplitude_audit(rows: DataFrame, *, samples_col: str, dimensions: Sequence[str], **gain) -> DataFrame:
    """Input and output levels and gain under every policy, summarised by policy and by policy and each dimension.

    A gain scales peak and RMS alike, so outputs follow from the inputs without scaling a sample.
    """
    peak, rms, db = arrays.measure(F.col(samples_col))
    df = rows.select(*dimensions, peak.alias("input_peak"), rms.alias("rms"), db.alias("input_rms_dbfs"))
    df = df.withColumn("policy", F.explode(F.array(*[F.lit(p) for p in POLICIES])))
    df = df.withColumn("g", arrays.policy_gain(F.col("policy"), F.col("input_peak"), F.col("input_rms_dbfs"), **gain)).select("*", "g.*")
    df = df.withColumns({
        "output_peak": F.col("input_peak") * F.col("applied_gain"),
        "output_rms_dbfs": 20.0 * F.log10(F.greatest(F.col("rms") * F.col("applied_gain"), F.lit(arrays.EPSILON))),
    })
    measures = ["input_peak", "output_peak", "input_rms_dbfs", "output_rms_dbfs", "applied_gain"]
    return stats.numeric_summaries(df, measures, ["near_silence", "peak_limited"], [["policy"], *[["policy", c] for c in dimensions]])


def parity(a: DataFrame, b: DataFrame, *, id_col: str, compare: Sequence[str], samples_col: str) -> DataFrame:
    """One row: ids of either store, of both, with other metadata, with other samples, and the largest difference."""
    l, r = a.withColumn("__l", F.lit(1)).alias("l"), b.withColumn("__r", F.lit(1)).alias("r")
    j = l.join(r, F.col(f"l.{id_col}") == F.col(f"r.{id_col}"), "full")
    both = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    same = F.lit(True)
    for c in compare:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    gap = arrays.max_abs_difference(F.col(f"l.{samples_col}"), F.col(f"r.{samples_col}"))
    count = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0))
    return j.agg(
        F.count("*").alias("ids"), count(both).alias("common"), count(both & ~same).alias("metadata_mismatches"),
        count(both & (gap.isNull() | (gap > 0))).alias("sample_mismatches"), F.max(gap).alias("max_difference"),
    )


def reproducible(first: DataFrame, second: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: whether two reads yield the same rows in any order, by count and two hash sums."""
    x = first.agg(additive_digest(*[F.col(c) for c in columns]).alias("x"))
    y = second.agg(additive_digest(*[F.col(c) for c in columns]).alias("y"))
    return x.crossJoin(y).select(F.col("x").eqNullSafe(F.col("y")).alias("same"), F.col("x.n").alias("rows"))  # single rows


def chunk_issues(index: DataFrame, marker: DataFrame, *, negative: str) -> DataFrame:
    """Issues of chunk indexes against their markers ``(shard, rows)``: row counts, shards without either, labels."""
    n = index.groupBy("shard").agg(F.count("*").alias("found"))
    j = n.join(marker.select("shard", "rows"), "shard", "full")
    want = F.when(F.col("utt_type") == negative, 0).otherwise(1)
    return validation.all_issues(
        validation.issue(j, "chunk", "row_count", F.col("found") != F.col("rows"), F.col("shard")),
        validation.issue(j, "chunk", "no_marker", F.col("rows").isNull(), F.col("shard")),
        validation.issue(j, "chunk", "no_rows", F.col("found").isNull() & (F.col("rows") > 0), F.col("shard")),
        validation.issue(index, "chunk", "label_mismatch", F.col("binary_label").cast("int") != want, F.col("file")),
        validation.issue(validation.repeated(index.select("file"), ["file"]), "chunk", "duplicate_id", F.lit(True), F.col("file")),
    )


def workloads(rows: DataFrame, seed: int, n: int, *, id_col: str, shard_col: str) -> DataFrame:
    """Request lists ``(workload, position, id)`` for read tests: one shard, as many shards as possible, stable shuffle."""
    key, tie = keys.row_key(seed, F.col(id_col)), F.col(id_col).cast("string")
    sizes = rows.groupBy(shard_col).agg(F.count("*").alias("c"))
    largest = sizes.orderBy(F.col("c").desc(), shard_col).limit(1).select(shard_col)
    one = rows.join(largest, shard_col, "left_semi").orderBy(key, tie).limit(n).withColumn("workload", F.lit("same_shard"))
    spread = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(shard_col).orderBy(key, tie)))
    spread = spread.where(F.col("__rn") <= n).orderBy("__rn", key, tie).limit(n).drop("__rn").withColumn("workload", F.lit("dispersed"))
    mixed = rows.orderBy(key, tie).limit(n).withColumn("workload", F.lit("shuffled"))
    every = one.unionByName(spread).unionByName(mixed)
    place = F.row_number().over(Window.partitionBy("workload").orderBy(key, tie)) - 1  # at most n rows each
    return every.select("workload", place.alias("position"), id_col, shard_col)
