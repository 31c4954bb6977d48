"""Planning arithmetic over small tables of measurements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import stats


def shard_plan(rows: DataFrame, local: DataFrame, listed: DataFrame, *, shard_col: str = "shard") -> DataFrame:
    """``(shard, wanted_rows, present, missing_bytes, size_source)`` for each needed shard.

    ``rows(shard)`` are the wanted rows, ``local(shard, bytes)`` the shards at hand, ``listed(shard, bytes)`` sizes that the
    store lists.  All missing shards take their size from one source: the list if it has every one of them, else the
    rounded mean of the local shards.  Without local shards either, sizes are null.
    """
    need = rows.groupBy(shard_col).agg(F.count("*").alias("wanted_rows"))
    have = local.select(shard_col).distinct().withColumn("present", F.lit(True))
    known = listed.select(shard_col, F.col("bytes").alias("__listed"))
    out = need.join(have, shard_col, "left").join(known, shard_col, "left").withColumn("present", F.coalesce("present", F.lit(False)))
    lacking = out.agg(F.coalesce(F.max((~F.col("present") & F.col("__listed").isNull()).cast("int")), F.lit(0)).alias("__lacking"))
    mean = local.agg(F.bround(F.avg("bytes"), 0).cast("long").alias("__mean"))
    out = out.crossJoin(F.broadcast(lacking)).crossJoin(F.broadcast(mean))  # two single rows
    complete = F.col("__lacking") == 0
    size = F.when(complete, F.col("__listed").cast("long")).otherwise(F.col("__mean"))
    source = F.when(complete, F.lit("listed")).otherwise(F.lit("local_mean"))
    return out.select(shard_col, "wanted_rows", "present", F.when(~F.col("present"), size).alias("missing_bytes"), source.alias("size_source"))


def disk_budget(plan: DataFrame, *, bytes_per_row: float, free_bytes: int, headroom: float = 0.10) -> DataFrame:
    """One row: what a shard plan needs if all shards are kept, and at the peak if each goes once it is packed.

    Headroom is a share of the free disk that stays free.
    """
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    sums = plan.agg(
        zero(F.sum("missing_bytes")).alias("missing_bytes"), zero(F.max("missing_bytes")).alias("largest_bytes"),
        zero(F.bround(F.sum("wanted_rows") * F.lit(float(bytes_per_row)), 0)).alias("packed_bytes"),
    )
    keep, peak, usable = F.col("missing_bytes") + F.col("packed_bytes"), F.col("packed_bytes") + F.col("largest_bytes"), F.lit(free_bytes * (1.0 - headroom))
    return sums.select("*", keep.alias("keep_bytes"), (keep <= usable).alias("keep_fits"), peak.alias("streaming_bytes"), (peak <= usable).alias("streaming_fits"))


def ingest_actions(plan: DataFrame, marker: str = "has_marker", file: str = "has_file") -> DataFrame:
    """Adds ``action``: skip what is done, ingest what is there, download the rest."""
    done, there = F.coalesce(F.col(marker), F.lit(False)), F.coalesce(F.col(file), F.lit(False))
    return plan.withColumn("action", F.when(done, "skip").when(there, "ingest").otherwise("download"))


def storage_projection(df: DataFrame, bytes_col: str, targets: Sequence[int]) -> DataFrame:
    """``(target, bytes)``: bytes for each row times the target numbers of rows."""
    per = df.agg((F.sum(bytes_col) / F.count("*")).alias("bytes_per_row"))
    return per.select("bytes_per_row", F.explode(F.array(*[F.lit(int(t)) for t in targets])).alias("target")).withColumn("bytes", F.col("bytes_per_row") * F.col("target"))


def runtime_projection(items: Column, throughput: Column, buffer: float = 0.0) -> Column:
    """Seconds for so many items at a throughput, with a buffer share."""
    return items / throughput * (1 + buffer)


def step_budget(runs: DataFrame, *, by: Sequence[str], seconds: str, identity: str, budget_seconds: float, multiple: int) -> DataFrame:
    """Steps that fit a budget at the worst repeat's cost, as a multiple; ``same_run`` if all repeats agree on identity."""
    out = runs.groupBy(*by).agg(
        stats.conservative_cost(seconds).alias("worst_seconds"), F.count("*").alias("repeats"),
        (F.min(identity) == F.max(identity)).alias("same_run"), stats.cv_population(seconds).alias("cv"),
    )
    return out.withColumn("steps", (F.floor(F.lit(budget_seconds) / F.col("worst_seconds") / multiple) * multiple).cast("long"))


def training_budget(n: Column, batch: int, epochs: int, step_seconds: float, eval_rows: int, eval_seconds: float) -> Column:
    """Struct of steps for each epoch, rows of the last batch (``n mod b`` or b) and total seconds."""
    steps = F.ceil(n / batch)
    tail = F.when(n % batch == 0, F.lit(batch)).otherwise(n % batch)
    total = epochs * (steps * step_seconds + eval_rows * eval_seconds)
    return F.struct(steps.alias("steps"), tail.alias("last_batch"), total.alias("seconds"))


def change_percent(before: Column, after: Column) -> Column:
    """Reduction from before to after in percent; negative for growth."""
    return F.lit(100.0) * (before - after) / before


def ab_gate(runs: DataFrame, *, variant: str, baseline: str, candidate: str, items: str, seconds: str, memory: str, same: bool = True, min_gain: float = 15.0, max_cv: float = 15.0, max_memory: float = 256.0) -> DataFrame:
    """One row of gates that a candidate passes over a baseline, and ``accepted`` if all do."""
    def side(name: str, prefix: str) -> DataFrame:
        r = runs.where(F.col(variant) == name).withColumn("__t", F.col(items) / F.col(seconds))
        return r.agg(F.percentile("__t", F.lit(0.5)).alias(f"{prefix}_throughput"), stats.cv_sample_percent("__t").alias(f"{prefix}_cv"), F.max(memory).alias(f"{prefix}_memory"))

    both = side(baseline, "a").crossJoin(side(candidate, "b"))  # single rows
    gain = F.lit(100.0) * (F.col("b_throughput") / F.col("a_throughput") - 1)
    gates = both.withColumns({
        "gain_percent": gain, "fast_enough": gain >= min_gain, "stable": (F.col("a_cv") <= max_cv) & (F.col("b_cv") <= max_cv),
        "small_enough": F.col("b_memory") - F.col("a_memory") <= max_memory, "equivalent": F.lit(same),
    })
    return gates.withColumn("accepted", F.col("fast_enough") & F.col("stable") & F.col("small_enough") & F.col("equivalent"))


def expected_queries(batches: DataFrame, batch_col: str, shard_col: str) -> DataFrame:
    """One row: the sum over batches of their distinct shards."""
    return batches.select(batch_col, shard_col).distinct().agg(F.count("*").alias("queries"))


def epoch_cost(n: Column, per_item: Column, repeats: int = 1) -> Column:
    """Cost of so many passes over n items."""
    return n * per_item * repeats
