"""Duplicates by content identity: ledgers, groups, precedence between partitions.

Groups are summarised by map-side combined aggregates.  Ids of a group are listed only up to a stated number
of examples, so a group of any size fits.  What rows are joined back to is written first: a join whose other side
is an aggregate of its own stage can't be split when one content has very many rows, a join of two tables can.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import keys
from tallyloom.operators.sets import least_values
from tallyloom.session import materialize


def keep_first(df: DataFrame, *, hash_col: str, order: Column, id_col: str) -> DataFrame:
    """Adds ``representative`` (the id kept for the row's content) and ``kept``.

    The least of ``order`` and id wins: an aggregate over the packed order text, not a sort of each group, so one
    content that very many rows share costs one row per task.  Only contents of several rows are joined back.
    Null content is never a duplicate.
    """
    packed = F.concat_ws("\0", order.cast("string"), F.col(id_col).cast("string"))
    groups = df.where(F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).alias("__h"))
    winners = materialize(groups.agg(F.min(packed).alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n"), "winners")
    joined = df.join(winners, F.col(hash_col) == F.col("__h"), "left")
    own = F.col(id_col).cast("string")
    rep = F.coalesce(F.substring_index("__first", "\0", -1), own)
    return joined.withColumn("representative", rep).withColumn("kept", F.col("representative").eqNullSafe(own)).drop("__h", "__first")


def content_representatives(df: DataFrame, seed: int, *, hash_col: str, id_col: str) -> DataFrame:
    """``keep_first`` by the stable row key, across all partitions at once."""
    return keep_first(df, hash_col=hash_col, order=keys.row_key(seed, F.col(id_col)), id_col=id_col)


def duplicate_groups(df: DataFrame, *, hash_col: str, id_col: str, crossing: Sequence[str] = (), n_examples: int = 5) -> DataFrame:
    """Contents with more than one id: size, ``crosses_*`` for each column with several values, least ids."""
    rows = df.where(F.col(hash_col).isNotNull())
    aggregates = [F.min(F.col(c)).alias(f"__a_{c}") for c in crossing] + [F.max(F.col(c)).alias(f"__z_{c}") for c in crossing]
    per_id = materialize(rows.select(hash_col, id_col).distinct().groupBy(hash_col).agg(F.count("*").alias("ids")).where("ids > 1"), "groups")
    spread = rows.groupBy(hash_col).agg(F.count("*").alias("rows"), *aggregates).join(per_id, hash_col)
    flags = [(F.col(f"__a_{c}") != F.col(f"__z_{c}")).alias(f"crosses_{c}") for c in crossing]
    groups = spread.select(F.col(hash_col).alias("content"), "rows", "ids", *flags)
    examples = least_values(rows.join(per_id, hash_col, "left_semi").select(F.col(hash_col).alias("content"), F.col(id_col).alias("e")), ["content"], "e", n_examples)
    return groups.join(examples, "content")


def two_phase_duplicates(df: DataFrame, *, cheap: Column, exact: Column, id_col: str, strict: bool = False) -> DataFrame:
    """``(content, ids)`` confirmed by the exact hash, which only rows that share a cheap hash compute.

    With ``strict`` a cheap group counts only if all its members share one exact hash; else its exact
    sub-groups count by themselves.
    """
    rows = df.withColumn("__cheap", cheap)
    shared = materialize(rows.groupBy("__cheap").agg(F.count("*").alias("n")).where("n > 1 AND __cheap IS NOT NULL").select("__cheap"), "shared")
    confirmed = rows.join(shared, "__cheap", "left_semi").withColumn("content", exact)
    groups = confirmed.groupBy("__cheap", "content").agg(F.countDistinct(id_col).alias("ids"))
    if strict:
        pure = groups.groupBy("__cheap").agg(F.count("*").alias("n")).where("n = 1").select("__cheap")
        groups = groups.join(pure, "__cheap", "left_semi")
    return groups.groupBy("content").agg(F.sum("ids").alias("ids")).where("ids > 1")


def groups_in_selection(groups: DataFrame, selection: DataFrame, *, id_col: str, split_col: str) -> DataFrame:
    """Confirmed groups ``(content, id)`` that a selection holds two or more members of, and whether they cross splits."""
    held = groups.join(selection.select(F.col(id_col).alias("__i"), F.col(split_col).alias("__s")), groups["id"] == F.col("__i"))
    out = held.groupBy("content").agg(F.countDistinct("id").alias("ids"), F.min("__s").alias("__a"), F.max("__s").alias("__z")).where("ids > 1")
    return out.select("content", "ids", (F.col("__a") != F.col("__z")).alias("crosses_splits"))


def evaluation_ledger(train: DataFrame, dev: DataFrame, test: DataFrame, seed: int, *, hash_col: str, id_col: str) -> DataFrame:
    """Every dev and test row with its ``split`` and ``decision``.

    Train content goes first (``train_overlap``), then in test the content of any dev row (``dev_overlap``), then
    all but the first by stable key of what is left (``internal_duplicate``); the rest is ``kept``.  Nothing is
    refilled, and null content is never a duplicate.  Presence by content is one aggregate over the three sets and one join.
    """
    tag = lambda df, s: df.select(F.col(hash_col).alias("__there"), F.lit(s).alias("s"))
    there = tag(train, "train").unionByName(tag(dev, "dev")).groupBy("__there").agg(
        F.max((F.col("s") == "train").cast("int")).alias("in_train"), F.max((F.col("s") == "dev").cast("int")).alias("in_dev")
    )
    there = materialize(there, "there")
    rows = dev.withColumn("split", F.lit("dev")).unionByName(test.withColumn("split", F.lit("test")))
    joined = rows.join(there, F.col(hash_col) == F.col("__there"), "left").drop("__there")
    early = F.when(F.col("in_train") == 1, "train_overlap").when((F.col("split") == "test") & (F.col("in_dev") == 1), "dev_overlap")
    joined = joined.withColumn("__early", early).drop("in_train", "in_dev")
    packed = F.concat_ws("\0", keys.row_key(seed, F.col(id_col)), F.col(id_col).cast("string"))
    first = joined.where("__early IS NULL").groupBy(F.col("split").alias("__s"), F.col(hash_col).alias("__h")).agg(F.min(packed).alias("__first"))
    first = materialize(first, "first")
    out = joined.join(first, (F.col("split") == F.col("__s")) & (F.col(hash_col) == F.col("__h")), "left")
    late = F.when((F.col("__first") == packed) | F.col(hash_col).isNull(), "kept").otherwise("internal_duplicate")
    return out.withColumn("decision", F.coalesce("__early", late)).drop("__early", "__s", "__h", "__first")


def ledger_losses(ledger: DataFrame, category_col: str, max_loss: float = 0.05) -> DataFrame:
    """Per split and category: rows, lost rows, their share, and whether it is above the limit (equal passes)."""
    lost = F.sum((F.col("decision") != "kept").cast("long"))
    out = ledger.groupBy("split", F.col(category_col).alias("category")).agg(F.count("*").alias("rows"), lost.alias("lost"))
    return out.withColumn("loss", F.col("lost") / F.col("rows")).withColumn("stop", F.col("loss") > max_loss)


def mixed_targets(df: DataFrame, *, hash_col: str, target_col: str) -> DataFrame:
    """Contents that carry different targets, with their rows."""
    out = df.where(F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).alias("content")).agg(
        F.count("*").alias("rows"), F.min(target_col).alias("a"), F.max(target_col).alias("z")
    )
    return out.where("a <> z").select("content", "rows")
