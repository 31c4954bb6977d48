"""Validation suites.  Every check yields issue rows ``(check, code, count, examples)``; none means passed.

The collecting form returns the issues; ``require`` turns them into an error for callers that must fail fast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import cleaned, first_part, full_match, is_bare_name
from tallyloom.operators import sets

ISSUE = "check string, code string, count long, examples array<string>"
EXAMPLES = 10


def no_issues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ISSUE)


def issue(df: DataFrame, check: str, code: str, bad: Column, example: Column, n: int = EXAMPLES) -> DataFrame:
    """One issue row if any row is bad: their count and the least distinct examples."""
    rows = df.where(F.coalesce(bad, F.lit(False))).select(F.lit(code).alias("code"), example.cast("string").alias("e"))
    counts = rows.groupBy("code").agg(F.count("*").alias("count"))
    least = sets.least_values(rows, ["code"], "e", n)
    return counts.join(least, "code").select(F.lit(check).alias("check"), "code", "count", "examples")


def all_issues(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Issues of several checks in one frame."""
    for df in rest:
        first = first.unionByName(df)
    return first


def require(issues: DataFrame) -> None:
    """Raises with the issue codes if there is an issue."""
    found = issues.orderBy("check", "code").limit(20).collect()
    if found:
        raise ValueError("; ".join(f"{r['check']}/{r['code']}: {r['count']} ({', '.join(r['examples'] or [])})" for r in found))


def passed(issues: DataFrame) -> DataFrame:
    """One row ``(passed, issues)``."""
    return issues.agg((F.count("*") == 0).alias("passed"), F.count("*").alias("issues"))


def repeated(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values that occur more than once, with ``n``; blanks aside."""
    some = df.where(F.concat_ws("", *columns) != "")
    return some.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def table_issues(df: DataFrame, *, id_col: str, entity_col: str, category_col: str, categories: Sequence[str], name: str = "table", path_prefix: bool = True) -> DataFrame:
    """Blank values, invalid categories, repeated ids and rows, ids whose first part isn't the entity, no rows."""
    i, e, c = (cleaned(F.col(x)) for x in (id_col, entity_col, category_col))
    rows = df.select(i.alias("i"), e.alias("e"), c.alias("c"))
    checks = [issue(rows, name, f"missing_{n}", F.col(k) == "", F.concat_ws("|", "i", "e", "c")) for k, n in (("i", "id"), ("e", "entity"), ("c", "category"))]
    checks.append(issue(rows, name, "invalid_category", (F.col("c") != "") & ~F.col("c").isin(*categories), F.col("c")))
    checks.append(issue(repeated(rows, ["i"]), name, "duplicate_id", F.lit(True), F.col("i")))
    checks.append(issue(repeated(rows, ["i", "e", "c"]), name, "duplicate_row", F.lit(True), F.col("i")))
    if path_prefix:
        checks.append(issue(rows, name, "prefix_mismatch", (F.col("i") != "") & (F.col("e") != "") & (first_part(F.col("i")) != F.col("e")), F.col("i")))
    checks.append(issue(rows.agg(F.count("*").alias("n")), name, "empty_table", F.col("n") == 0, F.lit(name)))
    return all_issues(*checks)


def pattern_issues(df: DataFrame, *, id_col: str, entity_col: str, category_col: str, patterns: Mapping[str, str], name: str = "pattern") -> DataFrame:
    """Ids that don't fully match their category's pattern, or whose first group isn't the entity."""
    bad = F.lit(False)
    for category, pattern in patterns.items():
        matches = full_match(F.col(id_col), pattern)
        wrong = ~matches | (F.regexp_extract(F.col(id_col), rf"\A(?:{pattern})\z", 1) != F.col(entity_col).cast("string"))
        bad = F.when(F.col(category_col) == category, wrong).otherwise(bad)
    return issue(df, name, "pattern_mismatch", bad, F.col(id_col))


def subset_issues(df: DataFrame, *, splits: Sequence[str], split_col: str, id_col: str, entity_col: str, target_col: str, name: str = "subset") -> DataFrame:
    """Rules of a balanced subset: as many rows of target 0 as of 1 in each of ``splits`` and some of each, no id twice in a
    partition, no id and no entity in two.  A listed partition without rows is not balanced."""
    listed = df.sparkSession.createDataFrame([(s,) for s in splits], f"{split_col} string")
    zeros, ones = (F.coalesce(F.sum((F.col(target_col) == v).cast("long")), F.lit(0)) for v in (0, 1))
    counts = listed.join(df, split_col, "left").groupBy(split_col).agg(zeros.alias("zeros"), ones.alias("ones"))
    uneven = issue(counts, name, "not_balanced", (F.col("zeros") != F.col("ones")) | (F.col("zeros") == 0), F.col(split_col))
    twice = df.where(F.col(id_col).isNotNull()).groupBy(split_col, id_col).agg(F.count("*").alias("k"))
    repeated = issue(twice, name, "duplicate_id", F.col("k") > 1, F.col(id_col))
    keys = {"id_in_splits": id_col, "entity_in_splits": entity_col}
    return all_issues(uneven, repeated, disjoint_issues(df, split_col=split_col, keys=keys, groups=[splits], name=name))


def disjoint_issues(df: DataFrame, *, split_col: str, keys: Mapping[str, str], groups: Sequence[Sequence[str]], name: str = "disjoint") -> DataFrame:
    """Keys that partitions share which must be disjoint; ``keys`` maps an issue code to a column."""
    allowed = None
    for g in groups:
        hit = F.col("left_split").isin(*g) & F.col("right_split").isin(*g)
        allowed = hit if allowed is None else allowed | hit
    out = []
    for code, col in keys.items():
        pairs = sets.pairwise_overlap(df, split_col, col).where(allowed)
        out.append(pairs.select(F.concat(F.lit(f"{name}:"), "left_split", F.lit("/"), "right_split").alias("check"), F.lit(code).alias("code"), F.col("overlap").alias("count"), "examples"))
    return all_issues(*out)


def coverage_issues(actual: DataFrame, expected: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Rows of one set that the other lacks, each way."""
    missing, extra = sets.difference_rows(actual, expected, columns)
    example = F.concat_ws("|", *columns)
    return all_issues(issue(missing, name, "missing_rows", F.lit(True), example, 5), issue(extra, name, "extra_rows", F.lit(True), example, 5))


def constraint_issues(df: DataFrame, split_col: str, category_col: str, allowed: Mapping[str, Sequence[str]], name: str = "constraint") -> DataFrame:
    """Partitions with categories beyond the allowed ones."""
    bad = sets.outside_allowed(df, split_col, category_col, allowed)
    return bad.select(F.concat(F.lit(f"{name}:"), "split").alias("check"), F.lit("category_not_allowed").alias("code"), F.size("invalid").cast("long").alias("count"), F.col("invalid").alias("examples"))


def protocol_issues(
    metadata: DataFrame, parts: DataFrame, *, id_col: str, entity_col: str, category_col: str, part_col: str,
    disjoint: Sequence[Sequence[str]], allowed: Mapping[str, Sequence[str]], same_entities: tuple[str, str] | None = None,
    covers: Sequence[str] = (),
) -> DataFrame:
    """The split protocol's checks together, over one frame of all partitions.

    Checked: disjoint groups (entities and ids), allowed categories, equal cohorts of two partitions, and that some
    partitions together are exactly the metadata.  They run only if the metadata has rows and every named
    partition is present; else one issue says so.
    """
    spark, names = metadata.sparkSession, {n for g in disjoint for n in g} | set(allowed) | set(covers)
    there = {r[0] for r in parts.where(F.col(part_col).isin(*names)).select(part_col).distinct().collect()}
    lacking = sorted(names - there)
    if lacking or metadata.isEmpty():
        rows = [("protocol", "missing_partition", len(lacking), lacking[:EXAMPLES])] if lacking else [("protocol", "empty_metadata", 1, [])]
        return spark.createDataFrame(rows, ISSUE)
    columns = [id_col, entity_col, category_col]
    checks = [
        disjoint_issues(parts, split_col=part_col, keys={"entity_overlap": entity_col, "id_overlap": id_col}, groups=disjoint),
        constraint_issues(parts, part_col, category_col, allowed),
    ]
    if covers:
        checks.append(coverage_issues(parts.where(F.col(part_col).isin(*covers)), metadata, columns, "coverage"))
    if same_entities:
        a, b = (parts.where(F.col(part_col) == p) for p in same_entities)
        checks.append(coverage_issues(a, b, [entity_col], "cohort"))
    return all_issues(*checks)


def manifest_issues(df: DataFrame, *, splits: Sequence[str], categories: Sequence[str], negative: str, shards: DataFrame | None = None) -> DataFrame:
    """The integrity rules of a manifest (columns as ``sources.tables.MANIFEST``), as issues.

    Non-empty id and entity, unique id, known split and category, an integer label that the category implies, a
    positive integer rate, each entity in one split, one version and one snapshot, a bare shard name, an existing
    shard (if shards are given), at least one row.
    """
    i = F.col("file")
    label, rate = F.col("binary_label").try_cast("int"), F.col("native_sample_rate").try_cast("int")
    want = F.when(F.col("utt_type") == negative, 0).otherwise(1)
    blank = lambda c: cleaned(F.col(c)) == ""
    rule = lambda code, bad: issue(df, "manifest", code, bad, i)
    checks = [
        rule("empty_id", blank("file")), rule("empty_entity", blank("speaker_id")), rule("unknown_split", ~F.coalesce(F.col("split").isin(*splits), F.lit(False))),
        rule("unknown_category", ~F.coalesce(F.col("utt_type").isin(*categories), F.lit(False))), rule("bad_label", label.isNull() | ~label.isin(0, 1)),
        rule("label_mismatch", label.isin(0, 1) & (label != want)), rule("bad_rate", rate.isNull() | (rate <= 0)),
        rule("missing_version", blank("manifest_version")), rule("missing_snapshot", blank("source_snapshot")), rule("unsafe_shard", blank("shard") | ~is_bare_name(F.col("shard"))),
        issue(repeated(df, ["file"]), "manifest", "duplicate_id", F.lit(True), i),
    ]
    for code, by, col in (("entity_in_splits", "speaker_id", "split"),):
        spread = df.where(F.col(by).isNotNull()).groupBy(by).agg((F.min(col) != F.max(col)).alias("bad"))
        checks.append(issue(spread, "manifest", code, F.col("bad"), F.col(by)))
    for code, col in (("several_versions", "manifest_version"), ("several_snapshots", "source_snapshot")):
        checks.append(issue(df.agg(F.min(col).alias("a"), F.max(col).alias("z")), "manifest", code, F.col("a") != F.col("z"), F.concat_ws("|", "a", "z")))
    checks.append(issue(df.agg(F.count("*").alias("n")), "manifest", "no_rows", F.col("n") == 0, F.lit("manifest")))
    if shards is not None:
        gone = df.select("shard").distinct().join(shards.select("shard"), "shard", "left_anti")
        checks.append(issue(gone, "manifest", "missing_shard", F.lit(True), F.col("shard")))
    return all_issues(*checks)


def geometry_issues(meta: DataFrame, local: DataFrame, *, id_col: str, shard_col: str = "shard") -> DataFrame:
    """Shards at hand whose ids aren't exactly the predicted ones; both frames have the id and its shard."""
    here = local.select(shard_col).distinct()
    expected = meta.join(here, shard_col, "left_semi")
    missing, extra = sets.difference_rows(local, expected, [shard_col, id_col])
    out = []
    for rows, code in ((missing, "missing_ids"), (extra, "extra_ids")):
        n = rows.groupBy(shard_col).agg(F.count("*").alias("count"))
        least = sets.least_values(rows, [shard_col], id_col, 5)
        out.append(n.join(least, shard_col).select(F.concat(F.lit("geometry:"), F.col(shard_col).cast("string")).alias("check"), F.lit(code).alias("code"), "count", F.col("examples").cast("array<string>").alias("examples")))
    return all_issues(*out)


def value_differences(a: DataFrame, b: DataFrame, *, id_col: str, columns: Sequence[str]) -> DataFrame:
    """``(id, field)`` of every column whose values differ between two states, or whose row one of them lacks."""
    l, r = a.withColumn("__l", F.lit(1)).alias("l"), b.withColumn("__r", F.lit(1)).alias("r")
    joined = l.join(r, F.col(f"l.{id_col}").eqNullSafe(F.col(f"r.{id_col}")), "full")
    fields = [F.when(F.col("__l").isNull() | F.col("__r").isNull(), F.lit("(row)"))]
    fields += [F.when(F.col("__l").isNotNull() & F.col("__r").isNotNull() & ~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)) for c in columns]
    found = joined.select(F.coalesce(F.col(f"l.{id_col}"), F.col(f"r.{id_col}")).alias(id_col), F.explode(F.filter(F.array(*fields), lambda x: x.isNotNull())).alias("field"))
    return found
