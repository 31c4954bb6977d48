"""Operators on small tables with known results."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import dedup, joins, sampling, sets, stats, validation, windows


def test_allocation_by_largest_remainder():
    assert sampling.allocate_counts(978) == {"train": 684, "dev": 147, "test": 147}
    assert sampling.allocate_counts(144) == {"train": 101, "dev": 22, "test": 21}
    assert sampling.allocate_counts(19) == {"train": 13, "dev": 3, "test": 3}
    assert sampling.allocate_counts(0) == {"train": 0, "dev": 0, "test": 0}


def test_column_allocation_equals_scalar(spark):
    rows = [(f"e{i:04d}", f"s{n}") for n in (0, 1, 2, 3, 7, 19, 144, 301) for i in range(n)]
    out = sampling.split_entities(spark.createDataFrame(rows, "entity string, stratum string"), 2026)
    got = {}
    for r in out.groupBy("stratum", "split").count().collect():
        got.setdefault(r.stratum, {})[r.split] = r["count"]
    for n in (1, 2, 3, 7, 19, 144, 301):
        assert got[f"s{n}"] == {k: v for k, v in sampling.allocate_counts(n).items() if v}


def test_largest_remainder_rejects_negative_weights(spark):
    df = spark.createDataFrame([("a", -1), ("b", 3)], "k string, w long").withColumn("g", F.lit(0))
    with pytest.raises(Exception, match="weights"):
        sampling.largest_remainder(df, ["g"], "w", F.lit(5), [F.col("k")]).collect()


def test_balanced_subset_spreads_positives(spark):
    rng = random.Random(17)
    for per_class in (5, 14):
        sizes = {"none": 20, "north": rng.randrange(1, 4), "east": rng.randrange(6, 9), "south": rng.randrange(4, 20)}
        rows = [(f"{k}-{i}", k) for k, n in sizes.items() for i in range(n)]
        want = dict.fromkeys(sizes, 0) | {"none": per_class}
        while sum(want.values()) < 2 * per_class and any(want[k] < sizes[k] for k in list(sizes)[1:]):  # in turn
            for k in list(sizes)[1:]:
                want[k] += want[k] < sizes[k] and sum(want.values()) < 2 * per_class
        seen = set()
        for _ in range(2):
            rng.shuffle(rows)
            out = sampling.balanced_subset(spark.createDataFrame(rows, "id string, k string"), 31, "dev", per_class, id_col="id", category_col="k", negative="none", positives=("north", "east", "south"))
            got = sorted((r.position, r.id, r.k) for r in out.collect())
            assert {k: sum(x[2] == k for x in got) for k in sizes} == want and [x[0] for x in got] == list(range(len(got)))
            seen.add(tuple(got))
        assert len(seen) == 1  # whatever the order of the input


def test_evaluation_precedence(spark):
    """Random ledgers against a loop: overlap with train, then with dev (for test), then one row of a content stays."""
    rng = random.Random(23)
    make = lambda split, n: [(f"{split}{i:02d}", f"c{rng.randrange(25)}") for i in range(n)]
    parts = {split: make(split, n) for split, n in (("train", 8), ("dev", 25), ("test", 30))}
    frames = [spark.createDataFrame(rows, "id string, h string") for rows in parts.values()]
    got = {r.id: r.decision for r in dedup.evaluation_ledger(*frames, 5, hash_col="h", id_col="id").collect()}
    train, dev = ({h for _, h in parts[s]} for s in ("train", "dev"))
    assert set(got) == {i for s in ("dev", "test") for i, _ in parts[s]}
    for split in ("dev", "test"):
        groups = {}
        for i, h in parts[split]:
            if h in train:
                assert got[i] == "train_overlap"
            elif split == "test" and h in dev:
                assert got[i] == "dev_overlap"
            else:
                groups.setdefault(h, []).append(got[i])
        assert all(sorted(g) == ["internal_duplicate"] * (len(g) - 1) + ["kept"] for g in groups.values())


def test_loss_limit_is_strict(spark):
    found = {}
    for lost, kept in ((1, 3), (1, 30), (4, 100), (30, 1)):
        rows = [("internal_duplicate",)] * lost + [("kept",)] * kept
        df = spark.createDataFrame(rows, "decision string").withColumns({"split": F.lit("test"), "k": F.lit("b")})
        found[lost / (lost + kept)] = dedup.ledger_losses(df, "k").first().stop
    shares = sorted(found)
    assert [found[s] for s in shares] == sorted(found.values()) and found[shares[-1]] and not found[shares[0]]


def test_duplicate_groups_cross_columns(spark):
    df = spark.createDataFrame([("a", "h", "s1", "train"), ("b", "h", "s2", "dev"), ("c", "g", "s1", "train"), ("d", None, "s1", "dev"), ("e", None, "s1", "dev")], "id string, h string, e string, split string")
    r = dedup.duplicate_groups(df, hash_col="h", id_col="id", crossing=["e", "split"]).collect()
    assert len(r) == 1 and r[0].crosses_e and r[0].crosses_split and r[0].examples == ["a", "b"]


def test_strict_two_phase_drops_mixed_groups(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "y"), ("d", 2, "z"), ("e", 2, "z")], "id string, k long, h string")
    run = lambda strict: {r.content for r in dedup.two_phase_duplicates(df, cheap=F.col("k"), exact=F.col("h"), id_col="id", strict=strict).collect()}
    assert run(False) == {"x", "z"} and run(True) == {"z"}


def test_role_groups_do_not_conflict(spark):
    roles = {"a": ("open", "test"), "b": ("open", "test"), "c": ("open", "train")}
    df = spark.createDataFrame([("1", "h", "a"), ("2", "h", "b"), ("3", "g", "a"), ("3", "g", "c"), ("4", "k", "a"), ("5", "k", "c")], "id string, h string, s string")
    assert [r.hash for r in sets.content_leaks(df, hash_col="h", id_col="id", split_col="s", roles=roles).collect()] == ["k"]


def test_left_join_fans_out_and_counts_matches(spark):
    local = spark.createDataFrame([("a", "x", 0), ("b", "y", 0), ("c", "z", 1)], "id string, k string, shard int")
    meta = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "n")], "id string, k string")
    got = {r.shard: (r.rows, r.ids, r.matches) for r in joins.inventory(local, meta, shard_col="shard", id_col="id", compare=["k"]).collect()}
    assert got == {0: (3, 2, 2), 1: (1, 1, 0)}


def test_positions_of_one_side_are_mismatches(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "i long, v string")
    b = spark.createDataFrame([(0, "x"), (1, "z"), (2, "w")], "i long, v string")
    r = joins.positional_mismatches(a, b, "i", ["v"]).first()
    assert (r.positions, r.mismatches) == (3, 2)


def test_running_totals_over_buckets(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"), F.lit(1).alias("n"))
    out = windows.running_totals(df, ["g"], "v", ["n"], descending=True, buckets=8)
    for g, rows in {k: sorted((r for r in out.collect() if r.g == k), key=lambda r: -r.v) for k in range(3)}.items():
        assert [r.n_upto for r in rows] == list(range(1, len(rows) + 1))
        assert [r.prev_v for r in rows] == [None, *[r.v for r in rows[:-1]]]


def test_quantiles(spark):
    q = lambda xs, p: spark.createDataFrame([(float(x),) for x in xs], "v double").agg(stats.exact_quantile("v", p).alias("q")).first().q
    assert q([1, 2, 3, 4], 0.5) == 2.5 and q([1, 2, 3], 0.95) == pytest.approx(2.9) and q([0, 10], 0.95) == 9.5
    df = spark.createDataFrame([(float(x),) for x in (5, 1, 4, 2, 3)], "v double")
    assert stats.nearest_rank(df, "v", 0.95).first().value == 5


def test_quantiles_and_ranks_by_buckets(spark, monkeypatch):
    monkeypatch.setattr(windows, "BUCKET_ROWS", 7)
    rng = random.Random(3)
    rows = [(rng.choice("xyz"), float(rng.randrange(40))) for _ in range(300)] + [("w", 2.5), ("x", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    held = {g: sorted(v for k, v in rows if k == g and v is not None) for g in "wxyz"}
    for r in stats.linear_quantiles(df, "v", {"a": 0.1, "b": 0.5, "c": 0.95, "d": 1.0}, ["g"]).collect():
        assert (r.a, r.b, r.c, r.d) == pytest.approx(tuple(np.quantile(held[r.g], [0.1, 0.5, 0.95, 1.0]))) and r.n == len(held[r.g])
    whole = sorted(v for _, v in rows if v is not None)
    assert stats.linear_quantiles(df, "v", {"m": 0.5}).first().m == np.quantile(whole, 0.5)
    for r in windows.average_rank(df, ["g"], "v").collect():
        xs = held[r.g]
        assert r.avg_rank == (None if r.v is None else xs.index(r.v) + 1 + (xs.count(r.v) - 1) / 2)


def test_table_issues_and_require(spark):
    df = spark.createDataFrame([("e1/a.wav", "e1", "x"), ("e1/a.wav", "e1", "x"), ("./e2/b.wav", "e2", "bad"), ("e3/c.wav", "e4", "x"), (None, "e5", "x")], "id string, e string, k string")
    found = validation.table_issues(df, id_col="id", entity_col="e", category_col="k", categories=("x",))
    codes = {r.code: r["count"] for r in found.collect()}
    assert codes == {"duplicate_id": 1, "duplicate_row": 1, "invalid_category": 1, "prefix_mismatch": 1, "missing_id": 1}
    with pytest.raises(ValueError, match="duplicate_id"):
        validation.require(found)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id string, e string, k string, h string")
    assert stats.profile(df, id_col="id", entity_col="e", category_col="k").first().rows == 0
    assert stats.rows_per_entity(df, "e").first().max_rows == 0
    assert dedup.content_representatives(df, 1, hash_col="h", id_col="id").count() == 0
    assert sets.pairwise_overlap(df, "k", "e").count() == 0
    assert "empty_table" in {r.code for r in validation.table_issues(df, id_col="id", entity_col="e", category_col="k", categories=("x",)).collect()}


def test_manifest_rules(spark):
    columns = "manifest_version string, shard string, file string, speaker_id string, split string, binary_label string, utt_type string, native_sample_rate string, source_snapshot string"
    good = ("2", "s.parquet", "a", "e1", "train", "0", "neg", "16000", "snap")
    rows = [good, ("2", "../s.parquet", "b", "e1", "dev", "1", "neg", "0", "snap"), ("3", "t.parquet", "b", "", "nope", "x", "odd", "16000", "snap")]
    run = lambda rows: {r.code for r in validation.manifest_issues(spark.createDataFrame(rows, columns), splits=("train", "dev"), categories=("neg", "pos"), negative="neg").collect()}
    assert run([good]) == set()
    assert run(rows) == {"unsafe_shard", "label_mismatch", "bad_rate", "empty_entity", "unknown_split", "bad_label", "unknown_category", "several_versions", "duplicate_id", "entity_in_splits"}


def test_wanted_representatives(spark):
    schema = "i long, k string, y int"
    run = lambda rows: sorted(map(tuple, sampling.wanted_representatives(
        spark.createDataFrame(rows, schema), by="k", wanted=("a", "b"), index_col="i", target_col="y").collect()))
    assert run([(3, "a", 0), (1, "a", 0), (2, "b", 1), (0, "c", 1)]) == [(1, 1), (2, 2)]
    assert run([(1, "a", 0), (4, "c", 1), (2, None, 1), (None, "b", 1)]) == [(1, 1), (3, 2)]  # another row of target 1 follows
    assert run([(1, "a", 0), (2, "b", None)]) == [(1, 1), (2, 2)]
    assert run([]) == []


def test_subset_issues(spark):
    schema = "s string, f string, e string, y int"
    rules = {"splits": ("dev", "train"), "split_col": "s", "id_col": "f", "entity_col": "e", "target_col": "y"}
    run = lambda rows: {(r.check, r.code): r["count"] for r in validation.subset_issues(spark.createDataFrame(rows, schema), **rules).collect()}
    good = [("train", "a", "e1", 0), ("train", "b", "e1", 1), ("dev", "c", "e2", 1), ("dev", "d", "e2", 0)]
    assert run(good) == {}
    assert run(good[:3]) == {("subset", "not_balanced"): 1}
    assert run(good + [("dev", "a", "e1", 0), ("dev", "c", None, 1)]) == {
        ("subset", "duplicate_id"): 1, ("subset:dev/train", "id_in_splits"): 1, ("subset:dev/train", "entity_in_splits"): 1}
    assert run([]) == {("subset", "not_balanced"): 2}


def test_gaps_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(windows, "BUCKET_ROWS", 9)
    rng = random.Random(11)
    rows = []
    for g in ("a", "b", None):
        at = 0
        for i in range(rng.randrange(60, 120)):
            n = rng.randrange(1, 9)
            if rng.random() < 0.9:
                rows.append((g, i, at + (rng.random() < 0.1), n))
            at += n
    want, last = set(), {}
    for g, i, at, n in rows:  # in order of the index within each group
        index, offset = last.get(g, (-1, 0))
        if (i, at) != (index + 1, offset):
            want.add((g, i, index + 1, offset))
        last[g] = (i, at + n)
    rng.shuffle(rows)
    found = windows.sequence_gaps(spark.createDataFrame(rows, "g string, i long, o long, n long"), ["g"], "i", "o", "n")
    assert {(r.g, r.i, r.expected_index, r.expected_offset) for r in found.collect()} == want and len(want) > 20
    assert found.columns == ["g", "i", "o", "n", "expected_index", "expected_offset"]


def test_splits_follow_the_order_of_keys(spark, monkeypatch):
    monkeypatch.setattr(windows, "BUCKET_ROWS", 5)
    rows = [(f"e{i}", "s" if i % 3 else None) for i in range(200)]
    out = sampling.split_entities(spark.createDataFrame(rows, "entity string, stratum string"), 7)
    got = {(r.stratum, r.entity): r.split for r in out.collect()}
    for stratum in ("s", None):
        parts = ["7", *([stratum] if stratum else [])]
        names = sorted((e for e, s in rows if s == stratum), key=lambda e: hashlib.sha256("\0".join([*parts, e]).encode()).hexdigest())
        sizes = sampling.allocate_counts(len(names))
        want = [split for split, n in sizes.items() for _ in range(n)]
        assert [got[stratum, e] for e in names] == want


def test_summaries_by_grouping_sets(spark, monkeypatch):
    monkeypatch.setattr(windows, "BUCKET_ROWS", 7)
    rng = random.Random(5)
    rows = [(rng.choice("xy"), rng.choice(["u", "v", None]), rng.choice([None, float(rng.randrange(30))]), rng.random(), rng.random() < 0.3) for _ in range(200)]
    df = spark.createDataFrame([*rows, ("z", "u", None, 0.5, False)], "p string, k string, m double, w double, f boolean")
    out = stats.numeric_summaries(df, ["m", "w"], ["f"], [["p"], ["p", "k"]]).collect()
    rows.append(("z", "u", None, 0.5, False))
    assert len(out) == len({r[0] for r in rows}) + len({r[:2] for r in rows})
    for r in out:
        held = [x for x in rows if x[0] == r.p and (r.grouping == 1 or x[1] == r.k)]
        assert r.grouping in (0, 1) and r.rows == len(held) and r.f_count == sum(x[4] for x in held)
        for name, at in (("m", 2), ("w", 3)):
            xs = [x[at] for x in held if x[at] is not None]
            got = [r[f"{name}_{s}"] for s in ("min", "median", "mean", "p95", "max")]
            assert got == (pytest.approx([min(xs), np.median(xs), np.mean(xs), np.quantile(xs, 0.95), max(xs)]) if xs else [None] * 5)
