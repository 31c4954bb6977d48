"""Composed audits on small tables."""

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import audits

SCHEMA = "id string, e string, k string, samples array<double>, rate long, split string"


def rows(spark):
    return spark.createDataFrame([
        ("e1/a", "e1", "neg", [0.1, -0.2], 16000, "train"), ("e1/b", "e1", "pos", [0.1, -0.2], 16000, "dev"), ("e2/c", "e2", "pos", [0.5], 8000, "train"),
        ("e2/d", "e2", "pos", [0.5], 16000, "train"), ("e3/e", "e3", "neg", [], 16000, "train"), ("e3/f", "e3", "neg", None, 0, "train"),
    ], SCHEMA)


def codes(df):
    return {r.code: r["count"] for r in df.collect()}


def test_metadata_audit(spark):
    found = audits.metadata_audit(rows(spark), id_col="id", entity_col="e", category_col="k", categories=("neg", "pos"), patterns={"neg": "(e[0-9])/[a-e]"})
    assert codes(found) == {"pattern_mismatch": 1}


def test_samples_audit(spark):
    meta = rows(spark).where("id <> 'e2/d'").withColumn("k", F.when(F.col("id") == "e1/a", "pos").otherwise(F.col("k")))
    found = audits.samples_audit(rows(spark), meta, id_col="id", samples_col="samples", rate_col="rate", compare=["k"])
    assert codes(found) == {"null_samples": 1, "empty_samples": 1, "bad_rate": 1, "missing_metadata": 1, "metadata_mismatch": 1}


def test_duplicate_audit_tells_rates_apart(spark):
    run = lambda strict: audits.duplicate_audit(rows(spark), id_col="id", samples_col="samples", rate_col="rate", crossing=["split", "k"], strict=strict).collect()
    for found in (run(False), run(True)):
        assert len(found) == 1 and found[0].examples == ["e1/a", "e1/b"] and found[0].crosses_split and found[0].crosses_k


def test_levels_and_amplitude(spark):
    df = rows(spark).where("size(samples) > 0")
    assert audits.sampled_levels(df, id_col="id", category_col="k", samples_col="samples", rate_col="rate", per_category=1, seed=1).count() == 2
    out = {(r.policy, r.k): r for r in audits.amplitude_audit(df, samples_col="samples", dimensions=["k", "split"]).where("split IS NULL").collect()}
    assert out["peak", None].output_peak_min == pytest.approx(0.95) and out["none", None].rows == 4 and out["peak", "neg"].rows == 1


def test_parity_and_repeated_reads(spark):
    a = rows(spark)
    r = audits.parity(a, a.where("id <> 'e2/c'").withColumn("k", F.when(F.col("id") == "e1/b", "x").otherwise(F.col("k"))), id_col="id", compare=["k"], samples_col="samples").first()
    assert (r.ids, r.common, r.metadata_mismatches) == (6, 5, 1)
    assert audits.reproducible(a, a.orderBy(F.desc("id")), ["id", "k"]).first().same
    assert not audits.reproducible(a, a.where("id <> 'e1/a'"), ["id", "k"]).first().same


def test_chunk_issues(spark):
    index = spark.createDataFrame([("s0", "a", 0, "neg"), ("s0", "b", 0, "pos"), ("s1", "c", 1, "pos")], "shard string, file string, binary_label int, utt_type string")
    marker = spark.createDataFrame([("s0", 3), ("s2", 1)], "shard string, rows long")
    assert codes(audits.chunk_issues(index, marker, negative="neg")) == {"row_count": 1, "no_marker": 1, "no_rows": 1, "label_mismatch": 1}


def test_workloads(spark):
    df = spark.range(40).select(F.col("id"), (F.col("id") % 8).alias("shard"))
    out = audits.workloads(df, 2026, 5, id_col="id", shard_col="shard").collect()
    by = {w: [r for r in out if r.workload == w] for w in ("same_shard", "dispersed", "shuffled")}
    assert all([r.position for r in sorted(v, key=lambda r: r.position)] == list(range(5)) for v in by.values())
    assert len({r.shard for r in by["same_shard"]}) == 1 and len({r.shard for r in by["dispersed"]}) == 5
