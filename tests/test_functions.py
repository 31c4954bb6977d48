"""Array, signal, hash and text functions on small cases."""

import hashlib
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import arrays, keys, text
from tallyloom.functions.hashing import content_hash, prepared_hash
from tallyloom.functions.signal import lfcc_array, resample_array


def one(spark, values, expr, rate=4, kind="array<double>"):
    return spark.createDataFrame([(values, rate)], f"a {kind}, rate long").select(expr.alias("x")).first().x


def test_waveform_summary(spark):
    s = one(spark, [0.0, 0.5, -0.5, 1.0], arrays.waveform_summary(F.col("a"), F.col("rate")))
    assert (s.samples, s.duration_seconds, s.peak_absolute, s.clipped_fraction, s.silent) == (4, 1.0, 1.0, 0.25, False)
    assert s.rms == pytest.approx(math.sqrt(1.5 / 4))
    s = one(spark, [0.1, float("nan"), float("inf")], arrays.waveform_summary(F.col("a"), F.col("rate")))
    assert (s.finite_samples, s.nonfinite_samples) == (1, 2)
    s = one(spark, [], arrays.waveform_summary(F.col("a"), F.col("rate")))
    assert s.silent and s.rms is None


def gain(spark, values, policy):
    peak, _, db = arrays.measure(F.col("a"))
    g = one(spark, values, arrays.policy_gain(F.lit(policy), peak, db))
    out = one(spark, values, F.array_max(F.transform(arrays.scaled(F.col("a"), F.lit(g.applied_gain)), F.abs)))
    return g, out


@pytest.mark.parametrize("seed", range(4))
def test_gain_policies(spark, seed):
    """Random arrays, loud, quiet and spiked, against the rules in plain floats."""
    rng = np.random.default_rng(seed)
    a = rng.normal(size=200) * (0.002, 0.03, 0.4, 0.02)[seed]
    if seed == 3:
        a[50] = 0.9
    a = a.astype(np.float32).astype(float).clip(-1, 1)
    peak, db = np.abs(a).max(), 20 * math.log10(math.sqrt((a**2).mean()))
    for policy in ("none", "peak", "rms_dbfs"):
        g, out = gain(spark, a.tolist(), policy)
        quiet = db < -50
        want = 1.0
        if policy == "peak" and not quiet:
            want = 0.95 / peak
        if policy == "rms_dbfs" and not quiet:
            want = min(10 ** ((-25 - db) / 20), 0.95 / peak)
        assert g.near_silence == quiet and g.applied_gain == pytest.approx(want, rel=1e-5) and out == pytest.approx(peak * want, rel=1e-4)


def test_fixed_length(spark):
    cut = lambda n, length: one(spark, [float(i) for i in range(n)], arrays.fixed_length(F.col("a"), length))
    assert cut(7, 3) == [2.0, 3.0, 4.0] and cut(3, 7) == [0.0, 1.0, 2.0, 0.0, 1.0, 2.0, 0.0] and cut(3, 3) == [0.0, 1.0, 2.0] and cut(0, 3) is None


def test_content_hash_is_by_bytes(spark):
    want = hashlib.sha256(struct.pack("<q", 16000) + np.array([0.1, -0.2, 0.3]).tobytes()).hexdigest()
    h = lambda v, r: one(spark, v, content_hash(F.col("a"), F.col("rate")), r)
    assert h([0.1, -0.2, 0.3], 16000) == want
    assert h([0.0], 1) != h([-0.0], 1) and h([0.1], 1) != h([0.1], 2) and h(None, 1) is None
    assert one(spark, [0.5], prepared_hash(F.col("a"))) == hashlib.sha256(np.array([0.5], "<f4").tobytes()).hexdigest()


def test_crop_seed(spark):
    got = spark.range(3).select(keys.crop_seed(7, 2, F.col("id")).alias("s")).collect()
    assert [int(r.s) for r in got] == [int.from_bytes(hashlib.sha256(f"7:2:{i}".encode()).digest()[:8], "big") for i in range(3)]


def test_paths_and_names(spark):
    rows = [("a/b.wav",), ("./a\\b.wav",), ("/a/b",), ("a",), ("",)]
    got = spark.createDataFrame(rows, "p string").select(text.first_part(F.col("p")).alias("f")).collect()
    assert [r.f for r in got] == ["a", "a", "/", "a", ""]
    r = spark.createDataFrame([("ab\n", "x/y", " 　t\x85")], "a string, b string, c string").select(
        text.full_match(F.col("a"), "ab").alias("m"), text.is_bare_name(F.col("b")).alias("n"), text.strip(F.col("c")).alias("s")).first()
    assert (r.m, r.n, r.s) == (False, False, "t")
    shards = spark.range(-1, 12).select(text.shard_of_row(F.col("id"), 2, 3, 2, 2).alias("s")).collect()
    assert [r.s for r in shards] == [None, 0, 0, 0, 1, 1, 1, 2, 2, 3, 3, None, None]


def test_resampling_keeps_a_tone():
    t = np.arange(24000) / 24000
    y = resample_array(np.sin(2 * math.pi * 440 * t), 24000, 16000)
    want = np.sin(2 * math.pi * 440 * np.arange(16000) / 16000)
    assert len(y) == 16000 and np.abs(y - want)[100:-100].max() < 0.01
    assert len(resample_array(np.zeros(40), 40000, 16000)) == 16


def test_lfcc_shape_and_row_independence():
    x = np.random.default_rng(0).normal(size=64000).astype(np.float32)
    assert lfcc_array(x).shape == (60, 401)


def test_pooling_and_normalisation(spark):
    frames = [[1.0, 2.0], [3.0, 6.0]]
    p = spark.createDataFrame([(frames,)], "f array<array<double>>").select(arrays.mean_std_pool(F.col("f")).alias("p")).first().p
    assert p == pytest.approx([2, 4, 1, 2], abs=1e-6)
    z = one(spark, [1.0, 2.0, 3.0, 4.0], arrays.normalised(F.col("a")))
    assert np.mean(z) == pytest.approx(0, abs=1e-9) and np.std(z) == pytest.approx(1, abs=1e-6)
