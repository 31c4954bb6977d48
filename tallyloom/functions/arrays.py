"""Expressions over sample arrays.  All stay inside the JVM; nulls in, nulls out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-8
SILENT_RMS = 1e-4
CLIP = 0.999


def _sum(a: Column, value=lambda x: x) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + value(x.cast("double")))


def _finite(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def waveform_summary(a: Column, rate: Column) -> Column:
    """Struct of counts, duration and level statistics; the statistics are over finite samples.

    ``silent`` is true if the RMS is below 1e-4 or no sample is finite.
    """
    f = F.transform(_finite(a), lambda x: x.cast("double"))
    n, some = F.size(f), F.size(f) > 0
    rms = F.when(some, F.sqrt(_sum(f, lambda x: x * x) / n))
    stat = lambda c: F.when(some, c)
    return F.struct(
        F.size(a).cast("long").alias("samples"), F.when(rate > 0, F.size(a) / rate).alias("duration_seconds"),
        n.cast("long").alias("finite_samples"), (F.size(a) - n).cast("long").alias("nonfinite_samples"),
        stat(F.array_min(f)).alias("minimum"), stat(F.array_max(f)).alias("maximum"),
        stat(F.array_max(F.transform(f, F.abs))).alias("peak_absolute"), rms.alias("rms"),
        stat(_sum(f) / n).alias("dc_offset"), stat(F.size(F.filter(f, lambda x: F.abs(x) >= CLIP)) / n).alias("clipped_fraction"),
        (~some | (rms < SILENT_RMS)).alias("silent"),
    )


def measure(a: Column, epsilon: float = EPSILON) -> tuple[Column, Column, Column]:
    """Peak, RMS and RMS in dBFS of a sample array rounded to single precision first."""
    f = F.transform(a, lambda x: x.cast("float").cast("double"))
    rms = F.sqrt(_sum(f, lambda x: x * x) / F.size(f))
    return F.array_max(F.transform(f, F.abs)), rms, 20.0 * F.log10(F.greatest(rms, F.lit(epsilon)))


def policy_gain(
    policy: Column, peak: Column, rms_dbfs: Column, *, peak_target: float = 0.95, rms_target_dbfs: float = -25.0,
    minimum_input_rms_dbfs: float = -50.0, epsilon: float = EPSILON,
) -> Column:
    """Struct of ``applied_gain``, ``near_silence``, ``peak_limited`` for ``none``, ``peak`` or ``rms_dbfs``.

    Near silence stays untouched; an RMS gain never lifts the peak over its target, so nothing clips.
    """
    quiet = rms_dbfs < minimum_input_rms_dbfs
    active = ~quiet & (peak > epsilon)
    safe = F.lit(peak_target) / peak
    wanted = F.pow(F.lit(10.0), (F.lit(rms_target_dbfs) - rms_dbfs) / 20.0)
    limited = active & (policy == "rms_dbfs") & (wanted > safe)
    gain = (
        F.when(active & (policy == "peak"), safe).when(limited, safe).when(active & (policy == "rms_dbfs"), wanted).otherwise(F.lit(1.0))
    )
    return F.struct(gain.alias("applied_gain"), quiet.alias("near_silence"), limited.alias("peak_limited"))


def scaled(a: Column, gain: Column) -> Column:
    """Samples in single precision times a gain."""
    return F.transform(a, lambda x: (x.cast("float") * gain.cast("float")).cast("float"))


def fixed_length(a: Column, length: int, start: Column | None = None) -> Column:
    """Exactly ``length`` samples: the centre (or what begins at ``start``) of a longer array, a shorter one repeated.

    An empty array has no segment (null).
    """
    n = F.size(a)
    start = F.floor((n - length) / 2).cast("int") if start is None else start.cast("int")
    repeated = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.get(a, i % n))
    return F.when(n == 0, F.lit(None)).when(n > length, F.slice(a, F.greatest(start, F.lit(0)) + 1, length)).otherwise(repeated)


def crop_start(seed: Column, n: Column, length: int) -> Column:
    """Start of a seeded crop, ``seed mod (n - length + 1)``: own definition, the same on every engine."""
    room = F.greatest(n - length + 1, F.lit(1)).cast("decimal(20,0)")
    return (seed % room).cast("long")


def normalised(a: Column, epsilon: float = 1e-7) -> Column:
    """Zero mean and unit population variance."""
    mean = _sum(a) / F.size(a)
    scale = F.sqrt(_sum(a, lambda x: x * x) / F.size(a) - mean * mean + epsilon)
    return F.transform(a, lambda x: (x.cast("double") - mean) / scale)


def mean_std_pool(frames: Column, epsilon: float = 1e-8) -> Column:
    """Per-dimension means, then population deviations, of an array of equally long arrays."""
    n, width = F.size(frames), F.size(F.get(frames, F.lit(0)))
    dims = F.sequence(F.lit(0), width - 1)
    mean = lambda d: F.aggregate(frames, F.lit(0.0), lambda acc, f: acc + F.get(f, d)) / n
    square = lambda d: F.aggregate(frames, F.lit(0.0), lambda acc, f: acc + (F.get(f, d) - mean(d)) * (F.get(f, d) - mean(d))) / n
    return F.concat(F.transform(dims, mean), F.transform(dims, lambda d: F.sqrt(square(d) + epsilon)))


def window_starts(n: Column, length: int, hop: int) -> Column:
    """Starts of windows of ``length`` every ``hop`` samples, and of a last one that ends with the array."""
    last = F.greatest(n - length, F.lit(0))
    return F.array_sort(F.array_union(F.sequence(F.lit(0), last, F.lit(hop)), F.array(last)))


def max_abs_difference(a: Column, b: Column) -> Column:
    """Largest absolute difference of two arrays; null if they differ in length."""
    return F.when(F.size(a) == F.size(b), F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))))


def sigmoid(logit: Column) -> Column:
    """Score of a logit."""
    return 1.0 / (1.0 + F.exp(-logit))
