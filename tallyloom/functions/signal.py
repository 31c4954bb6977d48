"""Signal kernels that need Fourier transforms or long filters: Arrow UDFs over NumPy, one row at a time."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.hashing import _slices


@functools.cache
def _kernel(rate: int, target: int, width: int, rolloff: float) -> tuple[np.ndarray, int, int, int]:
    """Hann-windowed sinc filters, one for each output phase."""
    g = math.gcd(rate, target)
    old, new = rate // g, target // g
    cutoff = min(old, new) * rolloff
    reach = math.ceil(width * old / cutoff)
    position = np.arange(-reach, reach + old) / old
    t = np.clip((position[None, :] - np.arange(new)[:, None] / new) * cutoff, -width, width)
    return np.sinc(t) * np.cos(t * math.pi / width / 2) ** 2 * cutoff / old, old, new, reach


def resample_array(x: np.ndarray, rate: int, target: int, width: int = 6, rolloff: float = 0.99) -> np.ndarray:
    """Band-limited interpolation to another rate; equal rates leave the samples as they are."""
    if rate == target or not len(x):
        return x.astype(np.float32)
    taps, old, new, reach = _kernel(rate, target, width, rolloff)
    padded = np.concatenate([np.zeros(reach), x, np.zeros(reach + old)])
    frames = np.lib.stride_tricks.sliding_window_view(padded, taps.shape[1])[::old]
    return (frames @ taps.T).reshape(-1)[: math.ceil(new * len(x) / old)].astype(np.float32)


def resampled(a: Column, rate: Column, target: int = 16_000) -> Column:
    """``array<float>`` at the target rate."""
    def run(arrays: pa.Array, rates: pa.Array) -> pa.Array:
        return pa.array([None if x is None or r is None else resample_array(x, r, target) for x, r in zip(_slices(arrays), rates.to_pylist())], pa.list_(pa.float32()))

    return F.arrow_udf(run, "array<float>")(a.cast("array<double>"), rate.cast("long"))


def lfcc_array(
    x: np.ndarray, rate: int = 16_000, *, n_fft: int = 512, win: int = 400, hop: int = 160, filters: int = 80,
    coefficients: int = 60, top_db: float = 80.0,
) -> np.ndarray:
    """Linear-frequency cepstral coefficients, (coefficients, frames); the dB floor is each row's own."""
    window = np.zeros(n_fft)
    start = (n_fft - win) // 2
    window[start : start + win] = np.hanning(win + 1)[:-1]
    padded = np.pad(x.astype(np.float64), n_fft // 2, mode="reflect" if len(x) > n_fft // 2 else "constant")
    frames = np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop] * window
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    centres = np.linspace(0, rate / 2, filters + 2)
    hz = np.linspace(0, rate / 2, n_fft // 2 + 1)
    rising = (hz[:, None] - centres[None, :-2]) / (centres[1:-1] - centres[:-2])
    falling = (centres[None, 2:] - hz[:, None]) / (centres[2:] - centres[1:-1])
    bands = power @ np.clip(np.minimum(rising, falling), 0, None)
    db = 10 * np.log10(np.maximum(bands, 1e-10))
    db = np.maximum(db, db.max() - top_db)
    n, k = np.arange(filters), np.arange(coefficients)
    dct = np.cos(math.pi / filters * (n[:, None] + 0.5) * k[None, :]) * math.sqrt(2 / filters)
    dct[:, 0] /= math.sqrt(2)
    return (db @ dct).T


def lfcc(a: Column, rate: int = 16_000) -> Column:
    """``array<array<double>>`` of coefficients by frame; null for null or empty arrays."""
    def run(arrays: pa.Array) -> pa.Array:
        return pa.array([None if x is None or not len(x) else [list(r) for r in lfcc_array(x, rate)] for x in _slices(arrays)], pa.list_(pa.list_(pa.float64())))

    return F.arrow_udf(run, "array<array<double>>")(a.cast("array<float>"))
