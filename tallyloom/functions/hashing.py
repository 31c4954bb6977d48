"""Content identity of sample arrays, by bytes: -0.0 differs from 0.0 and the rate counts."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _slices(a: pa.ListArray) -> list[np.ndarray | None]:
    values, offsets = a.values.to_numpy(zero_copy_only=False), a.offsets.to_numpy()
    valid = a.is_valid().to_pylist()
    return [values[s:e] if ok else None for s, e, ok in zip(offsets[:-1], offsets[1:], valid)]


def content_hash(a: Column, rate: Column) -> Column:
    """Hex SHA-256 of the rate (little-endian long) and the samples (little-endian doubles); null for null arrays."""
    def run(arrays: pa.Array, rates: pa.Array) -> pa.Array:
        out = []
        for x, r in zip(_slices(arrays), rates.to_pylist()):
            out.append(None if x is None or r is None else hashlib.sha256(struct.pack("<q", r) + x.astype("<f8").tobytes()).hexdigest())
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(a.cast("array<double>"), rate.cast("long"))


def prepared_hash(a: Column) -> Column:
    """Hex SHA-256 of the samples as little-endian floats."""
    def run(arrays: pa.Array) -> pa.Array:
        return pa.array([None if x is None else hashlib.sha256(x.astype("<f4").tobytes()).hexdigest() for x in _slices(arrays)], pa.string())

    return F.arrow_udf(run, "string")(a.cast("array<float>"))


def set_digest(row_id: Column) -> Column:
    """Aggregate: SHA-256 of all ids, sorted and joined by line ends.

    The ids of a group are gathered, so use it for selections of bounded size; ``additive_digest`` has no bound.
    """
    return F.sha2(F.array_join(F.array_sort(F.collect_list(row_id.cast("string"))), "\n"), 256)


def additive_digest(*columns: Column) -> Column:
    """Aggregate: order-free identity of any number of rows, as count and two sums of 64-bit hashes."""
    first = F.xxhash64(*columns).cast("decimal(38,0)")
    second = F.xxhash64(F.lit("b"), *columns).cast("decimal(38,0)")
    return F.struct(F.count(F.lit(1)).alias("n"), F.sum(first).alias("a"), F.sum(second).alias("b"))


def selection_digest(row_id: Column) -> Column:
    """Aggregate: text that names a selection of any size, in any order: its number of ids and the sums of two 60-bit
    pieces of their SHA-256, joined by ``-``; nothing is gathered."""
    h = F.sha2(row_id.cast("string"), 256)
    part = lambda at: F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)"))
    return F.concat_ws("-", F.count(row_id).cast("string"), part(1).cast("string"), part(16).cast("string"))
