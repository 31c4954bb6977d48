"""Stable sort keys: SHA-256 of a seed and identifiers, so an order depends on neither input nor engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(*parts, sep: str) -> Column:
    texts = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.sha2(F.concat_ws(sep, *texts), 256)


def row_key(seed: int, row_id: Column) -> Column:
    """``sha256("seed|id")``."""
    return _digest(seed, row_id, sep="|")


def entity_key(seed: int, stratum, entity: Column) -> Column:
    """``sha256("seed\\0stratum\\0entity")``; order ties by the entity."""
    return _digest(seed, stratum, entity, sep="\0")


def purpose_key(seed: int, split, purpose, row_id: Column) -> Column:
    """``sha256("seed\\0split\\0purpose\\0id")``."""
    return _digest(seed, split, purpose, row_id, sep="\0")


def crop_seed(seed: int, epoch, index: Column) -> Column:
    """Unsigned 64-bit number from the first 8 bytes of ``sha256("seed:epoch:index")``, as a decimal(20,0).

    Keyed by the source index, so a subset keeps its crops.
    """
    return F.conv(F.substring(_digest(seed, epoch, index, sep=":"), 1, 16), 16, 10).cast("decimal(20,0)")
