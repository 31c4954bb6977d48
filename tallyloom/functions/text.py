"""Text and path rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space.
_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip(text: Column) -> Column:
    """Without Unicode white space at either end; Spark's ``trim`` knows only the blank."""
    return F.regexp_replace(text, rf"\A{_SPACE}+|{_SPACE}+\z", "")


def cleaned(text: Column) -> Column:
    """Stripped text with null as the empty text: the two mean the same in tables of text."""
    return F.coalesce(strip(text.cast("string")), F.lit(""))


def full_match(text: Column, pattern: str) -> Column:
    """Whether the whole text matches; ``$`` would also match before a final line end."""
    return text.rlike(rf"\A(?:{pattern})\z")


def first_part(path: Column) -> Column:
    """First part of a path with either slash; ``./`` is skipped, an absolute path starts with ``/``."""
    plain = F.regexp_replace(F.translate(path, "\\", "/"), r"\A(\./+)+", "")
    return F.regexp_extract(plain, r"\A(/|[^/]+)", 1)


def trailing_number(stem: Column, digits: int = 5) -> Column:
    """The digits at the end of a stem; empty without them."""
    return F.regexp_extract(stem, rf"([0-9]{{{digits}}})\z", 1)


def is_bare_name(name: Column) -> Column:
    """Whether a file name has no folder part and isn't a folder reference."""
    return ~name.rlike(r"[/\\]") & ~name.isin("", ".", "..")


def shard_of_row(row: Column, first_shards: int, first_rows: int, rest_shards: int, rest_rows: int) -> Column:
    """Shard of a row position where the first shards hold ``first_rows`` each and the rest ``rest_rows``; null outside."""
    head, total = first_shards * first_rows, first_shards * first_rows + rest_shards * rest_rows
    row = row.cast("long")
    inside = F.when(row < head, F.floor(row / F.lit(first_rows))).otherwise(first_shards + F.floor((row - head) / F.lit(rest_rows)))
    return F.when((row >= 0) & (row < total), inside.cast("long"))


def shard_name(index: Column, total: int, stem: str = "train") -> Column:
    """``stem-00003-of-00432.parquet``."""
    return F.concat(F.lit(f"{stem}-"), F.lpad(index.cast("string"), 5, "0"), F.lit(f"-of-{total:05d}.parquet"))


def shard_index(name: Column) -> Column:
    """The index in a shard name; null if the name has another form."""
    found = F.regexp_extract(name, r"-([0-9]{5})-of-[0-9]{5}\.parquet\z", 1)
    return F.when(found != "", found.cast("int"))
