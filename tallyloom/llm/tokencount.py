"""Token counts attributed to fields or sections through offsets.

A whole document is encoded once.  The byte lengths of its tokens give their spans, the sections' character
spans are mapped to bytes, and an interval join (two binary searches per token) finds which sections a
token touches.  A token that crosses a boundary goes by an explicit rule:

``start``
    to the section that holds its first byte;
``majority``
    to the section that holds most of its bytes, the earlier one on a tie;
``split``
    to every section it touches, by share of bytes.

Bytes outside all sections count for section -1, so a document's counts always sum to its tokens.

Defined results: a null or empty text has no section and gives no row; repeated rows give their rows each;
sections must be in order and disjoint (a task fails otherwise), empty ones count 0; null sections mean
none; an empty table gives an empty result; only id, text and sections are read, so extra columns can't
clash.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import values

RULES = ("start", "majority", "split")
RULE = "majority"
_ROW = pa.struct([("section", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("n_tokens", pa.float64()), ("n_crossing", pa.int64())])


@functools.cache
def _encoding(path: str, pattern: str):
    """The byte-level encoder of a rank file and the byte length of each token, once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def token_ends(text: str, path: str, pattern: str) -> np.ndarray:
    """Byte offset at which each token of the text ends."""
    encoding, lengths = _encoding(path, pattern)
    return np.cumsum(lengths[np.asarray(encoding.encode_ordinary(text), np.int64)])


def line_sections(text: str) -> list[tuple[int, int]]:
    """Character spans of the lines; a line end belongs to its line."""
    cuts, at = [0], text.find("\n")
    while at >= 0:
        cuts.append(at + 1)
        at = text.find("\n", at + 1)
    if cuts[-1] < len(text):
        cuts.append(len(text))
    return list(zip(cuts, cuts[1:]))


def byte_offsets(text: str, at: np.ndarray) -> np.ndarray:
    """Byte offsets in UTF-8 of character offsets; those past the end mean the end."""
    at = np.clip(at, 0, len(text))
    if text.isascii():
        return at
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))[at]


def attribute(ends: np.ndarray, starts_at: np.ndarray, ends_at: np.ndarray, rule: str = RULE) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens of each section; one more entry at the end for what lies outside."""
    k = len(starts_at)
    if (ends_at < starts_at).any() or (starts_at[1:] < ends_at[:-1]).any():
        raise ValueError("sections must be in order and disjoint")
    filled = np.flatnonzero(ends_at > starts_at)
    s, e = starts_at[filled], ends_at[filled]
    count, crossing = np.zeros(k + 1), np.zeros(k + 1, np.int64)
    names = np.append(filled, k)
    a = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    first = np.searchsorted(e, a, "right")  # first section that ends after the token starts
    last = np.searchsorted(s, ends, "left") - 1  # last section that starts before it ends
    inside = (first == last) & (first < len(s))
    inside[inside] = (s[first[inside]] <= a[inside]) & (e[first[inside]] >= ends[inside])
    np.add.at(count, names[first[inside]], 1)
    outside = first > last
    count[k] += outside.sum()
    for t in np.flatnonzero(~inside & ~outside):
        touched = range(first[t], last[t] + 1)
        held = {int(names[i]): int(min(e[i], ends[t]) - max(s[i], a[t])) for i in touched}
        if (rest := int(ends[t] - a[t]) - sum(held.values())):
            held[k] = rest
        for i in held:
            crossing[i] += 1
        if rule == "split":
            for i, n in held.items():
                count[i] += n / (ends[t] - a[t])
        elif rule == "majority":
            count[min(held, key=lambda i: (-held[i], i))] += 1
        else:
            i = first[t]
            count[names[i] if s[i] <= a[t] else k] += 1
    return count, crossing


def _counts(text: str | None, sections: list | None, path: str, pattern: str, rule: str) -> list[dict]:
    if not text:
        return []
    spans = line_sections(text) if sections is None else [(s["start"], s["end"]) for s in sections]
    at = byte_offsets(text, np.array(spans, np.int64).reshape(-1, 2))
    count, crossing = attribute(token_ends(text, path, pattern), at[:, 0], at[:, 1], rule)
    rows = [{"section": i, "start": a, "end": b, "n_tokens": count[i], "n_crossing": int(crossing[i])} for i, (a, b) in enumerate(spans)]
    if count[-1]:
        rows.append({"section": -1, "start": None, "end": None, "n_tokens": count[-1], "n_crossing": int(crossing[-1])})
    return rows


def fields(*columns: str) -> tuple[Column, Column]:
    """Text and sections of a document made of several columns, one line each; nulls count as empty."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    spans, at = [], F.lit(0)
    for part in parts:
        spans.append(F.struct(at.alias("start"), (at + F.length(part)).alias("end")))
        at = at + F.length(part) + 1
    return F.concat_ws("\n", *parts), F.array(*spans)


def token_counts(
    docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text: str | Column = "text",
    sections: Column | None = None, rule: str = RULE,
) -> DataFrame:
    """``(id, section, start, end, n_tokens, n_crossing)``; sections are lines unless given as an array of spans."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    text = F.col(text) if isinstance(text, str) else text

    def lines(texts: pa.Array) -> pa.Array:
        return pa.array([_counts(t, None, path, pattern, rule) for (t,) in values(texts)], pa.list_(_ROW))

    def given(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([_counts(t, s or [], path, pattern, rule) for t, s in values(texts, spans)], pa.list_(_ROW))

    schema = "array<struct<section:int,start:int,end:int,n_tokens:double,n_crossing:bigint>>"
    if sections is None:
        counted = F.arrow_udf(lines, schema).asNondeterministic()(text.cast("string"))
    else:
        counted = F.arrow_udf(given, schema).asNondeterministic()(text.cast("string"), sections)
    return docs.select(F.col(id_col), counted.alias("c")).select(id_col, F.inline("c"))
