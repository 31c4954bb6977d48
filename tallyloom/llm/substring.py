"""Substring deduplication over sliding sentence spans.

A text is cut into sentences; a clause that a comma, colon or semicolon ends is a sentence of its own here, so that a passage
that begins or ends inside a long sentence loses a clause at most.  Every run of several consecutive sentences is
hashed: from each sentence on, and up to each sentence, the shortest run of at least ``RUN`` sentences and ``MIN_WORDS``
words, so that every longer stretch of whole sentences is covered by runs inside it.  Of the documents that hold a
run, the one with the smallest id holds its first occurrence (within a document, the leftmost); the sentences
of every other occurrence are removed.

Only hashes and ids travel: one narrow pass emits them to a written table, a map-side
combined minimum finds runs held more than once, a join marks their later occurrences, and one join by
document brings the marked hashes back to the text, whose runs are hashed again.  A passage shared by a third
of all documents is one key of the join, which the adaptive skew join splits; nothing gathers its occurrences
in one task.  Hashes have 96 bits: among 10^12 runs, some 10^-5 collisions are to be expected.

A sentence ends after one or more of ``. ! ? , ; :`` (closing quotes and brackets after them included) before white
space, or at a line end; white space after it belongs to it.  Runs are compared word by word, A-Z in lower case, so
spacing doesn't matter; words are what ASCII white space parts.

Defined results: null texts stay null, texts without sentences stay as they are, a text of which every
sentence is covered becomes empty; the row stays.  Rows that share an id count as one document: equal ones are
all treated alike.  A null id comes after all others.  An empty table gives an empty result.  ``trimmed`` keeps
all columns of the input; own columns start with ``__``.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import materialize, values

RUN = 2
MIN_WORDS = 25
_END = re.compile("[.!?,;:]+[\"'\u201d\u2019\u00bb)\\]]*[ \t\n\x0b\x0c\r]+|\n[ \t\n\x0b\x0c\r]*")
_LAST = (1 << 63) - 1


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences; together they are the whole text."""
    cuts = [m.end() for m in _END.finditer(text)]
    if not cuts or cuts[-1] < len(text):
        cuts.append(len(text))
    return list(zip([0, *cuts], cuts))


def _words(part: str) -> list[bytes]:
    return part.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only


def runs(text: str) -> list[tuple[int, int, int, int]]:
    """``(first, end, h1, h2)`` of every run, by place; numbers count the sentences with a word."""
    held = [w for a, b in sentences(text) if (w := _words(text[a:b]))]
    upto = [0, *accumulate(map(len, held))]
    n, found = len(held), set()
    for start in range(n):  # the shortest run from each sentence on
        end = max(bisect_left(upto, upto[start] + MIN_WORDS), start + RUN)
        if end > n:
            break
        found.add((start, end))
    for end in range(n, 0, -1):  # and the shortest up to each sentence
        start = min(bisect_right(upto, upto[end] - MIN_WORDS) - 1, end - RUN)
        if start < 0:
            break
        found.add((start, end))
    plain = [b" ".join(w) for w in held]
    return [(a, b, *_hash(b" ".join(plain[a:b]))) for a, b in sorted(found)]


def _hash(run: bytes) -> tuple[int, int]:
    """64 and 32 bits of one 128-bit hash, the first as a signed long."""
    h = xxhash.xxh3_128_intdigest(run)
    return (h & (1 << 64) - 1) - (1 << 63), h >> 97


def without(text: str, later: set[int]) -> tuple[str, int]:
    """The text without its runs of ``later`` hashes and its own repeats, and how many runs went."""
    spans = sentences(text)
    held = [i for i, (a, b) in enumerate(spans) if _words(text[a:b])]
    drop: set[int] = set()
    seen: set[int] = set()
    gone = 0
    for a, b, h, _ in runs(text):
        if h in later or h in seen:
            drop.update(held[a:b])
            gone += 1
        seen.add(h)
    return "".join(text[a:b] for i, (a, b) in enumerate(spans) if i not in drop) if drop else text, gone


_COLUMNS = {"id": pa.int64(), "h1": pa.int64(), "h2": pa.int32(), "again": pa.bool_()}
_ROWS = 20_000  # rows that a task holds before it passes them on


def _emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []

    def passed() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * len(_COLUMNS)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _COLUMNS.values())], list(_COLUMNS))

    for batch in batches:
        for key, text in values(batch.column(0), batch.column(1)):
            seen: set[int] = set()
            for _, _, h1, h2 in runs(text or ""):
                out.append((key, h1, h2, h1 in seen))
                seen.add(h1)
            if len(out) >= _ROWS:
                yield passed()
    yield passed()


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, h1, h2, again)``: a row per run; ``again`` if the run stood in the text before."""
    keyed = docs.select(_order(F.col(id_col)).alias("id"), F.col(text_col).cast("string").alias("text"))
    return keyed.mapInArrow(_emitted, "id long, h1 long, h2 int, again boolean")


def _order(key: Column) -> Column:
    return F.coalesce(key.cast("long"), F.lit(_LAST))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, later array<long>)`` of documents that repeat a run: hashes whose first document is another one."""
    every = materialize(spans(docs, id_col, text_col), "spans")  # read twice
    repeated = every.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # a written table: with the aggregate in the join's own stage, a hash of very many documents could not be split
    repeated = materialize(repeated, "runs")
    later = every.join(repeated, ["h1", "h2"]).where("id <> first OR again")
    return later.groupBy("id").agg(F.collect_set(F.when(F.col("id") != F.col("first"), F.col("h1"))).alias("later"))


def _trimmed(texts: pa.Array, later: pa.Array) -> pa.Array:
    rows = [(None, 0) if t is None else without(t, set(x)) for t, x in values(texts, later)]
    return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], ["text", "gone"])


def trimmed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the sentences of repeated runs removed from the text, and ``__removed_runs``.

    The join by document is a merge join at every size: the repeats grow with the corpus.
    """
    found = materialize(repeated_runs(docs, id_col, text_col), "repeats")
    found = found.select(F.col("id").alias("__id"), F.col("later").alias("__later")).hint("merge")
    joined = docs.withColumn("__key", _order(F.col(id_col))).join(found, F.col("__key") == F.col("__id"), "left")
    udf = F.arrow_udf(_trimmed, "struct<text:string,gone:int>").asNondeterministic()
    # texts of documents without a repeat go round Python as nulls
    done = joined.withColumn("__done", udf(F.when(F.col("__later").isNotNull(), F.col(text_col).cast("string")), F.coalesce("__later", F.array().cast("array<long>"))))
    text = F.when(F.col("__later").isNull(), F.col(text_col)).otherwise(F.col("__done.text"))
    return done.withColumns({text_col: text, "__removed_runs": F.col("__done.gone")}).select(*docs.columns, "__removed_runs")
