"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are short, documents may be long, so the measure is containment: the share of an item's distinct
word shingles that a document holds.  Items are partitioned by size class (powers of two of their shingle
count).  A class of at most u shingles keeps the ``u - ceil(threshold * u) + 1`` least shingle hashes of each
item as its MinHash sketch: an item contained at the threshold misses fewer shingles than that, so one of
them is always in the document, and the search loses nothing.  Documents are searched whole; a document
with fewer shingles than the threshold asks of the smallest item is not searched at all.  Candidates are
verified by exact containment of the shingle strings.

Everything is DataFrame expressions.  Sketches go by broadcast only within a counted bound of rows and bytes, else by a
shuffled join; so do candidates and items.

Words are runs of letters and digits in lower case, so punctuation and spacing don't hide a copy.

Defined results: an item of fewer than ``SHINGLE`` words is one shingle, held by a document that has its words in a row;
null or empty texts, or those without a word, never match; repeated item rows are one item if their id and words agree
(rows with one id and other words are items of their own, with result rows of their own); repeated document rows are one
result row per id; null ids are matched like any other id; an empty table on either side gives an empty result; only
id and text are read, so extra columns can't clash.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import broadcast_if_small, materialize

SHINGLE = 5
THRESHOLD = 0.8
_WORD = r"[\p{L}\p{M}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-case words of a text."""
    return F.regexp_extract_all(F.lower(text.cast("string")), F.lit(_WORD), F.lit(0))


def shingles(w: Column, make, n: int = SHINGLE) -> Column:
    """``make`` of each run of n words; empty for shorter texts."""
    count = F.size(w) - F.lit(n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: make(F.slice(w, i, n))))


def _text(part: Column) -> Column:
    return F.array_join(part, " ")


def item_shingles(items: DataFrame, id_col: str = "item_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(item_id, item, width, gram, h, n, in_sketch)``: every distinct shingle of each item, its words, and whether its hash is in the sketch.

    ``item`` is a hash of id and words.
    """
    grams = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    width = F.least(F.size("w"), F.lit(SHINGLE))
    own = F.when(F.size("w") < SHINGLE, F.array(_text(F.col("w")))).otherwise(shingles(F.col("w"), _text))
    item = F.xxhash64(F.col("item_id").cast("string"), _text(F.col("w")))
    grams = grams.select("item_id", item.alias("item"), width.alias("width"), F.explode(own).alias("gram")).distinct()
    per = grams.select("*", F.xxhash64("gram").alias("h"))
    sized = per.groupBy("item").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("h")).alias("hs"))
    top = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n"))))
    kept = (top - F.ceil(F.lit(threshold) * top) + 1).cast("int")
    # the class's own sizes: an item with fewer shingles than the class's sketch keeps all of them
    bar = sized.select("item", "n", F.element_at("hs", F.least(kept, F.size("hs"))).alias("bar"))
    return per.join(bar, "item").select("item_id", "item", "width", "gram", "h", "n", (F.col("h") <= F.col("bar")).alias("in_sketch"))


def _probes(docs: DataFrame, widths: list[int], make, least: int = 1) -> DataFrame:
    """``(doc_id, g)``: ``make`` of every shingle of the documents, of each of the widths that items have.

    Words are a column of their own: inside the shingles' lambda they would be split again for each shingle.
    """
    parts = []
    for k in widths:
        long = docs.where(F.size("w") >= (least + SHINGLE - 1 if k == SHINGLE else k))
        parts.append(long.select("doc_id", F.explode(shingles(F.col("w"), make, k)).alias("g")))
    return functools.reduce(DataFrame.unionByName, parts)


def candidates(docs: DataFrame, sketch: DataFrame, widths: list[int], least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, item)`` for documents that hold a sketch hash of the item; ``sketch(item, h)``."""
    split = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    probes = _probes(split, widths, lambda part: F.xxhash64(_text(part)), least).withColumnRenamed("g", "h")
    return probes.join(sketch, "h").select("doc_id", "item").distinct()


def contamination(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
    text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``(doc_id, item_id, n_shingles, n_shared, containment)`` of every pair at the threshold or above."""
    grams = materialize(item_shingles(items, item_col, item_text, threshold), "items")
    widths = sorted(r[0] for r in grams.select("width").distinct().collect()) or [SHINGLE]  # five at most
    least = grams.where(F.col("width") == SHINGLE).agg(F.min(F.ceil(F.col("n") * threshold))).first()[0] or 1
    sketch = materialize(grams.where("in_sketch").select("item", "h"), "sketch")
    found = materialize(candidates(docs, broadcast_if_small(sketch), widths, int(least), id_col, text_col), "candidates")
    # exact verification, over the whole texts of candidate documents only
    ids = broadcast_if_small(materialize(found.select(F.col("doc_id").alias("c")).distinct(), "ids"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(ids, texts["doc_id"].eqNullSafe(ids["c"]), "left_semi").select("doc_id", words(F.col("text")).alias("w"))
    held = _probes(texts, widths, _text).withColumnRenamed("g", "gram")
    # a pair with a shared shingle outside the candidates is below the threshold anyway
    side = materialize(grams.select("item", "gram", "n"), "grams")
    shared = held.join(broadcast_if_small(side), "gram").distinct()
    counted = shared.groupBy("doc_id", "item", "n").agg(F.count("*").alias("n_shared"))
    exact = counted.where(F.col("n_shared") >= F.lit(threshold) * F.col("n")).alias("x")
    both = F.col("x.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("x.item") == F.col("f.item"))
    names = materialize(grams.select("item", "item_id").distinct(), "names")
    return exact.join(found.alias("f"), both, "left_semi").join(broadcast_if_small(names), "item").select(
        "doc_id", "item_id", F.col("n").alias("n_shingles"), "n_shared", (F.col("n_shared") / F.col("n")).alias("containment")
    )


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns."""
    hit = contamination(docs, items, threshold, id_col, text_col).select(F.col("doc_id").alias("__hit")).distinct()
    hit = broadcast_if_small(materialize(hit, "hits"))
    return docs.join(hit, docs[id_col].eqNullSafe(hit["__hit"]), "left_anti")
