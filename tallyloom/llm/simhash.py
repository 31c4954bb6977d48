"""SimHash fingerprints linked by vantage-point trees.

A fingerprint has bit i if over half of the hashes of the text's word shingles have it.  Fingerprints
link at ``RADIUS`` or fewer differing bits, and documents in one connected component are near copies.

Fingerprints are partitioned by Hamming distance to vantage points.  A node of a tree has a vantage point and a
distance m: the inner branch takes all fingerprints within m plus the slack, the outer one all beyond m.  By the
triangle inequality two fingerprints within the slack of each other differ by no more than it in their distance
to the vantage point, so they meet in a branch at every node and in a leaf at the end; those near the boundary are
in both branches, that is, their query visits both.

Distances between whole fingerprints crowd around 32, so at a slack of 4 a tree prunes 0.4 of the pairs at each level and
copies a third of the rows.  Hence one tree for each of ``BLOCKS`` blocks of bits, with distances within its block: two
fingerprints within 4 bits differ by at most 4 // 3 = 1 bit in one of three blocks, and a slack of 1 copies a sixth of the
rows and prunes 0.4 too.  The work grows as n to the power 1.3 and no link is lost.

The upper nodes are fitted on a sample of ``SAMPLE`` fingerprints on the driver; every fingerprint is dealt through
them to its shards.  In its shard's task the tree goes on, down to ``LEAF`` fingerprints, which are compared with all
64 bits.  Where distances within the block no longer divide, whole distances do, and at last balls around single
fingerprints.  No candidate is capped.

Defined results: a null, empty or blank text has fingerprint zero, linked like any other; repeated rows
each come back; a null id takes part in links but never names a component unless its component has no
other id (then it is null); an empty table gives an empty result; only the id and the text are read, so
extra columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import components, materialize, values

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Blocks of bits, each with a tree of its own.
BLOCKS = 3
#: Fingerprints that the upper nodes are fitted on, at most (in expectation; 8 bytes each).
SAMPLE = 1 << 16
#: Fingerprints that a shard is to have; a task divides it further.
SHARD_ROWS = 2048
#: Below this many points a branch is compared directly.
LEAF = 256
_VANTAGES = 6  # vantage points tried at a node
_HASH = partial(xxhash.xxh64_intdigest, seed=SEED)
_WORDS = 1 << 16  # shingles hashed at a time, so that very long texts need bounded memory


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Unsigned hashes of a text's shingles, repeats included, some at a time; none without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
    if 0 < len(words) < shingle:
        yield np.array([_HASH(b" ".join(words))], np.uint64)
    for start in range(0, len(words) - shingle + 1, _WORDS):
        part = words[start : start + _WORDS + shingle - 1]
        grams = zip(*(part[k:] for k in range(shingle)))
        yield np.fromiter(map(_HASH, map(b" ".join, grams)), np.uint64)


def majority(parts: Iterable[np.ndarray]) -> int:
    """The bits that over half of the hashes have."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        n += len(hashes)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    return majority(shingle_hashes(text, shingle))


def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t) for (t,) in values(texts)], np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp long)``, the fingerprint's bits as a signed long."""
    udf = F.arrow_udf(_fingerprints, "long").asNondeterministic()
    return docs.select(F.col(id_col), udf(F.col(text_col).cast("string")).alias("fp"))


def masks(blocks: int = BLOCKS) -> list[np.uint64]:
    """Runs of bits of nearly equal width, which together are all 64."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [np.uint64((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:])]


def _distance(x: np.ndarray, v: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((x ^ v) & mask)


def division(x: np.ndarray, mask: np.uint64, slack: int) -> tuple[np.uint64, int] | None:
    """Vantage point and boundary that leave the least work in both branches; None if hardly any would go."""
    best = None
    for v in x[np.linspace(0, len(x) - 1, _VANTAGES).astype(int)]:
        have = np.bincount(_distance(x, v, mask), minlength=65).cumsum().astype(float)
        inner = np.append(have[slack:], np.full(slack, have[-1]))  # within m + slack, for each boundary m
        work = inner**2 + (have[-1] - have) ** 2
        m = int(np.argmin(work))
        if best is None or work[m] < best[0]:
            best = work[m], v, m
    return best[1:] if best and best[0] < 0.97 * len(x) ** 2 else None


def grow(sample: np.ndarray, mask: np.uint64, slack: int, leaf: float, names: Iterator[int]):
    """A tree over the sample: ``(vantage, boundary, inner, outer)``, or at its leaves their numbers."""
    cut = division(sample, mask, slack) if len(sample) > leaf else None
    if cut is None:
        return next(names)
    d = _distance(sample, cut[0], mask)
    return *cut, grow(sample[d <= cut[1] + slack], mask, slack, leaf, names), grow(sample[d > cut[1]], mask, slack, leaf, names)


def visited(x: np.ndarray, tree, mask: np.uint64, slack: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(leaf, fingerprints)`` of all leaves that the fingerprints reach."""
    stack = [(tree, x)]
    while stack:
        node, own = stack.pop()
        if not len(own):
            continue
        if isinstance(node, int):
            yield node, own
            continue
        v, m, inner, outer = node
        d = _distance(own, v, mask)
        stack += [(inner, own[d <= m + slack]), (outer, own[d > m])]


def tree_links(x: np.ndarray, mask: np.uint64 | None = None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Pairs of positions within the radius that connect all such pairs of distinct fingerprints.

    With a mask only pairs within ``radius // BLOCKS`` bits of the mask are sure to be found.
    """
    parent, found, whole = list(range(len(x))), [], np.uint64((1 << 64) - 1)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def union(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            found.append((i, j))

    levels = [(whole, radius)] if mask is None else [(mask, radius // BLOCKS), (whole, radius)]
    stack = [(np.arange(len(x)), 0)]
    while stack:
        s, level = stack.pop()
        if len(s) <= LEAF:
            y = x[s]
            for i, j in np.argwhere(np.triu(np.bitwise_count(y[:, None] ^ y[None, :]) <= radius, 1)):
                union(int(s[i]), int(s[j]))
            continue
        while level < len(levels) and (cut := division(x[s], *levels[level])) is None:
            level += 1
        if level < len(levels):
            d = _distance(x[s], cut[0], levels[level][0])
            stack += [(s[d <= cut[1] + levels[level][1]], level), (s[d > cut[1]], level)]
            continue
        # a ball: what lies in it is one component, and only points within twice the radius can link to it
        v, d = int(s[0]), _distance(x[s], x[s[0]], whole)
        near, rim, far = s[d <= radius], s[(d > radius) & (d <= 2 * radius)], s[d > radius]
        for i in near[1:]:
            union(int(i), v)
        for a in range(0, len(rim), LEAF):
            part = rim[a : a + LEAF]
            for b in range(0, len(near), 8 * LEAF):
                ball = near[b : b + 8 * LEAF]
                hit = np.bitwise_count(x[part][:, None] ^ x[ball][None, :]) <= radius
                for i in np.flatnonzero(hit.any(axis=1)):
                    union(int(part[i]), int(ball[hit[i].argmax()]))
        stack.append((far, level))
    return found


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each shard; rows arrive sorted by ``(block, leaf)``, a shard never spans partitions."""
    own = masks()

    def edges(key: tuple[int, int], held: list[np.ndarray]) -> np.ndarray:
        x = np.unique(np.concatenate(held)).view(np.uint64)
        pairs = np.array(tree_links(x, own[key[0]]), np.int64).reshape(-1, 2)
        return x[pairs].view(np.int64)

    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        block, leaf, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        starts = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (leaf[1:] != leaf[:-1])) + 1).tolist()]
        found = []
        for a, b in zip(starts, [*starts[1:], len(fp)]):
            if (block[a], leaf[a]) != key:
                found += [edges(key, held)] if held else []
                key, held = (block[a], leaf[a]), []
            held.append(fp[a:b])
        if found:
            pairs = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])
    if held:
        pairs = edges(key, held)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])


def trees(distinct: DataFrame, shard_rows: int = SHARD_ROWS, sample: int = SAMPLE) -> list:
    """The upper nodes of each block's tree, fitted on a sample; ``distinct(fp)``."""
    total = distinct.count()
    some = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(max(total, 1))) < sample) if total > sample else distinct
    x = np.sort(some.toArrow().column("fp").to_numpy()).view(np.uint64)
    leaf = max(16.0, shard_rows * len(x) / max(total, 1))
    return [grow(np.random.default_rng(SEED).permutation(x), mask, RADIUS // BLOCKS, leaf, count()) for mask in masks()]


def sharded(distinct: DataFrame, shard_rows: int = SHARD_ROWS, sample: int = SAMPLE) -> DataFrame:
    """``(block, leaf, fp)``: every fingerprint in all leaves that its query visits."""
    fitted = trees(distinct, shard_rows, sample)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for block, (tree, mask) in enumerate(zip(fitted, masks())):
                for leaf, own in visited(x, tree, mask, RADIUS // BLOCKS):
                    n = len(own)
                    columns = [np.full(n, block, np.int32), np.full(n, leaf, np.int32), own.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "leaf", "fp"])

    return distinct.select("fp").mapInArrow(dealt, "block int, leaf int, fp long")


def links(distinct: DataFrame, shard_rows: int = SHARD_ROWS, sample: int = SAMPLE) -> DataFrame:
    """Pairs ``(u, v)`` within the radius that connect exactly what all such pairs connect; ``distinct(fp)``."""
    rows = sharded(distinct, shard_rows, sample).repartition("block", "leaf").sortWithinPartitions("block", "leaf")
    return rows.mapInArrow(_linked, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, component_id)``: the smallest id reachable through links, per input row."""
    prints = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    by_print = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    groups = materialize(components(links(by_print.select("fp"))), "groups")
    # only linked fingerprints have a group, all others are their own; written tables, so that a large one can be split
    held = materialize(by_print.join(groups.withColumnRenamed("node", "fp"), "fp"), "linked")
    named = materialize(held.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    held = held.join(named, "root").select("fp", "component_id", F.lit(True).alias("is_linked"))
    own = F.when(F.col("is_linked"), F.col("component_id")).otherwise(F.col("least"))
    by_print = materialize(by_print.join(held, "fp", "left").select("fp", own.alias("component_id")), "by_print")
    return prints.join(by_print, "fp").select(id_col, "fp", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with all its columns: the one with the smallest id.

    Rows that repeat that id yield one row.  Rows without an id stay where their group has no id at all.
    """
    found = near_duplicates(docs, id_col, text_col)
    key = "__representative"
    keep = materialize(found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias(key)).distinct(), "keep")
    kept = docs.join(keep, docs[id_col] == keep[key], "left_semi").dropDuplicates([id_col])
    bare = docs.where(F.col(id_col).isNull())
    lone = found.where(F.col(id_col).isNull() & F.col("component_id").isNull()).select(F.col("fp").alias(key)).distinct()
    udf = F.arrow_udf(_fingerprints, "long").asNondeterministic()
    bare = bare.withColumn("__fp", udf(F.col(text_col).cast("string"))).join(lone, F.col("__fp") == F.col(key), "left_semi").drop("__fp")
    return kept.unionByName(bare)
