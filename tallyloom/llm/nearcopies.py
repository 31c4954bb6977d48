"""SimHash near-duplicates held to shingle similarity: Jaccard of the sets of ``SHINGLE``-word shingles, ``SIMILARITY`` or more.

Texts with one set of shingles are one node.  The vantage-point trees of ``simhash`` link fingerprints within four
bits, which brings most groups of copies together.  But texts at the threshold differ by 10 bits on average, and a tree
hardly prunes at the 18 bits that would be safe (one in 3,000 unrelated pairs lies within them).  So MinHash bands
search for the pairs that the trees left apart: ``BANDS`` of ``ROWS`` minima put a pair at the threshold into a common
bucket with probability 1 - (1 - 0.8^5)^25 = 0.99995, more above it.  Nothing is linked on a sketch alone: each
candidate pair of either search is verified with both whole sets.

A bucket with a large group is not compared pair by pair at first.  In a star round each member meets one member
of its bucket, and what links becomes one component; pairs inside a component need no more comparing.  Other rounds
choose other centres, until the pairs left are few or a round settles less than half.  Then the rest is compared whole, but
never as a table of pairs: members of a bucket are dealt to blocks of bounded size, a task intersects two blocks as matrices
and passes on only links, at most one for each member.  Buckets of ``SMALL`` members or fewer go as pairs.
So components are those of all similar pairs that share a bucket or are within the trees' radius.  The first star
round takes the trees' pairs along.

Words are those of ``simhash``: lower case and blanks in ASCII only.  A text of fewer words than a shingle is one
shingle, one without words too.  Defined results are those of ``simhash.representatives``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import simhash
from tallyloom.llm.common import broadcast_if_small, components, materialize, values

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
SEED = 42
_HASH = partial(xxhash.xxh64_intdigest, seed=SEED)
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
#: Members up to which a bucket goes as pairs; members and shingles that a block of a larger one is to have.
SMALL = 16
BLOCK_ROWS, BLOCK_HASHES = 512, 400_000
_PART = 2048  # shingles sketched at a time, so that very long texts need bounded memory
_LAST = (1 << 63) - 1
_WIDTH = 2048  # columns of a block's matrix at a time


def shingle_set(parts: list[np.ndarray]) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(np.concatenate(parts)) if parts else np.array([_HASH(b"")], np.uint64)


def _sets(texts: pa.Array) -> list[np.ndarray]:
    return [shingle_set(list(simhash.shingle_hashes(t, SHINGLE))) for (t,) in values(texts)]


def bands(hashes: np.ndarray) -> np.ndarray:
    """One bucket for each band of minima; the band's number is part of it."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), _PART):
        np.minimum(least, (_FACTORS[:, None] * hashes[None, start : start + _PART]).min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), seed=i) for i, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array((np.concatenate(rows) if rows else np.array([], np.uint64)).view(np.int64)))


def _key(own: np.ndarray) -> int:
    return _HASH(own.tobytes())


def _sketched(texts: pa.Array) -> pa.Array:
    keys, sizes, prints, found = [], [], [], []
    for (t,) in values(texts):
        parts = list(simhash.shingle_hashes(t, SHINGLE))
        own = shingle_set(parts)
        for column, value in zip((keys, sizes, prints, found), (_key(own), len(own), simhash.majority(parts), bands(own))):
            column.append(value)
    longs = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (keys, prints)]
    return pa.StructArray.from_arrays([longs[0], pa.array(sizes, pa.int32()), longs[1], _lists(found)], ["key", "n", "fp", "bands"])


def _hashed(texts: pa.Array) -> pa.Array:
    sets = _sets(texts)
    return pa.StructArray.from_arrays([pa.array(np.array([_key(s) for s in sets], np.uint64).view(np.int64)), _lists(sets)], ["key", "hashes"])


def _keys(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([_key(s) for s in _sets(texts)], np.uint64).view(np.int64))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(u, v)`` that are similar; ``sets(key, hashes)``. Both sides of a join are dealt by key, so that a frequent centre can be split."""
    left = pairs.join(sets.hint("merge"), F.col("u") == F.col("key")).select("u", "v", F.col("hashes").alias("a"))
    both = left.join(sets.hint("merge"), F.col("v") == F.col("key"))
    shared = F.size(F.array_intersect("a", "hashes"))
    union = F.size("a") + F.size("hashes") - shared
    return materialize(both.where(shared >= F.lit(SIMILARITY) * union).select("u", "v"), "similar")


def _block_links(block: pa.Table) -> pa.Table:
    """Links ``(u, v)`` that connect all similar rows of two blocks (or of one) with different roots."""
    key, n, root, own = (block.column(c).to_numpy() for c in ("key", "n", "root", "block"))
    i, j, m = block.column("i")[0].as_py(), block.column("j")[0].as_py(), block.num_rows
    lists = block.column("hashes").combine_chunks()
    _, at, often = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    shared = often > 1  # others are in no intersection
    column = np.cumsum(shared) - 1
    row = np.repeat(np.arange(m), lists.value_lengths().to_numpy())[shared[at]]
    at = column[at[shared[at]]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    both = np.zeros((m, m), np.float32)
    for start in range(0, int(shared.sum()), _WIDTH):
        a, b = np.searchsorted(at, [start, start + _WIDTH])
        held = np.zeros((m, _WIDTH), np.float32)
        held[row[a:b], at[a:b] - start] = 1
        both += held @ held.T
    similar = both >= SIMILARITY * (n[:, None] + n[None, :] - both.astype(np.float64))
    similar &= (root[:, None] != root[None, :]) & (own[:, None] == i) & (own[None, :] == j)
    parent, found = list(range(m)), []

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in np.argwhere(similar).tolist():
        x, y = top(a), top(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            found.append((a, b))
    pairs = np.sort(key[np.array(found, np.int64).reshape(-1, 2)], axis=1)
    return pa.table({"u": pairs[:, 0], "v": pairs[:, 1]})


def block_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links within buckets, for ``members(bucket, key, n, root, c, s)``: c members and s shingles in the bucket."""
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK_ROWS), F.ceil(F.col("s") / BLOCK_HASHES)).cast("int")
    own = F.pmod(F.xxhash64("key"), blocks).cast("int")
    rows = members.select("bucket", "key", "n", "root", own.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    rows = rows.select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).drop("other")
    return rows.join(sets.hint("merge"), "key").groupBy("bucket", "i", "j").applyInArrow(_block_links, "u long, v long")


def _fits(a: str, b: str):
    """Whether two set sizes allow the similarity at all."""
    return F.least(a, b) >= F.lit(SIMILARITY) * F.greatest(a, b)


def tree_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs ``(u, v)`` of nodes that the vantage-point trees link; nodes of one fingerprint meet its least."""
    prints = materialize(nodes.groupBy("fp").agg(F.min("key").alias("rep")), "prints")
    far = simhash.links(prints.select("fp"))
    far = far.join(prints.select(F.col("fp").alias("u"), F.col("rep").alias("a")), "u").join(prints.select(F.col("fp").alias("v"), F.col("rep").alias("b")), "v")
    same = nodes.select("fp", F.col("key").alias("a")).join(prints, "fp").where("a <> rep")
    pairs = far.select("a", "b").unionByName(same.select("a", F.col("rep").alias("b")))
    return materialize(pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "tree_pairs")


def groups(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(key, least)`` of the nodes kept; ``nodes(key, least, n, fp, bands)``, ``sets_of(nodes)`` gives ``(key, hashes)``."""
    near = tree_pairs(nodes)
    every = nodes.select("key", "n", F.explode("bands").alias("bucket"))
    full = materialize(every.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket"), "buckets")
    members = materialize(every.join(full, "bucket"), "members")
    used = members.select("key").unionByName(near.select(F.explode(F.array("u", "v")).alias("key"))).distinct()
    sets = materialize(sets_of(nodes.select("key", "least").join(used, "key", "left_semi")), "sets")
    left, edges, turn, found, before = members.withColumn("root", F.col("key")), near.limit(0), 0, 1, float("inf")
    linked = edges.select(F.col("u").alias("key"), F.col("v").alias("root"))
    while True:
        # only buckets that hold several components have pairs left
        sizes = left.groupBy("bucket", "root").agg(F.count("*").alias("k"), F.sum("n").alias("n")).groupBy("bucket")
        sizes = sizes.agg(F.count("*").alias("roots"), F.sum("k").alias("c"), F.sum("n").alias("s"), F.sum(F.col("k") * F.col("k")).alias("own"))
        sizes = materialize(sizes.where("roots > 1").select("bucket", "c", "s", (F.col("c") * F.col("c") - F.col("own")).alias("cross")), "sizes")
        rows, pairs = sizes.agg(F.sum("c"), F.sum("cross") / 2).first()
        if not rows and turn:
            break
        rows, pairs = rows or 0, pairs or 0
        left = materialize(left.join(sizes.select("bucket", "c", "s"), "bucket"), "open")
        last = bool(turn) and (pairs <= 4 * rows or not found or pairs > before / 2)
        before = pairs
        if last:
            few = left.where(F.col("c") <= SMALL)
            other = few.select("bucket", F.col("key").alias("v"), F.col("n").alias("m"), F.col("root").alias("r"))
            candidates = few.join(other, "bucket").where("key < v AND root <> r")
        else:
            order = F.struct(F.xxhash64("key", F.lit(turn)).alias("o"), F.col("key").alias("v"), F.col("n").alias("m"), F.col("root").alias("r"))
            stars = materialize(left.groupBy("bucket").agg(F.min(order).alias("o")).select("bucket", "o.v", "o.m", "o.r"), "stars")
            candidates = left.join(stars, "bucket").where("root <> r")
        candidates = candidates.where(_fits("n", "m")).select(F.least("key", "v").alias("u"), F.greatest("key", "v").alias("v"))
        candidates = candidates if turn else candidates.unionByName(near)
        similar = verified(materialize(candidates.distinct(), "candidates"), sets)
        if last:
            similar = materialize(similar.unionByName(block_links(left.where(F.col("c") > SMALL), sets)).distinct(), "rest")
        found = similar.count()
        if found:
            edges = materialize(edges.unionByName(similar), "links") if turn else similar
            linked = materialize(components(edges).withColumnRenamed("node", "key"), "linked")
        if last:
            break
        left = left.drop("c", "s")
        if found:
            left = left.drop("root").join(linked, "key", "left").withColumn("root", F.coalesce("root", "key"))
            left = materialize(left, "left")
        turn += 1
    return nodes.select("key", "least").join(dropped(nodes, linked), "key", "left_anti")


def dropped(nodes: DataFrame, linked: DataFrame) -> DataFrame:
    """``key`` of all nodes but the one with the smallest id in each component; ``linked(key, root)``."""
    named = materialize(linked.join(nodes.select("key", "least"), "key"), "named")
    first = materialize(named.groupBy("root").agg(F.min(F.struct(F.coalesce("least", F.lit(_LAST)).alias("o"), "key")).alias("f")), "first")
    return materialize(named.join(first, "root").where(F.col("key") != F.col("f.key")).select("key"), "dropped")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near copies, with all its columns: the one with the smallest id.

    Rows that repeat that id yield one row.  Rows without an id stay where their group has no id at all.
    """
    sketch = F.arrow_udf(_sketched, "struct<key:long,n:int,fp:long,bands:array<long>>").asNondeterministic()
    hashed = F.arrow_udf(_hashed, "struct<key:long,hashes:array<long>>").asNondeterministic()
    rows = docs.select(F.col(id_col).alias("id"), sketch(F.col(text_col).cast("string")).alias("s")).select("id", "s.*")
    # one row of each set; size, fingerprint and buckets follow from the set (the fingerprint but for repeated shingles)
    nodes = rows.groupBy("key").agg(F.min("id").alias("least"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("bands").alias("bands"))
    nodes = materialize(nodes, "nodes")

    def sets_of(some: DataFrame) -> DataFrame:
        ids = materialize(some.select(F.col("least").alias("__least")).where("__least IS NOT NULL").distinct(), "ids")
        own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
        own = own.where("__id IS NULL").unionByName(own.join(broadcast_if_small(ids), F.col("__id") == F.col("__least"), "left_semi"))
        return own.select(hashed("__text").alias("s")).select("s.*").dropDuplicates(["key"])

    kept = materialize(groups(nodes, sets_of), "kept")
    key = "__representative"
    keep = materialize(kept.where("least IS NOT NULL").select(F.col("least").alias(key)).distinct(), "keep")
    done = docs.join(keep, docs[id_col] == keep[key], "left_semi").dropDuplicates([id_col])
    lone = kept.where("least IS NULL").select(F.col("key").alias(key))
    udf = F.arrow_udf(_keys, "long").asNondeterministic()
    bare = docs.where(F.col(id_col).isNull()).withColumn("__key", udf(F.col(text_col).cast("string")))
    return done.unionByName(bare.join(lone, F.col("__key") == F.col(key), "left_semi").drop("__key"))
