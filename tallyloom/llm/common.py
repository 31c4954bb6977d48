"""Helpers shared by the corpus operators: checked broadcasts, Arrow rows, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import materialize, release, scratch_path, shared_dir

__all__ = ["BROADCAST_ROWS", "broadcast_if_small", "components", "materialize", "release", "scratch_path", "shared_dir", "values"]

#: A side within both bounds may be broadcast: rows, and bytes of its texts.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20
#: Edges that one task contracts (16 MB of longs; some 200 MB as a table of parents).
TASK_EDGES = 1_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint for a materialized narrow table whose counted rows and bytes of text stay within the bounds.

    Beyond them the frame comes back unhinted and the join shuffles.
    """
    texts = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    rows, *sizes = df.agg(F.count("*"), *texts).first()
    return F.broadcast(df) if rows <= max_rows and sum(sizes) <= max_bytes else df


def values(*columns: pa.Array, size: int = 256) -> Iterator[tuple]:
    """Rows of equally long Arrow arrays as Python values, a few at a time: a batch is never held twice."""
    for i in range(0, len(columns[0]), size):
        yield from zip(*(c.slice(i, size).to_pylist() for c in columns))


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star edges ``(u, v)``, v the least node, of the components of one task's edges."""
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while (up := parent.setdefault(i, i)) != i:
            parent[i] = parent[up]
            i = up
        return i

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    stars = [(i, root(i)) for i in parent]
    kept = [[s[k] for s in stars if s[0] != s[1]] for k in (0, 1)]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in kept], ["u", "v"])


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """Connected components of ``edges(u long, v long)`` as ``(node, root)``, root = smallest node.

    Tasks of at most ``task_edges`` edges each contract their own edges to stars.  If there is one such task, that is
    all.  Else large-star and small-star rounds alternate (Kiveris et al., 2014): every step is a map-side combined
    minimum and a join on the node; both are written to the shared folder, so that the join of a node with very many
    neighbours can be split.  The rounds end when an order-free signature of the edges stays the same.  Every linked
    node appears, roots too.
    """
    edges = materialize(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    tasks = -(-edges.count() // task_edges)
    dealt = edges.coalesce(1) if tasks <= 1 else edges.repartition(tasks)
    edges = materialize(dealt.mapInArrow(_forest, "u long, v long"), "stars")
    if tasks > 1:
        edges = _stars(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _stars(edges: DataFrame) -> DataFrame:
    """Star edges ``(u, v)`` of whole components, v the least node."""
    last = None
    while True:
        # large star: neighbours above a node go to the least of its neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        edges = (
            both.where("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        # small star: a node and its neighbours below it go to the least of them
        down = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "star")
        least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "least")
        edges = (
            down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        edges = materialize(edges, "edges")
        now = _signature(edges)
        if now == last:
            return edges
        last = now
