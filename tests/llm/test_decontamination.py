"""Containment search against SQL, sketch bounds, planted items, edge cases."""

import random

from pyspark.sql import functions as F

from tallyloom.llm import decontamination as d
from tallyloom.llm import queries
from tests.conftest import same_as_sql


def test_query_equals_sql(spark, duck):
    same_as_sql(spark, duck, queries.op1_decontamination, queries.SQL["op1_decontamination"])


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_sketch_is_hit_at_the_threshold(spark):
    """Any way to miss a fifth of an item's shingles leaves a sketch hash in the document."""
    rng = random.Random(1)
    items = spark.createDataFrame([(n, words(rng, n + 4)) for n in range(1, 60)], "item_id long, text string")
    for item, rows in {i: [r for r in d.item_shingles(items).collect() if r.item_id == i] for i in range(1, 60)}.items():
        n, sketch = rows[0].n, sum(r.in_sketch for r in rows)
        missed = max(m for m in range(n + 1) if (n - m) >= 0.8 * n)
        assert n == item and sketch > missed


def test_planted_items_are_found_and_clean_documents_left(spark):
    rng = random.Random(2)
    items = [(i, words(rng, rng.randrange(12, 60))) for i in range(40)]
    docs = [(i, words(rng, rng.randrange(5, 900))) for i in range(60)]
    want = set()
    for k, (i, text) in enumerate(items):
        parts = docs[k][1].split()
        at = rng.randrange(len(parts) + 1)
        copy = text.upper().replace(" ", ", ") if k % 2 else text
        docs[k] = (k, " ".join([*parts[:at], copy, *parts[at:]]))
        want.add((k, i))
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in d.contamination(df, it).collect()} == want
    assert sorted(r.doc_id for r in d.clean(df, it).collect()) == list(range(40, 60))


def test_threshold_is_inclusive(spark):
    rng = random.Random(4)
    w = words(rng, 14).split()  # ten shingles
    items = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    docs = spark.createDataFrame([(8, " ".join(w[:12])), (7, " ".join(w[:11]))], "doc_id long, text string")
    assert [(r.doc_id, r.n_shared, r.containment) for r in d.contamination(docs, items).collect()] == [(8, 8, 0.8)]


def test_join_without_broadcast_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(d, "broadcast_if_small", lambda df: df)
    path = "/root/testdata/sf0.01"
    run = lambda: sorted(tuple(r) for r in d.contamination(queries.table(spark, path, "documents"), queries.table(spark, path, "benchmark")).collect())
    assert len(run()) == 26


def test_edge_cases(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta"
    items = spark.createDataFrame([(1, text), (1, text), (2, None), (3, ""), (4, "too few words"), (None, text)], "item_id long, text string").withColumn("n", F.lit(3))
    docs = spark.createDataFrame([(1, text), (1, text), (None, "x " + text), (2, None), (3, ""), (4, "too few words"), (5, "y " * 60_000)], "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS h", "3 AS gram")
    got = sorted(((r.doc_id, r.item_id) for r in d.contamination(docs, items).collect()), key=str)
    assert got == sorted([(1, 1), (1, None), (None, 1), (None, None), (4, 4)], key=str)
    kept = d.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 5]
    none = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert d.contamination(none[0], items).count() == d.contamination(docs, none[1]).count() == 0
    assert d.clean(docs, none[1]).count() == docs.count()


def test_short_items_and_items_of_one_id(spark):
    items = spark.createDataFrame([(1, "Alpha"), (2, "beta gamma delta"), (3, "one two three four five six"), (3, "red green blue white black grey"), (4, "...")], "item_id long, text string")
    docs = [(1, "x alpha y"), (2, "beta gamma, delta"), (3, "gamma beta delta"), (4, "so red green blue white black grey one"), (5, "alphabet"), (6, "alpha")]
    got = {(r.doc_id, r.item_id, r.n_shingles) for r in d.contamination(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {(1, 1, 1), (6, 1, 1), (2, 2, 1), (4, 3, 2)}


def test_plan_has_no_python(spark):
    df = d.candidates(queries.table(spark, "/root/testdata/sf0.001", "documents"), spark.createDataFrame([(1, 2)], "item long, h long"), [5], 1)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
