"""Quality rules: measurements against loops, policies, ablations, edge cases."""

import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import quality, queries
from tests.conftest import DATA, same_as_sql


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked), len(lines),
        text.count("!"), sum("A" <= c <= "Z" for c in text),
    )


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t\x0b\x0c\r\x85\xa0é#!A|", max_size=80))
def test_measure_equals_loop(text):
    assert quality.measure(text) == slow(text)


def test_query_equals_sql(spark, duck):
    same_as_sql(spark, duck, queries.op2_quality_rules, queries.SQL["op2_quality_rules"])


EDGES = [(1, None), (2, ""), (None, "a b c"), (3, "word " * 60), (3, "word " * 60), (4, " ".join(f"w{i}" for i in range(60))), (5, "x" * 200_000), (6, "A! " * 90)]


def test_edge_cases(spark):
    df = spark.createDataFrame(EDGES, "doc_id long, text string").selectExpr("*", "1 AS n_words", "'x' AS kept", "2 AS m")
    rows = quality.apply_policy(quality.ledger(df)).collect()
    assert len(rows) == len(EDGES)
    by = {r.doc_id: r for r in rows}
    assert by[1].n_words == by[2].n_words == 0 and by[1].base_failed and not by[1].kept
    assert by[3].base_failed and by[4].kept and by[5].word_chars == 200_000 and not by[6].kept
    kept = quality.passing(df)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [4]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert quality.ledger(df).count() == quality.passing(df).count() == 0
    assert {r.n_kept for r in quality.ablations(quality.ledger(df)).collect()} == {0}


@pytest.mark.parametrize("version", sorted(quality.POLICIES))
def test_ablations_equal_filters(spark, version):
    book = quality.ledger(queries.table(spark, DATA, "documents")).cache()
    bits = [r.fail_bits for r in book.collect()]
    mask = quality.POLICIES[version] | quality.BASE_MASK
    for r in quality.ablations(book, version).collect():
        assert r.n_failed == sum(bool(b & r.bit) for b in bits)
        assert r.n_failed_alone == sum(b & mask == r.bit for b in bits)
        assert r.n_kept_without == sum(not b & mask & ~r.bit for b in bits)
        assert r.n_kept == sum(not b & mask for b in bits)
    book.unpersist()


def test_labelled_documents(spark):
    """Rules keep documents labelled good and reject nearly all labelled bad, short ones aside."""
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    labels = queries.table(spark, "/root/testdata/sf0.01", "labels")
    rows = quality.apply_policy(quality.ledger(docs)).join(labels, "doc_id").where("n_words >= 50").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.2
