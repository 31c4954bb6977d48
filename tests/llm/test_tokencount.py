"""Attributed token counts against the library's offsets."""

import functools

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm import queries, tokencount
from tests.conftest import DATA

RANKS = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN


@functools.cache
def library():
    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return t


def slow(text, sections, rule):
    """Byte by byte: which section each byte of each token lies in."""
    byte_of = [0]
    for ch in text:
        byte_of.append(byte_of[-1] + len(ch.encode()))
    owner = [-1] * byte_of[-1]
    for i, (a, b) in enumerate(sections):
        for k in range(byte_of[a], byte_of[b]):
            owner[k] = i
    out = dict.fromkeys([*range(len(sections)), -1], 0.0)
    start = 0
    for end in tokencount.token_ends(text, RANKS, PATTERN).tolist():
        held = owner[start:end]
        share = {i: held.count(i) for i in dict.fromkeys(held)}
        if rule == "start":
            out[held[0]] += 1
        elif rule == "majority":
            out[min(share, key=lambda i: (-share[i], i if i >= 0 else len(sections)))] += 1
        else:
            for i, n in share.items():
                out[i] += n / len(held)
        start = end
    return out


def test_ends_agree_with_library_offsets():
    for text in ("Hello world, this is it.", "one  two\n\nthree", "1234 x'll"):
        offsets = library().encode(text, add_special_tokens=False).offsets
        assert tokencount.token_ends(text, RANKS, PATTERN).tolist() == [b for _, b in offsets]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é日\n .the", min_size=1, max_size=60), st.lists(st.integers(0, 60), max_size=8), st.sampled_from(tokencount.RULES))
def test_attribution_equals_loop(text, cuts, rule):
    cuts = sorted(min(c, len(text)) for c in cuts)
    sections = list(zip(cuts[::2], cuts[1::2]))
    got = {r["section"]: r["n_tokens"] for r in tokencount._counts(text, [{"start": a, "end": b} for a, b in sections], RANKS, PATTERN, rule)}
    want = slow(text, sections, rule)
    assert {k: pytest.approx(v) for k, v in want.items() if v or k >= 0} == got
    assert sum(got.values()) == pytest.approx(len(tokencount.token_ends(text, RANKS, PATTERN)))


def test_query_sums_to_whole_documents(spark):
    rows = queries.op3_token_counts(spark, DATA).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("c")).collect()
    got = {r.doc_id: (r.n, r.c) for r in rows}
    for r in queries.table(spark, DATA, "documents").collect():
        if r.text:
            n = len(library().encode(r.text, add_special_tokens=False).ids)
            assert got[r.doc_id] == (n, len(tokencount.line_sections(r.text)))


def test_fields(spark):
    df = spark.createDataFrame([(1, "Title here", None, "The body of it.")], "id long, a string, b string, c string")
    text, sections = tokencount.fields("a", "b", "c")
    rows = {r.section: r for r in tokencount.token_counts(df, RANKS, PATTERN, id_col="id", text=text, sections=sections, rule="start").collect()}
    assert rows[0].n_tokens == 2 and rows[1].n_tokens == 0 and rows[2].n_tokens == 5 and rows[-1].n_tokens >= 1
    assert (rows[0].start, rows[0].end, rows[2].end) == (0, 10, len("Title here\n\nThe body of it."))


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "a\nb"), (3, "x\n"), (3, "x\n"), (4, "long " * 50_000)], "doc_id long, text string").selectExpr("*", "1 AS section", "2 AS n_tokens")
    rows = tokencount.token_counts(df, RANKS, PATTERN).collect()
    assert sorted((str(r.doc_id), r.section) for r in rows) == [("3", 0), ("3", 0), ("4", 0), ("None", 0), ("None", 1)]
    assert tokencount.token_counts(df.limit(0), RANKS, PATTERN).count() == 0
    with pytest.raises(ValueError):
        tokencount.token_counts(df, RANKS, PATTERN, rule="other")
    with pytest.raises(ValueError):
        tokencount.attribute(np.array([4]), np.array([0, 1]), np.array([2, 3]))
