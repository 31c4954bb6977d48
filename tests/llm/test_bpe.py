"""The codec against the tokenizers library."""

import functools
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyloom.llm import bpe, queries
from tests.conftest import DATA

PATH = queries.word_vocabulary()
ODD = [
    "", " ", "\n\t", "aİb ΣΣ ΑΣ. don't I'LL 'd ''s", "<|endoftext|>x<|startoftext|> <|END|> <|", "é é ẛ̣ ﬁ ① ½ x​ y\x1cz\x85q\xa0r",
    "日本語テキスト 🎉🎉👩‍👩‍👧 ", "x" * 3000, "ab" * 2000 + "!!" * 999, "\x00\x01\x7f\ufffe", "안녕 ảnh đẹp Ǆ ŉ", "a​b⁠c﻿d", "3.14159 १२३", "__init__ $$$ &&&",
]


@functools.cache
def library():
    return Tokenizer.from_file(PATH)


def same(text):
    want = library().encode(text, add_special_tokens=False).ids
    c = bpe.codec(PATH)
    assert c.encode(text) == want
    decoded = library().decode(want, skip_special_tokens=False)
    assert c.decode(want) == decoded
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert c.digest(text) == (len(want), sha(" ".join(map(str, want))), sha(decoded))


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text.encode("utf-8", "replace").decode())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abtheing'sé ΣσÀ̀\n12", max_size=80))
def test_common_text(text):
    same(text)


def test_every_code_point_of_the_first_planes():
    c, lib = bpe.codec(PATH), library()
    for start in range(0, 0x3100, 64):
        text = " ".join(f"a{chr(p)}b {chr(p)}" for p in range(start, start + 64))
        assert c.encode(text) == lib.encode(text, add_special_tokens=False).ids


def test_cuts_are_forced():
    """No token of the vocabulary spans a cut, and encoding fragment by fragment equals encoding the word at once."""
    c = bpe.codec(PATH)
    several = 0
    for word in ("internationalisation", "zqxjkv", "aaaaaaaabbbbbbb", "0x7f", "qqqwwwz", "xqzjvkqxw", "ÃÂ§ÃÂ"):
        symbols = [*word[:-1], word[-1] + c.suffix]
        parts = c.fragments(symbols)
        several += len(parts) > 1
        assert [s for p in parts for s in p] == symbols and all((a[-1], b[0]) not in c.inside for a, b in zip(parts, parts[1:]))
        assert c._tokens(word) == [t.value for t in c._last.tokenize(word)]
    assert several > 1


def test_memory_is_bounded_and_changes_nothing():
    c = bpe.Codec(PATH)
    c._run, c._word, c._fragment = map(bpe.Memory, (4, 3, 2))
    text = "one two three four five six seven one two three " * 20
    assert c.encode(text) == library().encode(text, add_special_tokens=False).ids
    assert len(c._word.young) <= 3 and len(c._word.old) <= 3


def test_query_equals_library(spark):
    rows = {r.doc_id: r for r in queries.op6_bpe(spark, DATA).collect()}
    for r in queries.table(spark, DATA, "documents").collect():
        ids = library().encode(r.text, add_special_tokens=False).ids
        got = rows[r.doc_id]
        assert got.n_tokens == len(ids) and got.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(library().decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_edge_cases(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (None, "a b"), (3, "Hello")], "doc_id long, text string").withColumn("n_tokens", F.lit(0))
    rows = bpe.digests(df, PATH).collect()
    assert sorted(r.n_tokens for r in rows) == [0, 0, 1, 2, 2]
    assert bpe.digests(df.limit(0), PATH).count() == 0
    back = df.select(bpe.decoded(bpe.encoded(F.col("text"), PATH), PATH).alias("t")).collect()
    assert sorted(r.t for r in back) == sorted(["", "", "a</w> b</w>", "a</w> b</w>", "hello</w>"])
    with pytest.raises(ValueError):
        bpe.Codec(PATH.replace("word_bpe_49k", "byte_bpe_50k"))
