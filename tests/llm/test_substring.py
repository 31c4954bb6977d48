"""Sentence-span deduplication against a loop and on planted passages."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import queries, substring
from tests.conftest import DATA, same_as_sql


def slow(rows):
    """Texts after removal: of every shortest run of two sentences and 25 words, from or up to a sentence, all but the first by id and place go."""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    split = lambda t: [w for w in re.split("[ \t\n\x0b\x0c\r]+", lower(t)) if w]
    first, held = {}, []
    for i, text in sorted(rows):
        p = [text[a:b] for a, b in substring.sentences(text or "")]
        some = [k for k, s in enumerate(p) if split(s)]
        n = len(some)
        words = [split(p[k]) for k in some]
        spans = set()
        for a in range(n):
            for b in range(a + 2, n + 1):
                if sum(map(len, words[a:b])) >= 25:
                    spans.add((a, b))
                    break
        for b in range(n, 1, -1):
            for a in range(b - 2, -1, -1):
                if sum(map(len, words[a:b])) >= 25:
                    spans.add((a, b))
                    break
        run = {s: " ".join(w for k in words[s[0] : s[1]] for w in k) for s in spans}
        for s in sorted(spans):
            first.setdefault(run[s], (i, s[0]))
        held.append((i, text, p, some, run))
    out = {}
    for i, text, p, some, run in held:
        drop = {k for (a, b), w in run.items() if first[w] != (i, a) for k in some[a:b]}
        out[i] = None if text is None else "".join(s for k, s in enumerate(p) if k not in drop)
    return out


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab.!?,\n \t", max_size=60))
def test_sentences_cover_the_text(text):
    assert "".join(text[a:b] for a, b in substring.sentences(text)) == text


def test_table_equals_loop(spark):
    for d in (DATA, "/root/testdata/sf0.01"):
        rows = [(r.doc_id, r.text) for r in queries.table(spark, d, "documents").select("doc_id", "text").collect()]
        got = {r.doc_id: r.text for r in queries.op5_substring_dedup(spark, d).select("doc_id", "text").collect()}
        assert got == slow(rows)


def test_query_equals_sql(spark, duck):
    same_as_sql(spark, duck, queries.op5_substring_dedup, queries.SQL["op5_substring_dedup"])


def test_passages_that_begin_inside_sentences_go(spark):
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(10**6)}" + "," * (k % 7 == 6) for k in range(n)]
    passage = " ".join(words(60))
    rows = [(i, f"{' '.join(words(9 + i))} {passage} {' '.join(words(11))}. {' '.join(words(40))}.") for i in range(12)]
    got = {r.doc_id: r.text for r in substring.trimmed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1]
    for i, t in rows[1:]:
        left = set(got[i].split())
        gone = [w for w in passage.split() if w not in left]
        assert len(gone) >= 60 - 14 and len(got[i].split()) == len(t.split()) - len(gone)


def test_planted_passages_go_and_clean_text_stays(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(3, 9)))
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(6, 14))).capitalize() + "."
    body = lambda n: " ".join(sentence() for _ in range(n))
    passage = body(8)
    clean = [(i, body(12)) for i in range(20)]
    planted = [(100 + i, f"{body(5)} {passage} {body(5)}") for i in range(10)]
    df = spark.createDataFrame(clean + planted, "doc_id long, text string")
    got = {r.doc_id: r.text for r in substring.trimmed(df).collect()}
    assert all(got[i] == t for i, t in clean)
    assert passage in got[100] and not any(passage[20:-20] in got[100 + i] or passage[len(passage) // 2 :][:60] in got[100 + i] for i in range(1, 10))
    assert all(len(got[i].split()) == len(t.split()) - len(passage.split()) for i, t in planted[1:])


def test_edge_cases(spark):
    s = " ".join(f"w{i}" for i in range(14)) + ". " + " ".join(f"v{i}" for i in range(12)) + ". "
    rows = [(1, None, 0), (2, "", 0), (3, s, 0), (3, s, 0), (4, s, 0), (None, s, 0), (5, "short. text.", 0), (6, "short. text.", 0), (7, s + s, 0), (8, "w " * 50_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int").selectExpr("*", "'x' AS mark", "2 AS at")
    out = substring.trimmed(df)
    assert out.columns == [*df.columns, "__removed_runs"]
    got = sorted(((r.doc_id, r.text and len(r.text)) for r in out.collect()), key=str)
    n = len(s)
    assert got == sorted([(1, None), (2, ""), (3, n), (3, n), (4, ""), (None, ""), (5, 12), (6, 12), (7, ""), (8, 100_000)], key=str)
    assert substring.trimmed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
