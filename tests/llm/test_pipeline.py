"""The pipeline against brute-force stages."""

import hashlib

from tokenizers import Tokenizer

import corpus_pipeline
from tallyloom.llm import decontamination, quality, queries, substring
from tallyloom.llm.common import materialize
from tests.conftest import DATA
from tests.llm.test_nearcopies import slow as slow_near
from tests.llm.test_substring import slow as slow_substring


def test_stages_equal_brute_force(spark):
    docs = queries.table(spark, DATA, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {i: t for i, t in rows.items() if not any(rule(lambda m, v=dict(zip(quality.MEASURES, quality.measure(t))): v[m]) for _, rule in PLAIN)}
    kept = {i: kept[i] for i in sorted(slow_near(kept))}
    kept = {i: t for i, t in slow_substring(list(kept.items())).items() if t.strip() or not kept[i].strip()}
    items = {r.item_id: r.text for r in queries.table(spark, DATA, "benchmark").collect()}
    import regex

    grams = lambda t: {tuple(w[k : k + 5]) for w in [regex.findall(r"[\p{L}\p{M}\p{N}]+", t.lower())] for k in range(len(w) - 4)}
    bench = [g for g in map(grams, items.values()) if g]
    kept = {i: t for i, t in kept.items() if not any(len(g & grams(t)) >= 0.8 * len(g) for g in bench)}
    library = Tokenizer.from_file(queries.word_vocabulary())
    want = {}
    for i, t in kept.items():
        x = library.encode(t, add_special_tokens=False).ids
        want[i] = (len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == want


PLAIN = [
    ("few_words", lambda m: m("n_words") < 50), ("repeated", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")), ("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    ("lines", lambda m: 5 * m("n_dup_lines") > 2 * m("n_lines")), ("length", lambda m: m("word_chars") < 2 * m("n_words") or m("word_chars") > 15 * m("n_words")),
    ("shouting", lambda m: 10 * m("n_shouts") > 3 * m("n_words")), ("capitals", lambda m: 2 * m("n_upper") > m("word_chars")),
]


def test_stages_keep_the_columns_of_documents(spark):
    docs = queries.table(spark, DATA, "documents").withColumn("extra", quality.F.lit(1))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "decontamination", "bpe"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = materialize(stage(spark, docs, DATA), name)
        assert docs.columns == list(corpus_pipeline.COLUMNS) and docs.count() <= before
        assert docs.where("n_chars <> length(text)").count() == 0


def test_empty_documents(spark):
    docs = queries.table(spark, DATA, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DATA), name)
        assert docs.count() == 0


def test_nulls_pass_through(spark):
    long = " ".join(f"w{i}x" for i in range(80))
    docs = spark.createDataFrame([(None, long + " a", None, None, None), (1, None, "en", None, 3), (2, long + " b c d e f g h", None, "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DATA), name)
    assert {r.doc_id for r in docs.collect()} >= {2}
    assert decontamination.THRESHOLD == 0.8 and substring.MIN_WORDS < 50
