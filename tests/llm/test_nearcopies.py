"""Near copies of the pipeline against exact Jaccard of all pairs."""

import random

import corpus_pipeline
from tallyloom.llm import nearcopies, queries, simhash
from tallyloom.llm.common import materialize


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def similar(a, b):
    return min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b)


def slow(rows):
    """Smallest id of each component of pairs at 0.8 or more."""
    sets = {i: grams(t) for i, t in rows.items()}
    root = {i: i for i in sets}

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if similar(sets[i], sets[j]):
                a, b = of(i), of(j)
                root[max(a, b)] = min(a, b)
    return {i for i in ids if of(i) == i}


def test_copies_beyond_four_bits_go(spark):
    rng = random.Random(5)
    rows, far = {}, 0
    for i in range(0, 60, 2):
        words = [f"w{rng.randrange(400)}" for _ in range(300)]
        rows[i] = " ".join(words)
        for k in rng.sample(range(300), 6):
            words[k] = "other"
        rows[i + 1] = " ".join(words)
        far += (simhash.fingerprint(rows[i]) ^ simhash.fingerprint(rows[i + 1])).bit_count() > 4
    assert far > 10
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert got == slow(rows)


def test_stage_equals_all_pairs_on_the_table(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    docs = materialize(corpus_pipeline.quality_rules(spark, docs, ""), "kept")
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert got == slow({r.doc_id: r.text for r in docs.collect()})


def test_one_large_group_is_no_square(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(400)}" for _ in range(200)]
    rows = {}
    for i in range(400):
        words = list(base)
        for k in rng.sample(range(200), rng.randrange(1, 5)):
            words[k] = f"x{i}"
        rows[i] = " ".join(words)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert {r.doc_id for r in nearcopies.representatives(df).collect()} == slow(rows)


def test_blocks_equal_all_pairs(spark, monkeypatch):
    """Copies of one text whose edits leave most pairs near, but not at, the threshold."""
    monkeypatch.setattr(nearcopies, "SMALL", 2)
    monkeypatch.setattr(nearcopies, "BLOCK_ROWS", 16)
    monkeypatch.setattr(nearcopies, "_WIDTH", 64)
    rng = random.Random(9)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows = {}
    for i in range(120):
        words = list(base)
        for k in rng.sample(range(150), rng.choice([2, 4, 5, 6, 7])):
            words[k] = f"x{i}"
        rows[i] = " ".join(words)
    want = slow(rows)
    assert 10 < len(want) < 110
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert {r.doc_id for r in nearcopies.representatives(df).collect()} == want


def test_edge_cases(spark):
    rows = [(5, None), (3, ""), (None, "  "), (9, "a b c d e"), (9, "a b c d e"), (None, "z y x w v u t"), (11, "m " * 40_000), (2, "A B C D E")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = nearcopies.representatives(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 2, None, 11], key=str)
    assert nearcopies.representatives(df.limit(0)).count() == 0
