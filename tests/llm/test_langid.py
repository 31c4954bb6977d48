"""Language identification: held-out accuracy, mixtures, EM, edge cases."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import langid, queries


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    found = queries.op7_language_id(spark, path).join(queries.table(spark, path, "documents").select("doc_id", "lang"), "doc_id")
    rows = found.where("held_out AND lang_pred <> 'und'").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id for r in found.where("held_out").collect()} == {r.doc_id for r in found.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}


def model(spark):
    path = "/root/testdata/sf0.01"
    return langid.learn(queries.table(spark, path, "documents"))


def test_mixture_proportions(spark):
    m = model(spark)
    docs = {r.lang: r.text for r in queries.table(spark, "/root/testdata/sf0.01", "documents").where("n_chars BETWEEN 3000 AND 6000").collect()}
    pure = m.proportions(docs["de"])
    assert max(pure, key=pure.get) == "de" and pure["de"] > 0.9
    mixed = m.proportions(docs["de"][:1500] + "\n" + docs["es"][:3000])
    assert mixed.get("es", 0) > mixed.get("de", 0) > 0.15


def test_pruning_changes_no_result(spark):
    """The slope bound skips only languages whose own EM would not gain the penalty."""
    m = model(spark)
    for r in queries.table(spark, "/root/testdata/sf0.001", "documents").limit(60).collect():
        at = langid.features(r.text)
        if not len(at):
            continue
        logs, penalty = m.logs[at], langid.PENALTY * np.log(max(len(at), 2))
        base = logs.max(axis=1)
        p = np.exp(logs - base[:, None])
        best = int(np.argmax(logs.sum(axis=0)))
        gains = []
        for j in range(len(m.languages)):
            if j != best:
                w = langid._em(p[:, [best, j]], np.array([0.9, 0.1]))
                gains.append(float(np.log(p[:, [best, j]] @ w).sum() + base.sum() - logs[:, best].sum()))
        assert (len(m.proportions(r.text)) > 1) == (max(gains) > penalty)


def slow_predict(m, text):
    """Trigrams by a loop, every language tried at each step, every trigram a row of its own."""
    symbols = [" "]
    for c in (text or "").lower():
        if c.isalpha():
            symbols.append(c)
        elif symbols[-1] != " ":
            symbols.append(" ")
    if len(symbols) == 1:
        return "und", 0.0
    symbols += [" "] * (symbols[-1] != " ")
    rows = []
    for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
        mixed = ord(a) * 0x9E3779B97F4A7C15 ^ ord(b) * 0xC2B2AE3D27D4EB4F ^ ord(c) * 0x165667B19E3779F9
        rows.append(m.logs[(mixed & (1 << 64) - 1) * 0xD6E8FEB86659FD93 % (1 << 64) >> 47].astype(float))
    logs = np.array(rows)
    p, penalty = np.exp(logs), langid.PENALTY * np.log(max(len(rows), 2))
    chosen = [int(np.argmax(logs.sum(axis=0)))]
    w, value = np.ones(1), logs[:, chosen[0]].sum()
    while len(chosen) < len(m.languages):
        tries = []
        for j in set(range(len(m.languages))) - set(chosen):
            new = np.append(w * 0.9, 0.1)
            for _ in range(langid.ROUNDS):
                r = p[:, [*chosen, j]] * new
                old, new = new, (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
                if np.abs(new - old).max() < 1e-4:
                    break
            tries.append((np.log(p[:, [*chosen, j]] @ new).sum(), j, new))
        top = max(tries, key=lambda x: x[0])
        if top[0] - value <= penalty:
            break
        value, w = top[0], top[2]
        chosen.append(top[1])
    k = min(range(len(w)), key=lambda i: (-w[i], m.languages[chosen[i]]))
    return m.languages[chosen[k]], float(w[k])


def test_query_equals_slow_prediction(spark):
    path = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in queries.table(spark, path, "documents").collect()}
    held = [i for i in docs if zlib.crc32(str(i).encode()) % 4 == 2]
    table = queries.table(spark, path, "documents").where(~F.col("doc_id").isin(held))
    m = langid.learn(table)
    for r in queries.op7_language_id(spark, path).collect():
        lang, score = slow_predict(m, docs[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - score) < 1e-3


def test_pieces_change_no_feature(monkeypatch):
    texts = ["", "a", "ab, cd!", "  x1y22z  ", "é" * 9 + ".." + "ß" * 4, "12 !!", "\n\n", "ab" * 20 + " - " * 7]
    want = [langid.features(t).tolist() for t in texts]
    for piece in (1, 2, 3, 7):
        monkeypatch.setattr(langid, "_PIECE", piece)
        assert [langid.features(t).tolist() for t in texts] == want
        for t, f in zip(texts, want):
            at, n = langid.counts(t)
            assert np.repeat(at, n).tolist() == sorted(f)


def test_trigrams_ignore_other_characters():
    f = langid.features
    assert (f("ab, cd") == f("ab  12 cd!")).all() and len(f("ab cd")) == 5 and len(f("1 2 ..")) == len(f(None)) == len(f("")) == 0 and len(f("a")) == 1


def test_counts_equal_loop(spark):
    rows = [("x", "abab"), ("y", "abab ba"), ("x", "ab"), (None, "zz"), ("z", None), ("x", "12")]
    m = langid.learn(spark.createDataFrame(rows, "lang string, text string"))
    assert m.languages == ["x", "y"]
    n = np.zeros((langid.BUCKETS, 2))
    for lang, text in rows:
        if lang in ("x", "y"):
            for b in langid.features(text):
                n[b, "xy".index(lang)] += 1
    n += langid.ALPHA
    assert np.allclose(m.logs, np.log(n / n.sum(axis=0)), atol=1e-5)


def test_many_languages_pass_through_the_task_bound(spark, monkeypatch):
    rows = [(f"l{i:02d}", chr(97 + i % 26) * 3 + chr(97 + i // 26)) for i in range(60)] * 2
    m = langid.learn(spark.createDataFrame(rows, "lang string, text string").coalesce(1))
    assert len(m.languages) == 60 and all(m.predict(t)[0] == lang for lang, t in rows)


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 !!"), (None, "hello"), (4, "é" * 70_000), (5, "hello"), (5, "hello")], "doc_id long, text string").selectExpr("*", "'q' AS score")
    learned = langid.learn(spark.createDataFrame([("en", "hello there"), ("fr", "été")], "lang string, text string"))
    rows = df.select("doc_id", langid.identified(F.col("text"), learned).alias("p")).collect()
    got = sorted(((str(r.doc_id), r.p.lang_pred) for r in rows))
    assert got == [("1", "und"), ("2", "und"), ("3", "und"), ("4", "fr"), ("5", "en"), ("5", "en"), ("None", "en")]
    nothing = langid.learn(spark.createDataFrame([], "lang string, text string"))
    assert [tuple(r.p) for r in df.where("doc_id = 5").select(langid.identified(F.col("text"), nothing).alias("p")).collect()] == [("und", 0.0)] * 2
