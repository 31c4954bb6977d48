"""Fingerprints and components against brute force."""

import random

import numpy as np
import xxhash

from tallyloom.llm import queries, simhash
from tallyloom.llm.common import components
from tests.conftest import DATA


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [words[i : i + 4] for i in range(len(words) - 3)] or [words]
    hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, prints, radius=4):
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    distinct = sorted(set(prints))
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for d, p in zip(ids, prints):
        if d is not None:
            least[root(p)] = min(d, least.get(root(p), d))
    return [least.get(root(p)) for p in prints]


def test_fingerprints_equal_loop():
    texts = ["", None, " \n", "One", "a b c", "a b c d", "A b  C\td e", "x " * 50, "é à ü ß İ Σ", "a\xa0b c\x85d e f", " ".join(f"w{i % 7}" for i in range(500))]
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


def test_chunks_do_not_change_a_fingerprint(monkeypatch):
    text = " ".join(f"w{i * i % 97}" for i in range(300))
    want = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_WORDS", 7)
    assert simhash.fingerprint(text) == want


def test_tables_equal_brute_force(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(rows)
    prints = [slow_fingerprint(rows[i]) for i in ids]
    want = dict(zip(ids, zip((f"{p:016x}" for p in prints), slow_components(ids, prints))))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op9_simhash(spark, "/root/testdata/sf0.01").collect()}
    assert got == want


def near(rng, n, groups=12):
    out = set()
    centres = [rng.getrandbits(64) for _ in range(groups)]
    while len(out) < n:
        p = rng.choice(centres) if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randrange(7)):
            p ^= 1 << rng.randrange(64)
        out.add(p)
    return sorted(out)


def test_tree_equals_brute_force(monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 8)
    for seed in range(6):
        prints = near(random.Random(seed), 400)
        x = np.array(prints, np.uint64)
        found = [p for mask in (None, *simhash.masks()) for p in simhash.tree_links(x, mask)]
        assert all((prints[i] ^ prints[j]).bit_count() <= 4 for i, j in found)
        for own in (found, simhash.tree_links(x)):
            roots = list(range(len(prints)))
            for _ in prints:
                for i, j in own:
                    roots[i] = roots[j] = min(roots[i], roots[j])
            assert roots == slow_components(list(range(len(prints))), prints)


def test_a_dense_family_needs_balls(monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 4)
    rng = random.Random(3)
    for width in (1, 3, 7):
        prints = sorted({rng.getrandbits(64) & ~((1 << 64) - (1 << 6 * width)) for _ in range(200)})
        found = simhash.tree_links(np.array(prints, np.uint64), simhash.masks()[2])
        roots = list(range(len(prints)))
        for _ in prints:
            for i, j in found:
                roots[i] = roots[j] = min(roots[i], roots[j])
        assert roots == slow_components(list(range(len(prints))), prints)


def test_pairs_within_the_radius_meet_in_a_leaf():
    rng = random.Random(4)
    prints = near(rng, 3000, 200)
    x = np.array(prints, np.uint64)
    leaves, copies = {}, 0
    for block, mask in enumerate(simhash.masks()):
        tree = simhash.grow(x[rng.sample(range(3000), 600)], mask, 1, 20, iter(range(10**6)))
        assert not isinstance(tree, int)
        for leaf, own in simhash.visited(x, tree, mask, 1):
            copies += len(own)
            for p in own.tolist():
                leaves.setdefault(p, set()).add((block, leaf))
    assert copies < 3 * 3000 * 8
    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                assert leaves[a] & leaves[b]


def test_the_registered_query_divides_its_trees(spark):
    prints = simhash.fingerprints(queries.table(spark, "/root/testdata/sf0.1", "documents")).select("fp").distinct()
    assert all(not isinstance(tree, int) for tree in simhash.trees(prints))


def test_divided_shards_lose_no_link(spark):
    prints = near(random.Random(9), 700)
    rows = [(int(np.array(p, np.uint64).view(np.int64)),) for p in prints]
    df = spark.createDataFrame(rows, "fp long")
    for cap, sample in ((20_000, 1 << 16), (3, 1 << 16), (3, 100)):
        groups = {r.node: r.root for r in components(simhash.links(df, cap, sample)).collect()}
        roots = [groups.get(r[0], r[0]) for r in rows]
        first = {}
        assert [first.setdefault(x, i) for i, x in enumerate(roots)] == slow_components(list(range(len(prints))), prints)


def test_components_of_a_long_path(spark):
    edges = spark.range(200).selectExpr("id AS u", "id + 1 AS v").unionByName(spark.createDataFrame([(500, 501), (501, 500), (7, 7)], "u long, v long"))
    for tasks in (1_000_000, 60):  # contracted in one task, and by star rounds over several
        got = {r.node: r.root for r in components(edges, tasks).collect()}
        assert all(got[i] == 0 for i in range(201)) and got[501] == got[500] == 500 and len(got) == 203


def test_edge_cases(spark):
    rows = [(5, None), (3, ""), (None, "  "), (9, "a b c d e"), (9, "a b c d e"), (None, "z y x w v u t"), (11, "m " * 40_000), (2, "A B C D E")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' AS fp", "1 AS component_id")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (None, 3), (9, 2), (9, 2), (None, None), (11, 11), (2, 2)], key=str)
    kept = simhash.representatives(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 2, None, 11], key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0 == simhash.representatives(empty).count()


def test_smallest_scale_runs(spark):
    assert queries.op9_simhash(spark, DATA).count() == queries.table(spark, DATA, "documents").count()
