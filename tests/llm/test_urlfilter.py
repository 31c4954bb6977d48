"""URL filter: parsing and rules against loops, features, held-out accuracy, edge cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import queries, urlfilter

URLS = [
    None, "", "no scheme/en/", "http://", "https://A.Example.ORG/es/1?x=/y#z", "http://example.org/en/12", "http://notexample.org/en/12", "http://www.example.com/fr/x",
    "http://x.com/de/", "http://x.com", "ftp://u@h.net:80/a//b/?q&r=1&=", "http://a.net?x://b.org/", "http://b.org#/en/1", "x://y://z.org/es", "http://É.ORG/Q", "http://org/\nes",
]


def slow(url):
    _, sep, rest = (url or "").partition("://")
    rest = rest if sep else ""
    cut = min([len(rest), *(rest.index(c) for c in "/?#" if c in rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([len(tail), *(tail.index(c) for c in "?#" if c in tail)])]
    best = None
    for rule, says in queries.URL_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, says
    return host, path, best


def test_rules_equal_loop(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    for r in urlfilter.judged(df, queries.URL_RULES).collect():
        host, path, best = slow(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[0])
        assert r.verdict == best[1] if best else r.verdict in ("allow", "block")


def test_table_equals_loop(spark):
    path = "/root/testdata/sf0.01"
    urls = {r.page_id: r.url for r in queries.table(spark, path, "pages").collect()}
    for r in queries.op10_url_filter(spark, path).collect():
        host, p, best = slow(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, p, best and best[0]) and (best is None or r.verdict == best[1])


def test_features(spark):
    url = "https://free-bets.win-9.example.com/a/b1/?x=1&y=22#f"
    r = urlfilter.features(spark.createDataFrame([(url,)], "url string")).first()
    assert (r.host, r.path, r.suffix) == ("free-bets.win-9.example.com", "/a/b1/", "com")
    assert (r.url_length, r.depth, r.labels, r.hyphens, r.parameters, r.query_length, r.longest_label) == (len(url), 2, 4, 2, 2, 8, 9)
    assert r.digits == pytest.approx(sum(c.isdigit() for c in url) / len(url))
    assert r.entropy == pytest.approx(-sum(url.count(c) / len(url) * math.log2(url.count(c) / len(url)) for c in set(url)))


def address(rng, spam):
    word = lambda a, b: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(a, b)))
    if spam:
        return f"http://{word(3, 6)}-{word(3, 6)}-{rng.randrange(99)}.example.com/{rng.randrange(10**7)}?" + "&".join(f"{word(1, 3)}={rng.randrange(10**5)}" for _ in range(rng.randrange(2, 6)))
    return f"https://www.{word(6, 10)}.example.net/{word(3, 8)}/{word(3, 8)}"


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    make = lambda n: [(address(rng, i % 2 == 0), float(i % 2 == 0)) for i in range(n)]
    train = spark.createDataFrame(make(400), "url string, label double")
    test = make(300)
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(test)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlfilter.judged(pages, [], train).collect()}
    assert sum((got[i] == "block") == bool(y) for i, (_, y) in enumerate(test)) / len(test) > 0.95


def test_host_suffixes_of_rules_are_no_feature(spark):
    """Rules label org and com; a rare suffix of the same letters gets the verdict of a frequent one."""
    rng = random.Random(4)
    rows = [address(rng, False).replace("example.net", f"example.{rng.choice(['org', 'com', 'net', 'net'])}") for _ in range(600)]
    twins = {u: u.replace("example.net", "example.ten") for u in rows if "example.net" in u}
    some = dict(list(twins.items())[:20])
    df = spark.createDataFrame(list(enumerate([*rows, *some.values()])), "page_id long, url string")
    got = {r.url: r.verdict for r in urlfilter.judged(df, [("org/", "allow"), ("com/", "block")]).join(df, "page_id").collect()}
    assert all(got[u] == got[v] for u, v in some.items())


def test_sample_keeps_the_weight_of_classes_and_repeats(spark):
    names = [f"cast(id AS double) AS {f}" for f in urlfilter.FEATURES]
    rows = spark.range(100).selectExpr(*names, "0D AS label").unionByName(spark.range(3).selectExpr(*names, "1D AS label"))
    rows = rows.unionByName(spark.range(900).selectExpr(*(x.replace("(id", "(7") for x in names), "0D AS label"))
    fit = urlfilter.training_rows(rows, 10).toPandas()
    assert len(fit) == 13 and fit.groupby("label").weight.sum().round(6).to_dict() == {0.0: 1000.0, 1.0: 3.0}
    assert len(fit[["url_length", "label"]].drop_duplicates()) == 13


def test_held_out_hosts_of_the_table(spark):
    """Labels are those that rules give; hosts of one fold are judged by trees that never saw them, rules aside."""
    pages = queries.table(spark, "/root/testdata/sf0.1", "pages").select("page_id", "url")
    host, path, _ = urlfilter.split_url(F.col("url"))
    rule, says = urlfilter.rule_for(host, path, queries.URL_RULES)
    known = pages.withColumns({"host": host, "label": (says == "block").cast("double")}).where("label IS NOT NULL")
    held = F.crc32("host") % 4 == 0
    use = [f for f in urlfilter.FEATURES if f not in urlfilter.HOST_SUFFIX]
    base = urlfilter.features(known.select("url", "label"), "url")
    df = urlfilter.with_suffix_share(base, urlfilter.suffix_stats(base))
    block = urlfilter.train(df.where(~held), use=use)
    r = df.where(held).agg(F.avg((block == (F.col("label") == 1)).cast("double")).alias("right"), F.avg("label").alias("blocked"), F.count("*").alias("n")).first()
    print(f"held-out hosts: {r.n} addresses, {r.right:.3f} right, {1 - r.blocked:.3f} are allowed")
    assert r.n > 100 and r.right >= 1 - r.blocked - 0.05  # rules name suffixes and languages: other features say little


def test_column_equals_the_model(spark):
    """The written-out trees give the margin that Spark ML's own model gives."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rng = random.Random(2)
    rows = spark.createDataFrame([(address(rng, i % 3 == 0), float(i % 3 == 0 or rng.random() < 0.1)) for i in range(300)], "url string, label double")
    base = urlfilter.features(rows)
    df = urlfilter.with_suffix_share(base, urlfilter.suffix_stats(base)).cache()
    x = VectorAssembler(inputCols=list(urlfilter.FEATURES), outputCol="x").transform(df)
    model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=5, maxDepth=3, seed=7).fit(x.coalesce(1))
    score = sum((urlfilter._tree_expression(t.toDebugString.split("\n", 1)[1]) * w for t, w in zip(model.trees, model.treeWeights)), F.lit(0.0))
    both = model.transform(x).select((score > 0).cast("double").alias("a"), "prediction").collect()
    assert all(r.a == r.prediction for r in both)
    df.unpersist()


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "http://a.org/"), (2, ""), (3, "http://x.net/" + "a" * 100_000)], "page_id long, url string").selectExpr("*", "'h' AS host", "1 AS depth", "2 AS label")
    out = urlfilter.judged(df, queries.URL_RULES)
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"] and out.count() == 5
    assert {r.verdict for r in out.collect()} == {"allow"}  # one class labelled
    assert {r.verdict for r in urlfilter.judged(df, []).collect()} == {"allow"}
    assert urlfilter.judged(df.limit(0), queries.URL_RULES).count() == 0


def test_no_python_on_the_main_path(spark):
    df = urlfilter.judged(queries.table(spark, "/root/testdata/sf0.001", "pages"), queries.URL_RULES)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
