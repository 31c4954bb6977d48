"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

Features are DataFrame expressions over the address alone: lengths, depth, shares of digits and of marks,
character entropy, parameter counts and statistics over all rows of the host's suffix and the file's.  The trees are
trained by Spark ML from at most ``SAMPLE`` different labelled feature rows of each class (those with the least hash, a
documented bound on the fit only), weighted so that each class and each repeated row counts as in the whole table, and then
written out as one column expression, so every row is scored inside code generation.

Where no labelled table is given, the rows that a rule decides train the trees.  Such rules name host suffixes, so
statistics of the host's suffix would only repeat them for hosts without a rule: the trees then go without
``HOST_SUFFIX``.

Defined results: a null address, or one without ``://``, has an empty host and path and the features of an
empty text; without labelled rows, or with one class of them, the verdict is ``allow`` or that class; equal
rows get equal verdicts; an empty table gives an empty result; only id and address are read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import broadcast_if_small, materialize

SAMPLE = 10_000
TREES = 12
DEPTH = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "digits", "hyphens", "marks", "entropy",
    "parameters", "query_length", "longest_label", "extension_length", "extension_share", "suffix_length", "suffix_share",
)
HOST_SUFFIX = ("suffix_length", "suffix_share")


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z in lower case), path and query, each a text; empty where absent."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    after = F.regexp_extract(text, r"(?s)\A.*?://(.*)\z", 1)  # empty without a match
    host = F.translate(F.regexp_extract(after, r"(?s)\A([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(after, r"(?s)\A[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(after, r"(?s)\A[^?#]*\?([^#]*)", 1)
    return host, path, query


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits.

    A rule is ``host/path``; it fits its host and all subdomains if the path starts with ``/path``.  The rules
    are a parameter, tried from the longest to the shortest.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own_host, _, own_path = text.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith("/" + own_path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _share(text: Column, pattern: str) -> Column:
    n = F.length(text)
    return F.when(n == 0, F.lit(0.0)).otherwise((n - F.length(F.regexp_replace(text, pattern, ""))) / n)


def _entropy(text: Column) -> Column:
    """Bits per character of the text's own distribution, over its at most 128 distinct ASCII characters."""
    n = F.length(text).cast("double")
    chars = F.array_distinct(F.split(F.regexp_replace(text, r"[^\x00-\x7f]", "~"), "(?!^)"))
    plain = F.regexp_replace(text, r"[^\x00-\x7f]", "~")
    bits = F.aggregate(chars, F.lit(0.0), lambda acc, c: acc - _plogp((n - F.length(F.replace(plain, c, F.lit("")))) / n))
    return F.when(n == 0, F.lit(0.0)).otherwise(bits)


def _plogp(p: Column) -> Column:
    return F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0))


def features(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """``urls`` (of a few columns) with host, path, suffix and the feature columns."""
    text = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    host, path, query = split_url(F.col(url_col))
    df = urls.withColumns({"__text": text, "host": host, "path": path, "__query": query})
    labels = F.split("host", r"\.")
    df = df.withColumns({
        "suffix": F.substring_index("host", ".", -1), "extension": F.regexp_extract("path", r"\.([A-Za-z0-9]+)\z", 1),
        "url_length": F.length("__text"), "host_length": F.length("host"), "path_length": F.length("path"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")),
        "labels": F.size(labels), "digits": _share(F.col("__text"), "[0-9]"),
        "hyphens": F.length("host") - F.length(F.replace(F.col("host"), F.lit("-"), F.lit(""))),
        "marks": _share(F.col("__text"), "[^A-Za-z0-9]"), "entropy": _entropy(F.col("__text")),
        "parameters": F.size(F.filter(F.split("__query", "&"), lambda x: x != "")), "query_length": F.length("__query"),
        "longest_label": F.array_max(F.transform(labels, F.length)),
    }).drop("__text", "__query")
    return df.withColumns({"suffix_length": F.length("suffix"), "extension_length": F.length("extension")})


def with_suffix_share(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds ``suffix_share`` and ``extension_share``, the shares of all rows; ``stats(kind, s, share)``."""
    for kind in ("suffix", "extension"):
        own = stats.where(F.col("kind") == kind).select(F.col("s").alias("__s"), F.col("share").alias(f"{kind}_share"))
        df = df.join(own, df[kind] == own["__s"], "left").drop("__s")
        df = df.withColumn(f"{kind}_share", F.coalesce(f"{kind}_share", F.lit(0.0)))
    return df.withColumns({f: F.col(f).cast("double") for f in FEATURES})


def suffix_stats(df: DataFrame) -> DataFrame:
    """Share of all rows for each suffix of a host and of a file, by one map-side combined count."""
    kinds = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("s")) for k in ("suffix", "extension")]))
    counts = materialize(df.select(kinds).groupBy("kind", "s").agg(F.count("*").alias("c")), "suffixes")
    total = counts.where("kind = 'suffix'").agg(F.sum("c")).first()[0] or 1
    return broadcast_if_small(counts.select("kind", "s", (F.col("c") / F.lit(total)).alias("share")))


def _tree_expression(text: str, use: Sequence[str] = FEATURES) -> Column:
    """A column from the printed form of one regression tree."""
    lines = [x.strip() for x in text.strip().splitlines()]

    def node(i: int) -> tuple[Column, int]:
        if m := re.match(r"Predict: (\S+)", lines[i]):
            return F.lit(float(m[1])), i + 1
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", lines[i])
        low, j = node(i + 1)
        high, k = node(j + 1)  # after the line that says Else
        return F.when(F.col(use[int(m[1])]) <= float(m[2]), low).otherwise(high), k

    return node(0)[0]


def training_rows(labelled: DataFrame, sample: int = SAMPLE, use: Sequence[str] = FEATURES) -> DataFrame:
    """At most ``sample`` different rows of features for each label, with weights that add up to all rows of the label."""
    rows = materialize(labelled.groupBy(*use, "label").agg(F.count("*").alias("n")), "labelled")
    order = F.xxhash64(*use)
    each = [rows.where(F.col("label") == v).orderBy(order, *use).limit(sample) for v in (0.0, 1.0)]
    fit = materialize(each[0].unionByName(each[1]), "sample")
    total = rows.groupBy("label").agg(F.sum("n").alias("total"))
    held = fit.groupBy("label").agg(F.sum("n").alias("held"))
    # two rows at most
    scale = F.broadcast(total.join(held, "label").select("label", (F.col("total") / F.col("held")).alias("scale")))
    return materialize(fit.join(scale, "label").select(*use, "label", (F.col("n") * F.col("scale")).alias("weight")), "weighted")


def train(labelled: DataFrame, sample: int = SAMPLE, use: Sequence[str] = FEATURES) -> Column:
    """Column that is true where the trees say block; ``labelled`` has the features and ``label`` 0 or 1."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    fit = training_rows(labelled, sample, use)
    seen = {r[0] for r in fit.select("label").distinct().collect()}
    if len(seen) < 2:
        return F.lit(seen == {1.0})
    fit = VectorAssembler(inputCols=list(use), outputCol="x").transform(fit).select("x", "label", "weight").coalesce(1)
    model = GBTClassifier(featuresCol="x", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, maxBins=64, seed=7).fit(fit)
    score = F.lit(0.0)
    for tree, weight in zip(model.trees, model.treeWeights):
        body = tree.toDebugString.split("\n", 1)[1]
        score = score + _tree_expression(body, use) * F.lit(float(weight))
    return score > 0


def judged(
    pages: DataFrame, rules: Sequence[tuple[str, str]], labelled: DataFrame | None = None, *,
    id_col: str = "page_id", url_col: str = "url", sample: int = SAMPLE,
) -> DataFrame:
    """``(id, host, path, rule, verdict)`` for every row.

    ``labelled(url, label)`` trains the trees; without it the rows that a rule decides do.
    """
    base = features(pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url")), "__url")
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    stats = suffix_stats(base)
    base = with_suffix_share(base.withColumns({"rule": rule, "__says": says}), stats)
    use = FEATURES
    if labelled is None:
        use = tuple(f for f in FEATURES if f not in HOST_SUFFIX)
        known = base.where("__says IS NOT NULL").withColumn("label", (F.col("__says") == "block").cast("double"))
    else:
        known = with_suffix_share(features(labelled.select(F.col("url").alias("__url"), F.col("label").cast("double")), "__url"), stats)
    block = train(known, sample, use)
    verdict = F.coalesce("__says", F.when(block, F.lit("block")).otherwise(F.lit("allow")))
    return base.select(F.col("__id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))
