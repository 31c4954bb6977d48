"""Metrics, quantiles, spread and planning queries.

The target is ``labels.quality``; scores are hashes of the id, so both engines compute the same ones.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import metrics, planning, stats, windows
from tallyloom.plans.integrity import docs
from tallyloom.plans.registry import query, table

DIGITS = 9
RESAMPLES = 40
BOOT_SEED = 2026


def _score(col: str, seed: str, step: int = 1):
    n = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), F.col(col).cast("string")), 256), 1, 6), 16, 10).cast("long")
    return (F.floor(n / F.lit(step)) if step > 1 else n).cast("double")


def _score_sql(col: str, seed: str, step: int = 1) -> str:
    n = f"('0x' || substr(sha256('{seed}|' || {col}::VARCHAR), 1, 6))::BIGINT"
    return f"({n} // {step})::DOUBLE" if step > 1 else f"{n}::DOUBLE"


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


def scored(spark, d, step: int = 1) -> DataFrame:
    rows = table(spark, d, "labels").join(docs(spark, d).select("doc_id", "lang", "source"), "doc_id")
    return rows.select("doc_id", "lang", "source", F.col("quality").alias("label"), _score("doc_id", "2026", step).alias("score"), _score("doc_id", "7", step).alias("score_b"))


def scored_sql(step: int = 1) -> str:
    return f"SELECT doc_id, lang, source, quality AS label, {_score_sql('doc_id', '2026', step)} AS score, {_score_sql('doc_id', '7', step)} AS score_b FROM labels JOIN documents USING (doc_id)"


def points_sql(counts: str, by: str) -> str:
    """CTEs from ``c(by, score, pos, neg)`` to ``pt``, one row per point and the point before it."""
    return f"""c AS ({counts}),
r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY {by}) AS p, sum(neg) OVER (PARTITION BY {by}) AS n,
  lag(score) OVER (PARTITION BY {by} ORDER BY score DESC) AS s0 FROM c WHERE pos + neg > 0 WINDOW w AS (PARTITION BY {by} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
pt AS (SELECT {by}, score, pos, neg, tp, fp, p, n, fp::DOUBLE / n AS far, (p - tp)::DOUBLE / p AS frr, coalesce(s0, nextafter(score, 'inf'::DOUBLE)) AS score0,
  (fp - neg)::DOUBLE / n AS far0, (p - tp + pos)::DOUBLE / p AS frr0 FROM r WHERE p > 0 AND n > 0)"""


def eer_sql(by: str) -> str:
    """CTEs from ``pt`` to ``e(by, eer, threshold, far, frr, positives, negatives)``."""
    return f"""cand AS (
  SELECT {by}, 0 AS pass, score, score AS threshold, far, frr, p, n FROM pt WHERE abs(far - frr) <= greatest(1e-9::DOUBLE * greatest(far, frr), 1e-15::DOUBLE)
  UNION ALL
  SELECT {by}, 1, score, score0 + w * (score - score0), far0 + w * (far - far0), frr0 + w * (frr - frr0), p, n FROM (
    SELECT *, CASE WHEN (far - frr) - (far0 - frr0) = 0 THEN 0 ELSE -(far0 - frr0) / ((far - frr) - (far0 - frr0)) END AS w FROM pt WHERE far0 - frr0 <= 0 AND far - frr >= 0)),
e AS (SELECT {by}, (far + frr) / 2 AS eer, threshold, far, frr, p::BIGINT AS positives, n::BIGINT AS negatives FROM cand
  QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY pass, score DESC) = 1)"""


COUNTS = "SELECT 0 AS g, score, sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg FROM s GROUP BY score"
BASE = f"WITH s AS ({scored_sql()}), {points_sql(COUNTS, 'g')}"
TIED = f"WITH s AS ({scored_sql(500000)}), {points_sql(COUNTS, 'g')}"
_E = "round(eer, 9) AS eer, round(threshold, 9) AS threshold, round(far, 9) AS far, round(frr, 9) AS frr, positives, negatives"


@query("eer", f"{BASE}, {eer_sql('g')} SELECT {_E} FROM e")
def eer(spark, d):
    return _round(metrics.eer(scored(spark, d), "label", "score"), "eer", "threshold", "far", "frr")


@query("eer_with_ties", f"{TIED}, {eer_sql('g')} SELECT {_E} FROM e")
def eer_with_ties(spark, d):
    return _round(metrics.eer(scored(spark, d, 500000), "label", "score"), "eer", "threshold", "far", "frr")


@query("roc_points", f"{TIED} SELECT score, tp::BIGINT AS tp, fp::BIGINT AS fp, round(far, 9) AS far, round(frr, 9) AS frr FROM pt")
def roc_points(spark, d):
    points = metrics.roc_points(metrics.score_counts(scored(spark, d, 500000), [], "label", "score"))
    return _round(points.select("score", "tp", "fp", "far", "frr"), "far", "frr")


@query("roc_auc", f"""
WITH s AS ({scored_sql(500000)}), r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rk FROM s)
SELECT round((sum(rk) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label))::DOUBLE, 9) AS roc_auc FROM r""")
def roc_auc(spark, d):
    points = metrics.roc_points(metrics.score_counts(scored(spark, d, 500000), [], "label", "score"))
    return _round(metrics.roc_auc(points), "roc_auc")


CONFUSION_SQL = """count(*) FILTER (label = 0 AND score < {t})::BIGINT AS tn, count(*) FILTER (label = 0 AND score >= {t})::BIGINT AS fp,
  count(*) FILTER (label = 1 AND score < {t})::BIGINT AS fn, count(*) FILTER (label = 1 AND score >= {t})::BIGINT AS tp"""
RATES_SQL = """round(fp / nullif(fp + tn, 0)::DOUBLE, 9) AS fpr, round(fn / nullif(fn + tp, 0)::DOUBLE, 9) AS fnr,
  round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0)::DOUBLE, 0)) / 2, 9) AS macro_f1"""


@query("confusion", f"WITH s AS ({scored_sql()}), c AS (SELECT lang, {CONFUSION_SQL.format(t=8e6)} FROM s GROUP BY lang) SELECT *, {RATES_SQL} FROM c")
def confusion(spark, d):
    return _round(metrics.confusion(scored(spark, d), "label", "score", F.lit(8e6), ["lang"]), "fpr", "fnr", "macro_f1")


@query("macro_f1", f"WITH s AS ({scored_sql()}), c AS (SELECT {CONFUSION_SQL.format(t=4e6)} FROM s), r AS (SELECT {RATES_SQL} FROM c) SELECT macro_f1 FROM r")
def macro_f1(spark, d):
    return _round(metrics.confusion(scored(spark, d), "label", "score", F.lit(4e6)).select("macro_f1"), "macro_f1")


CATEGORY_COUNTS = """SELECT k.category, score, sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg
  FROM (SELECT DISTINCT lang AS category FROM s WHERE lang <> 'en') k JOIN s ON s.lang = k.category OR s.lang = 'en' GROUP BY ALL"""


@query("per_category_eer", f"WITH s AS (SELECT doc_id, lang, (lang <> 'en')::INT AS label, {_score_sql('doc_id', '2026')} AS score FROM documents), {points_sql(CATEGORY_COUNTS, 'category')}, {eer_sql('category')} SELECT category, {_E} FROM e")
def per_category_eer(spark, d):
    df = docs(spark, d).select("doc_id", "lang", stats.target(F.col("lang"), "en").alias("label"), _score("doc_id", "2026").alias("score"))
    return _round(metrics.per_category_eer(df, label="label", score="score", category="lang", negative="en"), "eer", "threshold", "far", "frr")


@query("evaluation_bundle", f"""{BASE}, {eer_sql('g')},
a AS (SELECT sum(pos * (n - fp + neg / 2.0::DOUBLE)) / (max(p) * max(n))::DOUBLE AS auc FROM pt),
k AS (SELECT e.eer, e.threshold, s.* FROM s, e), cm AS (SELECT eer, threshold, {CONFUSION_SQL.format(t='threshold')} FROM k GROUP BY ALL)
SELECT round(eer, 9) AS eer, round(threshold, 9) AS threshold, round(auc, 9) AS roc_auc, tn, fp, fn, tp, {RATES_SQL} FROM cm, a""")
def evaluation_bundle(spark, d):
    return _round(metrics.evaluation(scored(spark, d), "label", "score"), "eer", "threshold", "roc_auc", "fpr", "fnr", "macro_f1")


@query("evaluation_at_threshold", f"""{BASE}, {eer_sql('g')},
a AS (SELECT sum(pos * (n - fp + neg / 2.0::DOUBLE)) / (max(p) * max(n))::DOUBLE AS auc FROM pt), cm AS (SELECT {CONFUSION_SQL.format(t='5000000')} FROM s)
SELECT round(eer, 9) AS eer, 5000000::DOUBLE AS threshold, round(auc, 9) AS roc_auc, tn, fp, fn, tp, {RATES_SQL} FROM cm, a, e""")
def evaluation_at_threshold(spark, d):
    return _round(metrics.evaluation(scored(spark, d), "label", "score", 5e6), "eer", "threshold", "roc_auc", "fpr", "fnr", "macro_f1")


def _weights_sql() -> str:
    """The bootstrap's draws over the 20 sources as literal rows."""
    names, rng, rows = sorted(f"src{i}" for i in range(20)), np.random.default_rng(BOOT_SEED), []
    for r in range(RESAMPLES):
        m = np.bincount(rng.integers(0, len(names), size=len(names)), minlength=len(names))
        rows += [f"({r}, '{names[i]}', {m[i]})" for i in np.flatnonzero(m)]
    return f"(VALUES {', '.join(rows)}) AS t(resample, source, m)"


def _boot_sql(score: str) -> str:
    return f"SELECT resample, {score} AS score, sum(label * m)::BIGINT AS pos, sum((1 - label) * m)::BIGINT AS neg FROM s JOIN w USING (source) GROUP BY ALL"


W_SQL = f"WITH s AS ({scored_sql()}), w AS (SELECT * FROM {_weights_sql()})"


@query("cluster_bootstrap_eer", f"""{W_SQL}, {points_sql(_boot_sql('score'), 'resample')}, {eer_sql('resample')},
u AS (SELECT resample, sum(pos * (n - fp + neg / 2.0::DOUBLE)) / (max(p) * max(n))::DOUBLE AS auc FROM pt GROUP BY resample),
q AS (SELECT count(*) AS valid_resamples, quantile_cont(eer, [0.025, 0.975]) AS a, quantile_cont(auc, [0.025, 0.975]) AS b FROM e JOIN u USING (resample)),
one AS ({BASE}, {eer_sql('g')} SELECT eer, (SELECT sum(pos * (n - fp + neg / 2.0::DOUBLE)) / (max(p) * max(n))::DOUBLE FROM pt) AS auc FROM e)
SELECT round(eer, 9) AS eer, round(a[1], 9) AS eer_low, round(a[2], 9) AS eer_high, round(auc, 9) AS roc_auc, round(b[1], 9) AS roc_auc_low, round(b[2], 9) AS roc_auc_high, valid_resamples FROM one, q""")
def cluster_bootstrap_eer(spark, d):
    df = scored(spark, d)
    w = metrics.bootstrap_weights(df, "source", RESAMPLES, BOOT_SEED)
    out = metrics.cluster_bootstrap(df, label="label", score="score", cluster="source", weights=w)
    return _round(out, "eer", "eer_low", "eer_high", "roc_auc", "roc_auc_low", "roc_auc_high")


PAIRED_SQL = f"""
WITH ea AS ({W_SQL}, {points_sql(_boot_sql('score'), 'resample')}, {eer_sql('resample')} SELECT * FROM e),
eb AS ({W_SQL}, {points_sql(_boot_sql('score_b'), 'resample')}, {eer_sql('resample')} SELECT * FROM e),
oa AS ({BASE}, {eer_sql('g')} SELECT eer FROM e),
ob AS (WITH s AS ({scored_sql()}), {points_sql(COUNTS.replace('score,', 'score_b AS score,').replace('BY score', 'BY score_b'), 'g')}, {eer_sql('g')} SELECT eer FROM e),
dd AS (SELECT ea.eer - eb.eer AS d FROM ea JOIN eb USING (resample))
SELECT round((SELECT eer FROM oa) - (SELECT eer FROM ob), 9) AS difference, round(quantile_cont(d, 0.025), 9) AS low, round(quantile_cont(d, 0.975), 9) AS high,
  round(avg((d < 0)::INT::DOUBLE), 9) AS fraction_a_lower, count(*) AS valid_resamples FROM dd"""


@query("paired_bootstrap", PAIRED_SQL)
def paired_bootstrap(spark, d):
    df = scored(spark, d)
    w = metrics.bootstrap_weights(df, "source", RESAMPLES, BOOT_SEED)
    out = metrics.paired_bootstrap(df, label="label", score_a="score", score_b="score_b", cluster="source", weights=w)
    return _round(out, "difference", "low", "high", "fraction_a_lower")


@query("score_pair_compare", f"""
WITH s AS ({scored_sql()}) SELECT lang, count(*) AS rows, max(abs(score - score_b)) AS max_difference, quantile_cont(abs(score - score_b), 0.5) AS median_difference,
  count(*) FILTER (abs(score - score_b) > 1000) AS changed, count(*) FILTER ((score >= 8000000) <> (score_b >= 8000000)) AS flipped FROM s GROUP BY lang""")
def score_pair_compare(spark, d):
    return metrics.compare_scores(scored(spark, d), "score", "score_b", 8e6, ["lang"], 1000.0)


@query("score_effect", f"""
SELECT x.*, y.difference AS eer_difference, y.low AS eer_low, y.high AS eer_high, y.fraction_a_lower, y.valid_resamples FROM (
  WITH s AS ({scored_sql()}) SELECT count(*) AS rows, max(abs(score - score_b)) AS max_difference, quantile_cont(abs(score - score_b), 0.5) AS median_difference,
    count(*) FILTER (abs(score - score_b) > 1000) AS changed, count(*) FILTER ((score >= 8000000) <> (score_b >= 8000000)) AS flipped FROM s) x
CROSS JOIN ({PAIRED_SQL}) y""")
def score_effect(spark, d):
    df = scored(spark, d)
    w = metrics.bootstrap_weights(df, "source", RESAMPLES, BOOT_SEED)
    out = metrics.score_effect(df, label="label", score_a="score", score_b="score_b", threshold=8e6, cluster="source", weights=w, tolerance=1000.0)
    return _round(out, "eer_difference", "eer_low", "eer_high", "fraction_a_lower")


@query("bce_loss", f"""
WITH s AS (SELECT label, (score - 8000000) / 2000000::DOUBLE AS x FROM ({scored_sql()}))
SELECT round(avg(greatest(x, 0) - x * label + ln(1 + exp(-abs(x)))), 9) AS loss, round(avg(1 / (1 + exp(-x))), 9) AS mean_score FROM s""")
def bce_loss(spark, d):
    from tallyloom.functions.arrays import sigmoid

    x = scored(spark, d).withColumn("x", (F.col("score") - 8e6) / 2e6)
    return x.agg(F.round(metrics.bce_loss(F.col("x"), F.col("label")), 9).alias("loss"), F.round(F.avg(sigmoid(F.col("x"))), 9).alias("mean_score"))


@query("average_rank", f"""
WITH s AS ({scored_sql(500000)}) SELECT lang, doc_id, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0::DOUBLE AS avg_rank FROM s""")
def average_rank(spark, d):
    return windows.average_rank(scored(spark, d, 500000), ["lang"], "score").select("lang", "doc_id", "avg_rank")


@query("invalid_metric_rows", f"SELECT doc_id FROM ({scored_sql()}) WHERE doc_id % 21 = 0 OR doc_id % 25 = 0")
def invalid_metric_rows(spark, d):
    label = F.when(F.col("doc_id") % 42 == 0, 2.0).when(F.col("doc_id") % 21 == 0, 0.6).otherwise(F.col("label"))
    df = scored(spark, d).withColumn("label", label)
    df = df.withColumn("score", F.when(F.col("doc_id") % 25 == 0, float("nan")).otherwise(F.col("score")))
    return metrics.invalid_rows(df, "label", "score").select("doc_id")


@query("linear_quantiles", """
SELECT event_type, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.95) AS p95, min(value) AS low, max(value) AS high FROM events GROUP BY event_type""")
def linear_quantiles(spark, d):
    found = stats.linear_quantiles(table(spark, d, "events"), "value", {"median": 0.5, "p95": 0.95, "low": 0.0, "high": 1.0}, ["event_type"])
    return found.select("event_type", "median", "p95", "low", "high")


@query("nearest_rank_p95", """
SELECT event_type, value, n FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)
WHERE rn = ceil(0.95::DOUBLE * n)""")
def nearest_rank_p95(spark, d):
    return stats.nearest_rank(table(spark, d, "events"), "value", 0.95, ["event_type"])


@query("cv_pop_vs_sample", """
SELECT o_orderpriority, round(stddev_pop(o_totalprice) / avg(o_totalprice), 9) AS cv_ratio, round(100 * stddev_samp(o_totalprice) / avg(o_totalprice), 9) AS cv_percent FROM orders GROUP BY 1""")
def cv_pop_vs_sample(spark, d):
    g = table(spark, d, "orders").groupBy("o_orderpriority")
    return g.agg(F.round(stats.cv_population("o_totalprice"), 9).alias("cv_ratio"), F.round(stats.cv_sample_percent("o_totalprice"), 9).alias("cv_percent"))


@query("throughputs", """
SELECT l_returnflag, round(sum(l_quantity) / sum(l_extendedprice), 9) AS pooled, round(quantile_cont(l_quantity / l_extendedprice, 0.5), 9) AS median, max(l_extendedprice) AS worst FROM lineitem GROUP BY 1""")
def throughputs(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(stats.pooled_throughput("l_quantity", "l_extendedprice"), 9).alias("pooled"), F.round(stats.median_throughput("l_quantity", "l_extendedprice"), 9).alias("median"),
        stats.conservative_cost("l_extendedprice").alias("worst"),
    )


@query("duration_stats", """
WITH s AS (SELECT lang AS category, n_chars / 16::DOUBLE AS s FROM documents)
SELECT category, count(*) AS rows, min(s) AS min_seconds, quantile_cont(s, 0.5) AS median_seconds, round(avg(s), 6) AS mean_seconds, round(quantile_cont(s, 0.95), 6) AS p95_seconds, max(s) AS max_seconds, round(sum(s) / 3600, 6) AS total_hours
FROM s GROUP BY category""")
def duration_stats(spark, d):
    out = stats.duration_stats(docs(spark, d), "lang", F.col("n_chars"), F.lit(16))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_seconds", "p95_seconds", "total_hours")})


@query("runtime_projection", """
SELECT lang, round(count(*) / 0.871::DOUBLE * 1.15::DOUBLE, 6) AS seconds, ceil(count(*) / 8.0::DOUBLE)::BIGINT AS steps,
  CASE WHEN count(*) % 8 = 0 THEN 8 ELSE count(*) % 8 END AS last_batch, round(3 * (ceil(count(*) / 8.0::DOUBLE) * 1.5::DOUBLE + 100 * 0.05::DOUBLE), 6) AS total_seconds FROM documents GROUP BY lang""")
def runtime_projection(spark, d):
    n = docs(spark, d).groupBy("lang").agg(F.count("*").alias("n"))
    b = planning.training_budget(F.col("n"), 8, 3, 1.5, 100, 0.05)
    out = n.select("lang", F.round(planning.runtime_projection(F.col("n"), F.lit(0.871), 0.15), 6).alias("seconds"), b.alias("b"))
    return out.select("lang", "seconds", "b.steps", F.col("b.last_batch").cast("long").alias("last_batch"), F.round("b.seconds", 6).alias("total_seconds"))


@query("storage_projection", """
SELECT t::INT AS target, round(sum(n_chars) / count(*)::DOUBLE, 6) AS bytes_per_row, round(sum(n_chars) / count(*)::DOUBLE * t, 6) AS bytes FROM documents, (SELECT unnest([1000, 20000, 220963]) AS t) GROUP BY t""")
def storage_projection(spark, d):
    out = planning.storage_projection(docs(spark, d), "n_chars", [1000, 20000, 220963])
    return out.withColumns({"bytes_per_row": F.round("bytes_per_row", 6), "bytes": F.round("bytes", 6)}).select("target", "bytes_per_row", "bytes")


@query("step_budget", """
SELECT l_returnflag, max(l_quantity) AS worst_seconds, count(*) AS repeats, min(l_linestatus) = max(l_linestatus) AS same_run,
  round(stddev_pop(l_quantity) / avg(l_quantity), 9) AS cv, (floor(100000 / max(l_quantity) / 64) * 64)::BIGINT AS steps FROM lineitem GROUP BY 1""")
def step_budget(spark, d):
    out = planning.step_budget(table(spark, d, "lineitem"), by=["l_returnflag"], seconds="l_quantity", identity="l_linestatus", budget_seconds=100000.0, multiple=64)
    return _round(out, "cv")


@query("ab_gate", """
WITH r AS (SELECT event_type, value / (1 + user_id % 7)::DOUBLE AS t, user_id AS m FROM events WHERE event_type IN ('click', 'view')),
s AS (SELECT quantile_cont(t, 0.5) FILTER (event_type = 'click') AS ta, 100 * stddev_samp(t) FILTER (event_type = 'click') / avg(t) FILTER (event_type = 'click') AS ca, max(m) FILTER (event_type = 'click') AS ma,
  quantile_cont(t, 0.5) FILTER (event_type = 'view') AS tb, 100 * stddev_samp(t) FILTER (event_type = 'view') / avg(t) FILTER (event_type = 'view') AS cb, max(m) FILTER (event_type = 'view') AS mb FROM r)
SELECT round(100 * (tb / ta - 1), 6) AS gain_percent, round(ca, 6) AS a_cv, round(cb, 6) AS b_cv, 100 * (tb / ta - 1) >= 15 AS fast_enough, ca <= 15 AND cb <= 15 AS stable,
  mb - ma <= 256 AS small_enough, 100 * (tb / ta - 1) >= 15 AND ca <= 15 AND cb <= 15 AND mb - ma <= 256 AS accepted FROM s""")
def ab_gate(spark, d):
    runs = table(spark, d, "events").where("event_type IN ('click', 'view')").withColumn("seconds", (1 + F.col("user_id") % 7).cast("double"))
    out = planning.ab_gate(runs, variant="event_type", baseline="click", candidate="view", items="value", seconds="seconds", memory="user_id")
    out = out.withColumns({"gain_percent": F.round("gain_percent", 6), "a_cv": F.round("a_cv", 6), "b_cv": F.round("b_cv", 6)})
    return out.select("gain_percent", "a_cv", "b_cv", "fast_enough", "stable", "small_enough", "accepted")


@query("expected_queries", "SELECT count(DISTINCT (doc_id // 8, doc_id % 5)) AS queries FROM documents")
def expected_queries(spark, d):
    df = docs(spark, d).select(F.floor(F.col("doc_id") / 8).alias("b"), (F.col("doc_id") % 5).alias("s"))
    return planning.expected_queries(df, "b", "s")


@query("ingest_actions", """
SELECT doc_id % 32 AS shard, CASE WHEN doc_id % 32 < 10 THEN 'skip' WHEN doc_id % 32 < 20 THEN 'ingest' ELSE 'download' END AS action, count(*) AS rows FROM documents GROUP BY ALL""")
def ingest_actions(spark, d):
    plan = docs(spark, d).groupBy((F.col("doc_id") % 32).alias("shard")).agg(F.count("*").alias("rows"))
    plan = plan.withColumns({"has_marker": F.col("shard") < 10, "has_file": F.when(F.col("shard") < 20, F.lit(True))})
    return planning.ingest_actions(plan).select("shard", "action", "rows")


@query("improvement_percent", """
SELECT o_orderpriority, round(100 * (sum(o_totalprice) FILTER (o_orderstatus = 'O') - sum(o_totalprice) FILTER (o_orderstatus = 'F')) / sum(o_totalprice) FILTER (o_orderstatus = 'O'), 6) AS percent FROM orders GROUP BY 1""")
def improvement_percent(spark, d):
    g = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["O", "F"]).agg(F.sum("o_totalprice"))
    return g.select("o_orderpriority", F.round(planning.change_percent(F.col("O"), F.col("F")), 6).alias("percent"))
