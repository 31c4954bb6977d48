"""Detection metrics: error rates, EER, ROC-AUC, F1 and cluster bootstrap.

Scores are higher for positives (target 1); the decision is ``score >= threshold``.  Every metric works per
group.  Rows shrink to one per (group, score) first; running counts go by range buckets, so neither one task
nor the driver ever holds all scores.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import stats
from tallyloom.operators.windows import running_totals

#: Clusters up to which the bootstrap draws on the driver, where it keeps one index for each.
MAX_CLUSTERS = 200_000


def invalid_rows(df: DataFrame, label: str, score: str) -> DataFrame:
    """Rows that no metric accepts: a label other than 0 and 1, or a score that is null, NaN or infinite."""
    bad_label = F.col(label).isNull() | ~F.coalesce(F.col(label).cast("double").isin(0.0, 1.0), F.lit(False))
    bad_score = F.col(score).isNull() | F.isnan(score) | (F.abs(F.col(score)) == float("inf"))
    return df.where(bad_label | bad_score)


def checked(df: DataFrame, label: str, score: str) -> DataFrame:
    """The same rows; a query over them fails at the first invalid one."""
    bad = F.col(label).isNull() | ~F.coalesce(F.col(label).cast("double").isin(0.0, 1.0), F.lit(False)) | F.col(score).isNull() | F.isnan(score) | (F.abs(F.col(score)) == float("inf"))
    return df.withColumn(label, F.when(bad, F.raise_error(F.lit("label must be 0 or 1 and score finite")).cast("int")).otherwise(F.col(label).cast("int")))


def score_counts(df: DataFrame, by: Sequence[str], label: str, score: str, weight: Column | None = None) -> DataFrame:
    """``(by, score, pos, neg)``, weighted if a weight is given."""
    w = F.lit(1) if weight is None else weight
    y = F.col(label).cast("int")
    return df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(F.sum(y * w).alias("pos"), F.sum((1 - y) * w).alias("neg"))


def roc_points(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A row per distinct score from high to low: counts, rates, and those of the point before.

    The point before the first has threshold ``nextafter(score, inf)``, FAR 0 and FRR 1.  Groups with one class
    have no points.
    """
    run = running_totals(counts.where("pos + neg > 0"), by, "score", ["pos", "neg"], descending=True).where("pos_total > 0 AND neg_total > 0")
    p, n = F.col("pos_total"), F.col("neg_total")
    tp, fp = F.col("pos_upto"), F.col("neg_upto")
    first = F.expr("CAST(reflect('java.lang.Math', 'nextUp', score) AS DOUBLE)")
    return run.select(
        *by, "score", "pos", "neg", tp.alias("tp"), fp.alias("fp"), p.alias("positives"), n.alias("negatives"),
        (fp / n).alias("far"), ((p - tp) / p).alias("frr"), F.coalesce("prev_score", first).alias("score0"),
        ((fp - F.col("neg")) / n).alias("far0"), ((p - tp + F.col("pos")) / p).alias("frr0"),
    )


def equal_error_rate(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, eer, threshold, far, frr, positives, negatives)``.

    The first point (from high scores) whose rates are nearly equal wins, wherever it is; without one the rates
    are interpolated on the first segment where their difference changes sign.
    """
    far, frr = F.col("far"), F.col("frr")
    close = F.abs(far - frr) <= F.greatest(F.greatest(F.abs(far), F.abs(frr)) * 1e-9, F.lit(1e-15))
    d0, d1 = F.col("far0") - F.col("frr0"), far - frr
    cross = (d0 <= 0) & (d1 >= 0)
    w = F.when(d1 - d0 == 0, F.lit(0.0)).otherwise(-d0 / (d1 - d0))
    mix = lambda a, b: F.col(a) + w * (F.col(b) - F.col(a))
    sizes = [F.col("positives"), F.col("negatives")]
    at_point = F.struct(F.col("score").alias("threshold"), far.alias("far"), frr.alias("frr"), *sizes)
    between = F.struct(mix("score0", "score").alias("threshold"), mix("far0", "far").alias("far"), mix("frr0", "frr").alias("frr"), *sizes)
    few = points.where(close | cross).withColumns({"__close": close, "__cross": cross, "__p": at_point, "__s": between})
    best = few.groupBy(*by).agg(
        F.max_by("__p", F.when(F.col("__close"), F.col("score"))).alias("p"), F.max(F.col("__close").cast("int")).alias("c"),
        F.max_by("__s", F.when(F.col("__cross"), F.col("score"))).alias("s"),
    )
    r = best.select(*by, F.when(F.col("c") == 1, F.col("p")).otherwise(F.col("s")).alias("r")).where("r IS NOT NULL")
    return r.select(*by, ((F.col("r.far") + F.col("r.frr")) / 2.0).alias("eer"), "r.*")


def eer(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """EER of each group of scored rows."""
    return equal_error_rate(roc_points(score_counts(checked(df, label, score), by, label, score), by), by)


def roc_auc(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, roc_auc)``: the share of pairs in order, ties for half (the same as by average ranks)."""
    below = F.col("negatives") - F.col("fp")
    wins = F.sum(F.col("pos") * (below + F.col("neg") / F.lit(2.0)))
    return points.groupBy(*by).agg((wins / (F.first("positives") * F.first("negatives"))).alias("roc_auc"))


def confusion(df: DataFrame, label: str, score: str, threshold: Column, by: Sequence[str] = ()) -> DataFrame:
    """Counts at a threshold with error rates and macro F1; a rate without its class is null, an empty F1 is 0."""
    y, hit = F.col(label).cast("int") == 1, F.col(score) >= threshold
    count = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0))
    c = df.groupBy(*by).agg(count(~y & ~hit).alias("tn"), count(~y & hit).alias("fp"), count(y & ~hit).alias("fn"), count(y & hit).alias("tp"))
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    f1 = lambda t: F.coalesce(ratio(2.0 * t, 2.0 * t + fp + fn), F.lit(0.0))
    return c.withColumns({"fpr": ratio(fp, fp + tn), "fnr": ratio(fn, fn + tp), "macro_f1": (f1(tp) + f1(tn)) / 2.0})


def per_category_eer(df: DataFrame, *, label: str, score: str, category: str, negative: str) -> DataFrame:
    """EER of all negatives against each other category.  Negatives are counted by score before they are repeated."""
    y = F.col(label).cast("int")
    wrong = y != F.when(F.col(category) == negative, 0).otherwise(1)
    ok = checked(df, label, score).withColumn(label, F.when(wrong, F.raise_error(F.lit("label and category disagree")).cast("int")).otherwise(y))
    kinds = ok.where(F.col(category) != negative).select(F.col(category).alias("category")).distinct()
    neg = score_counts(ok.where(F.col(category) == negative), [], label, score)
    pos = score_counts(ok.where(F.col(category) != negative).withColumn("category", F.col(category)), ["category"], label, score)
    both = pos.unionByName(neg.crossJoin(kinds).select("category", "score", "pos", "neg"))  # one copy per category
    counts = both.groupBy("category", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return equal_error_rate(roc_points(counts, ["category"]), ["category"])


def bootstrap_weights(df: DataFrame, cluster: str, n: int, seed: int) -> DataFrame:
    """``(resample, cluster, m)``: how often each resample draws each cluster.

    Clusters in sorted order are drawn with replacement by NumPy's default generator, n draws of as many as there are
    clusters.  The driver runs the generator for its state before each resample; tasks draw again from there, so the
    rows of resamples are made on executors.  Over ``MAX_CLUSTERS`` clusters it refuses (use ``poisson_weights``).
    """
    names = [r[0] for r in df.select(F.col(cluster).cast("string")).distinct().limit(MAX_CLUSTERS + 1).collect()]
    if len(names) > MAX_CLUSTERS:
        raise ValueError(f"more than {MAX_CLUSTERS} clusters; use poisson_weights")
    names.sort()
    size, rng, starts = len(names), np.random.default_rng(seed), []
    for r in range(n):
        starts.append((r, json.dumps(rng.bit_generator.state)))
        rng.integers(0, size, size=size) if size else None

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for resample, state in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.random.default_rng()
                own.bit_generator.state = json.loads(state)
                m = np.bincount(own.integers(0, size, size=size), minlength=size) if size else np.zeros(0, int)
                at = np.flatnonzero(m)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), resample)), pa.array(at), pa.array(m[at])], ["resample", "at", "m"])

    spark = df.sparkSession
    rows = spark.createDataFrame(starts, "resample long, state string").mapInArrow(drawn, "resample long, at long, m long")
    named = spark.createDataFrame(list(enumerate(names)), "at long, cluster string")
    return rows.join(named, "at").select("resample", "cluster", "m")


def poisson_weights(df: DataFrame, cluster: str, n: int, seed: int) -> DataFrame:
    """Like ``bootstrap_weights`` for any number of clusters: independent Poisson(1) counts from hashes, made in place."""
    names = df.select(F.col(cluster).cast("string").alias("cluster")).distinct()
    rows = names.withColumn("resample", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    u = F.pmod(F.xxhash64(F.lit(seed), "resample", "cluster"), F.lit(1 << 52)) / float(1 << 52)
    cuts, total, term = [], 0.0, float(np.exp(-1))
    for k in range(1, 18):
        total += term
        cuts.append(total)
        term /= k
    m = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= u)).cast("long")
    return rows.select("resample", "cluster", m.alias("m")).where("m > 0")


def resampled_counts(df: DataFrame, weights: DataFrame, label: str, score: str, cluster: str) -> DataFrame:
    """``(resample, score, pos, neg)`` of weighted resamples, from rows summed by cluster and score first."""
    base = score_counts(df, [cluster], label, score)
    joined = base.join(weights, base[cluster].cast("string") == weights["cluster"])
    return joined.groupBy("resample", "score").agg(F.sum(F.col("pos") * F.col("m")).alias("pos"), F.sum(F.col("neg") * F.col("m")).alias("neg"))


def cluster_bootstrap(df: DataFrame, *, label: str, score: str, cluster: str, weights: DataFrame, confidence: float = 0.95) -> DataFrame:
    """One row: EER and ROC-AUC with percentile intervals; resamples of one class are left out and counted."""
    rows = checked(df, label, score)
    points = roc_points(resampled_counts(rows, weights, label, score, cluster), ["resample"])
    a = (1 - confidence) / 2
    ends = F.array(F.lit(a), F.lit(1 - a))
    both = equal_error_rate(points, ["resample"]).select("resample", "eer").join(roc_auc(points, ["resample"]), "resample")
    spread = both.agg(F.percentile("eer", ends).alias("e"), F.percentile("roc_auc", ends).alias("u"), F.count("*").alias("valid_resamples"))
    whole = roc_points(score_counts(rows, [], label, score))
    single = equal_error_rate(whole).select("eer").crossJoin(roc_auc(whole))
    return single.crossJoin(spread).select(
        "eer", F.col("e")[0].alias("eer_low"), F.col("e")[1].alias("eer_high"),
        "roc_auc", F.col("u")[0].alias("roc_auc_low"), F.col("u")[1].alias("roc_auc_high"), "valid_resamples",
    )


def paired_bootstrap(df: DataFrame, *, label: str, score_a: str, score_b: str, cluster: str, weights: DataFrame, confidence: float = 0.95) -> DataFrame:
    """One row: EER(a) - EER(b) with a percentile interval over the same resamples, and the share strictly below 0."""
    rates = []
    for name, score in (("a", score_a), ("b", score_b)):
        rows = checked(df, label, score)
        points = roc_points(resampled_counts(rows, weights, label, score, cluster), ["resample"])
        rates.append((equal_error_rate(points, ["resample"]).select("resample", F.col("eer").alias(name)), eer(df, label, score).select(F.col("eer").alias(name))))
    d = rates[0][0].join(rates[1][0], "resample").withColumn("d", F.col("a") - F.col("b"))
    a = (1 - confidence) / 2
    spread = d.agg(
        F.percentile("d", F.array(F.lit(a), F.lit(1 - a))).alias("q"), F.avg((F.col("d") < 0).cast("double")).alias("fraction_a_lower"),
        F.count("*").alias("valid_resamples"),
    )
    whole = rates[0][1].crossJoin(rates[1][1])
    return whole.crossJoin(spread).select(
        (F.col("a") - F.col("b")).alias("difference"), F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "fraction_a_lower", "valid_resamples"
    )


def evaluation(df: DataFrame, label: str, score: str, threshold: float | None = None) -> DataFrame:
    """EER, AUC and the confusion at its EER threshold, or at a given one that is never estimated again."""
    rows = checked(df, label, score)
    points = roc_points(score_counts(rows, [], label, score))
    rate = equal_error_rate(points).select("eer", F.col("threshold").alias("eer_threshold"))
    one = rate.crossJoin(roc_auc(points)).withColumn("threshold", F.col("eer_threshold") if threshold is None else F.lit(float(threshold)))
    scored = rows.crossJoin(F.broadcast(one.select("threshold")))  # one row
    return one.drop("eer_threshold").crossJoin(confusion(scored, label, score, F.col("threshold")))


def compare_scores(df: DataFrame, score_a: str, score_b: str, threshold: float, by: Sequence[str] = (), tolerance: float = 1e-4) -> DataFrame:
    """Largest and median absolute difference of two scores, rows that changed, and flipped decisions.

    The median is read off running counts; rows with a null score count as rows alone.
    """
    d = F.abs(F.col(score_a) - F.col(score_b))
    flip = (F.col(score_a) >= threshold) != (F.col(score_b) >= threshold)
    plain = df.groupBy(*by).agg(
        F.count("*").alias("rows"), F.max(d).alias("max_difference"),
        F.sum((d > tolerance).cast("long")).alias("changed"), F.sum(flip.cast("long")).alias("flipped"),
    )
    middle = stats.linear_quantiles(df.select(*by, d.alias("__d")), "__d", {"median_difference": 0.5}, by).drop("n")
    middle = middle.select(*[F.col(c).alias(f"__m_{c}") for c in by], "median_difference")
    # without groups both sides are one row
    joined = plain.join(middle, [F.col(c).eqNullSafe(F.col(f"__m_{c}")) for c in by], "left") if by else plain.crossJoin(middle)
    return joined.select(*by, "rows", "max_difference", "median_difference", "changed", "flipped")


def score_effect(df: DataFrame, *, label: str, score_a: str, score_b: str, threshold: float, cluster: str, weights: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """One row: what a change of scores does to scores and decisions, and to the EER with its paired interval."""
    change = paired_bootstrap(df, label=label, score_a=score_a, score_b=score_b, cluster=cluster, weights=weights)
    renamed = change.withColumnsRenamed({"difference": "eer_difference", "low": "eer_low", "high": "eer_high"})
    return compare_scores(df, score_a, score_b, threshold, tolerance=tolerance).crossJoin(renamed)  # single rows


def bce_loss(logit: Column, label: Column) -> Column:
    """Aggregate: mean binary cross entropy of logits, in the form that can't overflow."""
    return F.avg(F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit))))
