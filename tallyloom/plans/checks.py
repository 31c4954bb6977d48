"""Audit queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import audits, joins, planning, sets, stats, validation
from tallyloom.plans.integrity import SEED, docs, split_of
from tallyloom.plans.registry import query, table
from tallyloom.sources.prepared import structure_issues
from tallyloom.sources.tables import scan_with_file


def _samples(spark, d) -> DataFrame:
    """Embeddings with a rate, and every tenth one copied under another id."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("samples"), F.lit(16).alias("rate"), F.col("label").cast("string").alias("k"))
    return e.unionByName(e.where("vec_id % 10 = 0").withColumn("vec_id", F.col("vec_id") + 1000000))


@query("sample_duplicates", "SELECT count(*) AS groups, 2 * count(*) AS ids FROM embeddings WHERE vec_id % 10 = 0")
def sample_duplicates(spark, d):
    found = audits.duplicate_audit(_samples(spark, d), id_col="vec_id", samples_col="samples", rate_col="rate", crossing=["k"])
    return found.agg(F.count("*").alias("groups"), F.sum("ids").alias("ids"))


@query("samples_audit", """
SELECT 'samples' AS "check", code, count FROM (
  SELECT 'null_samples' AS code, count(*) FILTER (vec_id % 50 = 0) AS count FROM embeddings UNION ALL SELECT 'bad_rate', count(*) FILTER (vec_id % 60 = 0) FROM embeddings
  UNION ALL SELECT 'missing_metadata', count(*) FILTER (vec_id % 70 = 0) FROM embeddings UNION ALL SELECT 'metadata_mismatch', count(*) FILTER (vec_id % 80 = 0 AND vec_id % 70 <> 0) FROM embeddings) WHERE count > 0""")
def samples_audit(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("samples"), F.col("label").alias("k"))
    rows = e.withColumns({"samples": F.when(F.col("vec_id") % 50 != 0, F.col("samples")), "rate": F.when(F.col("vec_id") % 60 == 0, 0).otherwise(16)})
    meta = e.where("vec_id % 70 <> 0").select("vec_id", F.when(F.col("vec_id") % 80 == 0, -1).otherwise(F.col("k")).alias("k"))
    return audits.samples_audit(rows, meta, id_col="vec_id", samples_col="samples", rate_col="rate", compare=["k"]).select("check", "code", "count")


@query("store_parity", """
SELECT count(*) AS ids, count(*) FILTER (vec_id % 9 <> 0) AS common, count(*) FILTER (vec_id % 9 <> 0 AND vec_id % 11 = 0)::BIGINT AS metadata_mismatches,
  count(*) FILTER (vec_id % 9 <> 0 AND vec_id % 13 = 0)::BIGINT AS sample_mismatches, 1.0::DOUBLE AS max_difference FROM embeddings""")
def store_parity(spark, d):
    a = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("samples"))
    shifted = F.transform("samples", lambda x: F.round(x, 3) + 1.0)
    a = a.withColumn("samples", F.transform("samples", lambda x: F.round(x, 3)))
    b = a.where("vec_id % 9 <> 0").withColumns({
        "label": F.when(F.col("vec_id") % 11 == 0, -1).otherwise(F.col("label")), "samples": F.when(F.col("vec_id") % 13 == 0, shifted).otherwise(F.col("samples")),
    })
    out = audits.parity(a, b, id_col="vec_id", compare=["label"], samples_col="samples")
    return out.withColumn("max_difference", F.round("max_difference", 6))


@query("reproducible_read", "SELECT true AS same, count(*) AS rows FROM documents")
def reproducible_read(spark, d):
    return audits.reproducible(docs(spark, d), docs(spark, d).repartition(5), ["doc_id", "text", "lang"])


@query("read_workloads", """
WITH r AS (SELECT doc_id, doc_id % 16 AS shard, sha256('2026|' || doc_id::VARCHAR) AS k FROM documents),
big AS (SELECT shard FROM r GROUP BY shard ORDER BY count(*) DESC, shard LIMIT 1), n AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY k, doc_id::VARCHAR) AS rn FROM r),
w AS (SELECT 'same_shard' AS workload, doc_id, shard, k FROM (SELECT * FROM r WHERE shard IN (FROM big) ORDER BY k, doc_id::VARCHAR LIMIT 20)
  UNION ALL SELECT 'dispersed', doc_id, shard, k FROM (SELECT * FROM n WHERE rn <= 20 ORDER BY rn, k, doc_id::VARCHAR LIMIT 20)
  UNION ALL SELECT 'shuffled', doc_id, shard, k FROM (SELECT * FROM r ORDER BY k, doc_id::VARCHAR LIMIT 20))
SELECT workload, (row_number() OVER (PARTITION BY workload ORDER BY k, doc_id::VARCHAR) - 1)::INT AS position, doc_id, shard FROM w""")
def read_workloads(spark, d):
    return audits.workloads(docs(spark, d).select("doc_id", (F.col("doc_id") % 16).alias("shard")), SEED, 20, id_col="doc_id", shard_col="shard")


@query("amplitude_audit", """
WITH x AS (SELECT label, list_transform(embedding, lambda x: x::FLOAT::DOUBLE) AS a FROM embeddings),
m AS (SELECT label, list_max(list_transform(a, lambda v: abs(v))) AS peak, sqrt(list_sum(list_transform(a, lambda v: v * v)) / len(a)) AS rms FROM x),
p AS (SELECT *, 20 * log10(greatest(rms, 1e-8::DOUBLE)) AS db, unnest(['none', 'peak', 'rms_dbfs']) AS policy FROM m),
g AS (SELECT *, CASE policy WHEN 'peak' THEN 0.95::DOUBLE / peak WHEN 'rms_dbfs' THEN least(pow(10, (-25 - db) / 20), 0.95::DOUBLE / peak) ELSE 1 END AS gain FROM p)
SELECT policy, label, count(*) AS rows, round(min(peak * gain), 6) AS output_peak_min, round(max(peak * gain), 6) AS output_peak_max, round(quantile_cont(20 * log10(greatest(rms * gain, 1e-8::DOUBLE)), 0.5), 6) AS output_rms_dbfs_median
FROM g GROUP BY GROUPING SETS ((policy), (policy, label))""")
def amplitude_audit(spark, d):
    out = audits.amplitude_audit(table(spark, d, "embeddings"), samples_col="embedding", dimensions=["label"])
    return out.select("policy", "label", "rows", *[F.round(c, 6).alias(c) for c in ("output_peak_min", "output_peak_max", "output_rms_dbfs_median")])


@query("sampled_levels", """
WITH s AS (SELECT vec_id, label, embedding AS a FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY sha256('2026|' || vec_id::VARCHAR), vec_id) <= 3)
SELECT vec_id, label, len(a)::BIGINT AS samples, list_min(list_transform(a, lambda v: v::DOUBLE)) AS minimum FROM s""")
def sampled_levels(spark, d):
    e = table(spark, d, "embeddings").withColumn("rate", F.lit(16))
    return audits.sampled_levels(e, id_col="vec_id", category_col="label", samples_col="embedding", rate_col="rate", per_category=3, seed=SEED).select("vec_id", "label", "samples", "minimum")


def _manifest(spark, d) -> DataFrame:
    df = split_of(docs(spark, d))
    return df.select(
        F.lit("2").alias("manifest_version"), F.when(F.col("doc_id") % 90 == 0, "../x").otherwise("s.parquet").alias("shard"), F.col("doc_id").cast("string").alias("file"),
        F.concat("split", F.lit("-"), "source").alias("speaker_id"), "split", F.when(F.col("doc_id") % 80 == 0, "x").when(F.col("lang") == "en", "0").otherwise("1").alias("binary_label"),
        F.col("lang").alias("utt_type"), F.when(F.col("doc_id") % 70 == 0, "0").otherwise("16000").alias("native_sample_rate"), F.lit("snap").alias("source_snapshot"),
    )


@query("manifest_rules", """
SELECT 'manifest' AS "check", code, count FROM (SELECT 'unsafe_shard' AS code, count(*) FILTER (doc_id % 90 = 0) AS count FROM documents UNION ALL SELECT 'bad_label', count(*) FILTER (doc_id % 80 = 0) FROM documents
  UNION ALL SELECT 'bad_rate', count(*) FILTER (doc_id % 70 = 0) FROM documents UNION ALL SELECT 'unknown_category', count(*) FILTER (lang = 'es') FROM documents) WHERE count > 0""")
def manifest_rules(spark, d):
    return validation.manifest_issues(_manifest(spark, d), splits=("train", "dev", "test"), categories=("en", "fr", "de"), negative="en").select("check", "code", "count")


@query("pattern_rules", r"""
SELECT 'pattern' AS "check", 'pattern_mismatch' AS code, count(*) AS count FROM documents WHERE (lang = 'fr' AND NOT regexp_full_match(source, 'src[0-9]')) OR (lang = 'de' AND NOT regexp_full_match(source, 'src1[0-9]'))""")
def pattern_rules(spark, d):
    df = docs(spark, d).select(F.col("source").alias("file"), "lang", F.col("source").alias("e"))
    return validation.pattern_issues(df, id_col="file", entity_col="e", category_col="lang", patterns={"fr": "(src[0-9])", "de": "(src1[0-9])"}).select("check", "code", "count")


@query("packed_structure", """
WITH x AS (SELECT o_orderpriority AS split, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS i FROM orders), y AS (SELECT * FROM x WHERE i % 100 <> 7),
l AS (SELECT *, coalesce(lag(i) OVER (PARTITION BY split ORDER BY i) + 1, 0) AS e FROM y)
SELECT 'gap' AS rule, count(*) FILTER (i <> e) AS count FROM l UNION ALL SELECT 'bad_hash', count(*) FILTER (o_orderkey % 50 = 0) FROM y""")
def packed_structure(spark, d):
    from pyspark.sql import Window

    x = table(spark, d, "orders").select(F.col("o_orderpriority").alias("split"), F.col("o_orderkey").alias("file"), (F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey")) - 1).cast("long").alias("artifact_index"))
    x = x.where("artifact_index % 100 <> 7").withColumns({"offset_samples": F.col("artifact_index") * 4, "num_samples": F.lit(4).cast("long")})
    x = x.withColumn("waveform_sha256", F.when(F.col("file") % 50 == 0, "zz").otherwise(F.sha2(F.col("file").cast("string"), 256)))
    return structure_issues(x).groupBy("rule").agg(F.count("*").alias("count"))


@query("file_scan", "SELECT 'documents.parquet' AS shard, lang, count(*) AS rows FROM documents GROUP BY lang")
def file_scan(spark, d):
    df = scan_with_file(spark, f"{d.rstrip('/')}/documents.parquet", "lang")
    name = F.when(F.col("shard").startswith("part-"), "documents.parquet").otherwise(F.col("shard"))
    return stats.counts_by(df.withColumn("shard", name), "shard", "lang")


@query("covered_rows", "SELECT count(*) FILTER (doc_id % 7 <> 0 AND doc_id % 11 <> 0) AS covered, count(*) FILTER (doc_id % 7 <> 0 AND doc_id % 11 = 0) AS differing FROM documents")
def covered_rows(spark, d):
    df = docs(spark, d).select("doc_id", "lang")
    local = df.where("doc_id % 7 <> 0").withColumn("lang", F.when(F.col("doc_id") % 11 == 0, "xx").otherwise(F.col("lang")))
    good, bad = joins.covered(df, local, id_col="doc_id", compare=["lang"])
    return good.agg(F.count("*").alias("covered")).crossJoin(bad.agg(F.count("*").alias("differing")))  # single rows


@query("difference_rows", "SELECT doc_id, 'missing' AS side FROM documents WHERE doc_id % 13 = 0 AND doc_id % 17 <> 0 UNION ALL SELECT doc_id, 'extra' FROM documents WHERE doc_id % 17 = 0 AND doc_id % 13 <> 0")
def difference_rows(spark, d):
    df = docs(spark, d).select("doc_id")
    missing, extra = sets.difference_rows(df.where("doc_id % 13 <> 0"), df.where("doc_id % 17 <> 0"), ["doc_id"])
    return missing.withColumn("side", F.lit("missing")).unionByName(extra.withColumn("side", F.lit("extra")))


@query("epoch_costs", "SELECT lang, round(count(*) * 0.0467::DOUBLE * 3, 6) AS seconds FROM documents GROUP BY lang")
def epoch_costs(spark, d):
    n = docs(spark, d).groupBy("lang").agg(F.count("*").alias("n"))
    return n.select("lang", F.round(planning.epoch_cost(F.col("n"), F.lit(0.0467), 3), 6).alias("seconds"))
