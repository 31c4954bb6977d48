"""Profiles, joins, set algebra, duplicates and validation over the driver's tables.

A document stands for a row: its id is ``doc_id``, its entity ``source``, its category ``lang`` and its content the
text.  Partitions come from the id, so both engines see the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import hashing, keys, text
from tallyloom.operators import dedup, joins, planning, sets, stats, validation
from tallyloom.plans.registry import query, table
from tallyloom.session import materialize

SEED = 2026
LANGS = ("en", "fr", "de", "es")


def docs(spark, d) -> DataFrame:
    return table(spark, d, "documents")


def split_of(df: DataFrame, col: str = "doc_id") -> DataFrame:
    """Train, dev or test by the id."""
    r = F.col(col) % 10
    return df.withColumn("split", F.when(r < 7, "train").when(r < 8, "dev").otherwise("test"))


def hashed(spark, d) -> DataFrame:
    """``(doc_id, lang, source, split, h)`` with the content hash, written once: texts are read and hashed a single time
    however often a query looks at the rows."""
    df = split_of(docs(spark, d)).select("doc_id", "lang", "source", "split", F.sha2("text", 256).alias("h"))
    return materialize(df, "hashed")


SPLIT_SQL = "CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 8 THEN 'dev' ELSE 'test' END"


@query("metadata_profile", """
SELECT count(*) AS rows, (count(*) - (SELECT count(*) FROM (SELECT DISTINCT doc_id, source, lang FROM documents)))::BIGINT AS exact_duplicate_rows,
  count(*) FILTER (doc_id = -1)::BIGINT AS missing_id, count(*) FILTER (coalesce(source, '') = '')::BIGINT AS missing_entity,
  count(*) FILTER (coalesce(lang, '') = '')::BIGINT AS missing_category, count(*) FILTER (lang <> '' AND lang NOT IN ('en', 'fr', 'de'))::BIGINT AS invalid_categories,
  0::BIGINT AS prefix_mismatches, (count(*) - count(DISTINCT doc_id))::BIGINT AS duplicate_ids, count(DISTINCT source)::BIGINT AS entities
FROM documents""")
def metadata_profile(spark, d):
    out = stats.profile(docs(spark, d), id_col="doc_id", entity_col="source", category_col="lang", categories=("en", "fr", "de"))
    return out.select(*[F.col(c).cast("long").alias(c) for c in out.columns])


@query("rows_per_entity_stats", """
SELECT min(n)::BIGINT AS min_rows, quantile_cont(n, 0.5) AS median_rows, max(n)::BIGINT AS max_rows, count(*) AS entities
FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)""")
def rows_per_entity_stats(spark, d):
    return stats.rows_per_entity(table(spark, d, "orders"), "o_custkey")


@query("category_distribution", """
SELECT lang AS category, count(*) AS rows, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM documents), 9) AS percent,
  CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS target FROM documents GROUP BY lang""")
def category_distribution(spark, d):
    return stats.distribution(docs(spark, d), "lang", "en").withColumn("percent", F.round("percent", 9))


PATTERNS = {"done": ["F"], "open": ["O"], "both": ["F", "O"]}


@query("entity_pattern_strata", """
SELECT stratum, count(*) AS entities FROM (
  SELECT CASE list_sort(list(DISTINCT o_orderstatus)) WHEN ['F'] THEN 'done' WHEN ['O'] THEN 'open' WHEN ['F', 'O'] THEN 'both' END AS stratum
  FROM orders GROUP BY o_custkey) GROUP BY stratum""")
def entity_pattern_strata(spark, d):
    return stats.counts_by(stats.entity_patterns(table(spark, d, "orders"), "o_custkey", "o_orderstatus", PATTERNS), "stratum").withColumnRenamed("rows", "entities")


@query("paired_type_structure", """
WITH k AS (SELECT o_custkey AS entity, year(o_orderdate) AS k, count(*) FILTER (o_orderpriority = '1-URGENT') AS l, count(*) FILTER (o_orderpriority = '2-HIGH') AS r
  FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2)
SELECT entity, sum(l)::BIGINT AS left_rows, sum(r)::BIGINT AS right_rows, count(*) FILTER (l > 0 AND r > 0) AS common_keys,
  count(*) FILTER (l > 0 AND r = 0) AS left_only_keys, count(*) FILTER (l = 0 AND r > 0) AS right_only_keys,
  sum(l) = sum(r) AS same_count, count(*) FILTER (l = 0 OR r = 0) = 0 AS same_keys
FROM k GROUP BY entity""")
def paired_type_structure(spark, d):
    return stats.paired_structure(table(spark, d, "orders"), "o_custkey", "o_orderpriority", F.year("o_orderdate"), "1-URGENT", "2-HIGH")


@query("reference_comparison", """
WITH r(category, reference) AS (VALUES ('en', 600), ('fr', 150), ('de', 130), ('es', 120), ('it', 10)),
j AS (SELECT category, reference::BIGINT AS reference, coalesce(n, 0)::BIGINT AS observed FROM r LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY 1) ON lang = category),
a AS (SELECT * FROM j UNION ALL SELECT 'total', sum(reference)::BIGINT, sum(observed)::BIGINT FROM j)
SELECT *, observed - reference AS difference, round(100.0::DOUBLE * observed / reference, 9) AS percent FROM a""")
def reference_comparison(spark, d):
    counts = stats.distribution(docs(spark, d), "lang").select("category", "rows")
    return stats.against_reference(counts, {"en": 600, "fr": 150, "de": 130, "es": 120, "it": 10}).withColumn("percent", F.round("percent", 9))


@query("shard_inventory_left_join", """
WITH m AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'xx' ELSE lang END AS lang, source FROM documents WHERE doc_id % 7 <> 0)
SELECT l.doc_id % 16 AS shard, count(*) AS rows, count(DISTINCT l.doc_id) AS ids,
  sum(CASE WHEN m.doc_id IS NOT NULL AND l.lang = m.lang AND l.source = m.source THEN 1 ELSE 0 END)::BIGINT AS matches
FROM documents l LEFT JOIN m USING (doc_id) GROUP BY 1""")
def shard_inventory_left_join(spark, d):
    df = docs(spark, d).select("doc_id", "lang", "source")
    meta = df.where("doc_id % 7 <> 0").withColumn("lang", F.when(F.col("doc_id") % 11 == 0, "xx").otherwise(F.col("lang")))
    return joins.inventory(df.withColumn("shard", F.col("doc_id") % 16), meta, shard_col="shard", id_col="doc_id", compare=["lang", "source"])


@query("type_counts_by_shard", "SELECT doc_id % 16 AS shard, lang, count(*) AS rows FROM documents GROUP BY ALL")
def type_counts_by_shard(spark, d):
    return stats.counts_by(docs(spark, d).withColumn("shard", F.col("doc_id") % 16), "shard", "lang")


@query("split_entity_summary", f"""
SELECT {SPLIT_SQL} AS split, count(*) AS rows, count(DISTINCT doc_id) AS ids, count(DISTINCT source) AS entities, count(*) - count(DISTINCT doc_id) AS duplicate_occurrences
FROM documents GROUP BY 1""")
def split_entity_summary(spark, d):
    return stats.split_summary(split_of(docs(spark, d)), "split", "doc_id", "source")


@query("content_representatives", """
WITH h AS (SELECT doc_id, sha256(text) AS h, sha256('2026|' || doc_id::VARCHAR) AS k FROM documents),
r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY k, doc_id::VARCHAR) AS rep FROM h)
SELECT doc_id, h AS content_sha256, rep::VARCHAR AS representative, doc_id = rep AS kept FROM r""")
def content_representatives(spark, d):
    df = hashed(spark, d).select("doc_id", F.col("h").alias("content_sha256"))
    return dedup.content_representatives(df, SEED, hash_col="content_sha256", id_col="doc_id")


@query("duplicate_groups", f"""
WITH h AS (SELECT *, sha256(text) AS h, {SPLIT_SQL} AS split FROM documents),
g AS (SELECT h, count(*) AS rows, count(DISTINCT doc_id) AS ids, count(DISTINCT source) > 1 AS crosses_source, count(DISTINCT split) > 1 AS crosses_split,
  list_sort(list(DISTINCT doc_id))[1:5] AS ex FROM h GROUP BY h HAVING count(DISTINCT doc_id) > 1)
SELECT h AS content, rows, ids, crosses_source, crosses_split, array_to_string(ex, ',') AS examples FROM g""")
def duplicate_groups(spark, d):
    out = dedup.duplicate_groups(hashed(spark, d), hash_col="h", id_col="doc_id", crossing=["source", "split"])
    return out.withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))


@query("two_phase_duplicates", "SELECT sha256(text) AS content, count(DISTINCT doc_id)::BIGINT AS ids FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def two_phase_duplicates(spark, d):
    return dedup.two_phase_duplicates(docs(spark, d).select("doc_id", "text"), cheap=F.xxhash64("text"), exact=F.sha2("text", 256), id_col="doc_id")


@query("dup_groups_in_manifest", f"""
WITH h AS (SELECT doc_id, sha256(text) AS content, {SPLIT_SQL} AS split FROM documents),
g AS (SELECT content FROM h GROUP BY 1 HAVING count(DISTINCT doc_id) > 1)
SELECT content, count(DISTINCT doc_id) AS ids, min(split) <> max(split) AS crosses_splits
FROM h JOIN g USING (content) WHERE doc_id % 3 <> 0 GROUP BY content HAVING count(DISTINCT doc_id) > 1""")
def dup_groups_in_manifest(spark, d):
    df = hashed(spark, d).select(F.col("doc_id").alias("id"), "split", F.col("h").alias("content"))
    many = df.groupBy("content").agg(F.countDistinct("id").alias("n")).where("n > 1").select("content")
    groups = df.join(many, "content", "left_semi").select("content", "id")
    return dedup.groups_in_selection(groups, df.where("id % 3 <> 0").select("id", "split"), id_col="id", split_col="split")


ROLES = {"train": ("closed", "train"), "dev": ("closed", "eval"), "test": ("closed", "eval")}


@query("cross_partition_content_leak", f"""
WITH h AS (SELECT doc_id, sha256(text) AS hash, CASE {SPLIT_SQL} WHEN 'train' THEN 'train' ELSE 'eval' END AS role FROM documents)
SELECT hash, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles, count(DISTINCT doc_id) AS ids FROM h GROUP BY hash
HAVING count(DISTINCT role) > 1 AND count(DISTINCT doc_id) > 1""")
def cross_partition_content_leak(spark, d):
    out = sets.content_leaks(hashed(spark, d), hash_col="h", id_col="doc_id", split_col="split", roles=ROLES)
    return out.withColumn("roles", F.array_join("roles", ","))


@query("pairwise_entity_overlap", """
WITH k AS (SELECT DISTINCT o_orderstatus AS s, o_custkey AS c FROM orders)
SELECT a.s AS left_split, b.s AS right_split, count(*) AS overlap, array_to_string(list_sort(list(a.c::VARCHAR))[1:10], ',') AS examples
FROM k a JOIN k b ON a.c = b.c AND a.s < b.s GROUP BY 1, 2""")
def pairwise_entity_overlap(spark, d):
    out = sets.pairwise_overlap(table(spark, d, "orders"), "o_orderstatus", "o_custkey")
    return out.withColumn("examples", F.array_join("examples", ","))


@query("exact_row_coverage", """
SELECT (SELECT count(*) FROM (SELECT DISTINCT doc_id, source, lang FROM documents WHERE doc_id % 13 = 0))::BIGINT AS missing,
  (SELECT count(*) FROM (SELECT DISTINCT doc_id, source, lang FROM documents WHERE doc_id % 17 = 0 AND doc_id % 13 <> 0))::BIGINT AS extra""")
def exact_row_coverage(spark, d):
    df = docs(spark, d).select("doc_id", "source", "lang")
    return sets.set_difference(df.where("doc_id % 13 <> 0"), df.where("NOT (doc_id % 17 = 0 AND doc_id % 13 <> 0)"), ["doc_id", "source", "lang"])


@query("allowed_category_violations", f"""
SELECT split, array_to_string(list_sort(list(DISTINCT lang)), ',') AS invalid FROM (SELECT {SPLIT_SQL} AS split, lang FROM documents)
WHERE (split = 'train' AND lang NOT IN ('en', 'fr')) OR (split = 'test' AND lang NOT IN ('en', 'de', 'es')) GROUP BY split""")
def allowed_category_violations(spark, d):
    out = sets.outside_allowed(split_of(docs(spark, d)), "split", "lang", {"train": ["en", "fr"], "dev": list(LANGS), "test": ["en", "de", "es"]})
    return out.withColumn("invalid", F.array_join("invalid", ","))


@query("cohort_equality", """
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '2-HIGH')
SELECT (SELECT count(*) FROM a ANTI JOIN b USING (k)) AS only_a, (SELECT count(*) FROM b ANTI JOIN a USING (k)) AS only_b,
  (SELECT count(*) FROM a SEMI JOIN b USING (k)) AS both, (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS either""")
def cohort_equality(spark, d):
    return sets.set_algebra(table(spark, d, "orders"), "o_custkey", "o_orderpriority", "1-URGENT", "2-HIGH")


@query("unknown_rows_anti", "SELECT doc_id, lang, source FROM documents WHERE doc_id % 9 = 0 OR doc_id % 14 = 0")
def unknown_rows_anti(spark, d):
    df = docs(spark, d).select("doc_id", "lang", "source")
    known = df.where("doc_id % 9 <> 0").withColumn("lang", F.when(F.col("doc_id") % 14 == 0, "xx").otherwise(F.col("lang")))
    return joins.unknown_rows(df, known, ["doc_id", "lang", "source"])


@query("wanted_semi", "SELECT item_id, true AS present FROM benchmark WHERE item_id IN (SELECT doc_id FROM documents) UNION ALL SELECT item_id, false FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM documents)")
def wanted_semi(spark, d):
    wanted = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    rows, missing = joins.wanted_rows(docs(spark, d).select("doc_id"), wanted, "doc_id")
    out = rows.withColumn("present", F.lit(True)).unionByName(missing.withColumn("present", F.lit(False)))
    return out.withColumnRenamed("doc_id", "item_id")


@query("replaced_rows", "SELECT count(*) FILTER (doc_id % 5 = 0 AND doc_id % 6 <> 0) AS removed, count(*) FILTER (doc_id % 6 = 0 AND doc_id % 5 <> 0) AS replacements FROM documents")
def replaced_rows(spark, d):
    df = docs(spark, d).select("doc_id")
    return sets.replaced_counts(df.where("doc_id % 6 <> 0"), df.where("doc_id % 5 <> 0"), ["doc_id"])


@query("local_coverage", "SELECT count(*) AS rows, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS present, round(count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) / count(*)::DOUBLE, 9) AS coverage FROM documents")
def local_coverage(spark, d):
    return joins.coverage(docs(spark, d).select("doc_id"), table(spark, d, "labels"), "doc_id").withColumn("coverage", F.round("coverage", 9))


@query("lookup_issues", """
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'missing' ELSE 'mismatch' END AS issue FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0""")
def lookup_issues(spark, d):
    df = docs(spark, d).select("doc_id", "lang")
    meta = df.where("doc_id % 7 <> 0").withColumn("lang", F.when(F.col("doc_id") % 11 == 0, "xx").otherwise(F.col("lang")))
    return joins.lookup_issues(df, meta, id_col="doc_id", compare=["lang"])


@query("membership_by_split", f"SELECT split, count(*) AS rows FROM labels LEFT JOIN (SELECT doc_id, {SPLIT_SQL} AS split FROM documents WHERE doc_id % 4 <> 0) USING (doc_id) GROUP BY split")
def membership_by_split(spark, d):
    splits = split_of(docs(spark, d).where("doc_id % 4 <> 0"))
    return stats.counts_by(joins.membership(table(spark, d, "labels"), splits, "doc_id"), "split")


@query("positional_parity", "SELECT count(*) AS positions, count(*) FILTER (doc_id % 10 = 9 OR doc_id % 12 = 0)::BIGINT AS mismatches FROM documents")
def positional_parity(spark, d):
    df = docs(spark, d).select("doc_id", "lang")
    other = df.where("doc_id % 10 <> 9").withColumn("lang", F.when(F.col("doc_id") % 12 == 0, "xx").otherwise(F.col("lang")))
    return joins.positional_mismatches(df, other, "doc_id", ["lang"])


@query("aligned_records", """
SELECT l.doc_id AS position, doc_id, lang AS lang_a, CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END AS lang_b, doc_id % 5 <> 0 AS same
FROM labels l JOIN documents USING (doc_id)""")
def aligned_records(spark, d):
    df = docs(spark, d).select("doc_id", "lang")
    other = df.withColumn("lang", F.when(F.col("doc_id") % 5 == 0, "xx").otherwise(F.col("lang")))
    order = table(spark, d, "labels").select("doc_id", F.col("doc_id").alias("position"))
    return joins.aligned(order, df, other, id_col="doc_id", position_col="position", values=["lang"])


@query("request_order", """
SELECT conv_id * 1000 + turn AS position, conv_id AS doc_id, lang, CASE WHEN d.doc_id IS NULL THEN 0 ELSE 1 END::BIGINT AS rows_of_id
FROM conversations LEFT JOIN documents d ON d.doc_id = conv_id""")
def request_order(spark, d):
    requests = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("position"), F.col("conv_id").alias("doc_id"))
    return joins.request_order(requests, docs(spark, d).select("doc_id", "lang"), id_col="doc_id", position_col="position")


LEDGER_SQL = f"""
WITH h AS (SELECT doc_id, lang, sha256(text) AS content_sha256, {SPLIT_SQL} AS split, sha256('2026|' || doc_id::VARCHAR) AS k FROM documents),
e AS (SELECT *, CASE WHEN content_sha256 IN (SELECT content_sha256 FROM h WHERE split = 'train') THEN 'train_overlap'
    WHEN split = 'test' AND content_sha256 IN (SELECT content_sha256 FROM h WHERE split = 'dev') THEN 'dev_overlap' END AS early FROM h WHERE split <> 'train'),
l AS (SELECT doc_id, lang, content_sha256, split, coalesce(early, CASE WHEN row_number() OVER (PARTITION BY split, content_sha256, early ORDER BY k, doc_id::VARCHAR) = 1 THEN 'kept' ELSE 'internal_duplicate' END) AS decision FROM e)
"""


def _ledger(spark, d) -> DataFrame:
    df = hashed(spark, d).select("doc_id", "lang", F.col("h").alias("content_sha256"), "split")
    train, dev, test = (df.where(F.col("split") == s).drop("split") for s in ("train", "dev", "test"))
    return dedup.evaluation_ledger(train, dev, test, SEED, hash_col="content_sha256", id_col="doc_id")


@query("eval_dedup_ledger", LEDGER_SQL + "SELECT * FROM l")
def eval_dedup_ledger(spark, d):
    return _ledger(spark, d)


@query("eval_dedup_loss", LEDGER_SQL + """
SELECT split, lang AS category, count(*) AS rows, count(*) FILTER (decision <> 'kept')::BIGINT AS lost,
  round(count(*) FILTER (decision <> 'kept') / count(*)::DOUBLE, 9) AS loss, count(*) FILTER (decision <> 'kept') / count(*)::DOUBLE > 0.05::DOUBLE AS stop FROM l GROUP BY ALL""")
def eval_dedup_loss(spark, d):
    return dedup.ledger_losses(_ledger(spark, d), "lang").withColumn("loss", F.round("loss", 9))


@query("mixed_label_hashes", """
SELECT sha256(text) AS content, count(*) AS rows FROM documents GROUP BY 1 HAVING min(doc_id % 2) <> max(doc_id % 2)""")
def mixed_label_hashes(spark, d):
    df = docs(spark, d).select(F.sha2("text", 256).alias("h"), (F.col("doc_id") % 2).alias("target"))
    return dedup.mixed_targets(df, hash_col="h", target_col="target")


@query("row_to_shard", """
WITH r AS (SELECT doc_id, CASE WHEN doc_id < 300 THEN doc_id // 100 WHEN doc_id < 750 THEN 3 + (doc_id - 300) // 90 END AS shard FROM documents)
SELECT doc_id, shard::BIGINT AS shard, 'train-' || lpad(shard::VARCHAR, 5, '0') || '-of-00008.parquet' AS name FROM r""")
def row_to_shard(spark, d):
    shard = text.shard_of_row(F.col("doc_id"), 3, 100, 5, 90)
    return docs(spark, d).select("doc_id", shard.alias("shard")).withColumn("name", text.shard_name(F.col("shard"), 8))


@query("regex_conformance", r"""
SELECT page_id, regexp_full_match(url, 'https?://[a-z0-9.-]+\.example\.(com|net|org)/(en|fr|de|es)/[0-9]+') AS conforms,
  regexp_extract(split_part(url, '?', 1), '([0-9]{2})$', 1) AS number FROM pages""")
def regex_conformance(spark, d):
    ok = text.full_match(F.col("url"), r"https?://[a-z0-9.-]+\.example\.(com|net|org)/(en|fr|de|es)/[0-9]+")
    return table(spark, d, "pages").select("page_id", ok.alias("conforms"), text.trailing_number(F.substring_index("url", "?", 1), 2).alias("number"))


@query("path_prefix_check", r"""
SELECT page_id, regexp_extract(regexp_extract(url, '://[^/]*/?(.*)$', 1), '^(/|[^/]+)', 1) AS first_part FROM pages""")
def path_prefix_check(spark, d):
    path = F.regexp_extract("url", r"://[^/]*/?(.*)$", 1)
    return table(spark, d, "pages").select("page_id", text.first_part(path).alias("first_part"))


SHARD_SQL = """
WITH d AS (SELECT doc_id % 16 AS shard, lang, n_chars FROM documents),
need AS (SELECT shard, count(*) AS wanted_rows FROM d WHERE lang <> 'en' GROUP BY 1),
size AS (SELECT shard, sum(n_chars)::BIGINT AS bytes FROM d GROUP BY 1),
mean AS (SELECT round_even(avg(bytes), 0)::BIGINT AS bytes FROM size WHERE shard < 4)
"""


def _shard_plan(spark, d, unlisted=()):
    df = docs(spark, d).select("lang", "n_chars", (F.col("doc_id") % 16).alias("shard"))
    sizes = df.groupBy("shard").agg(F.sum("n_chars").alias("bytes"))
    return planning.shard_plan(df.where("lang <> 'en'"), sizes.where("shard < 4"), sizes.where(~F.col("shard").isin(*unlisted)) if unlisted else sizes)


@query("shard_need_plan", SHARD_SQL + """
SELECT shard, wanted_rows, shard < 4 AS present, CASE WHEN shard >= 4 THEN (SELECT bytes FROM mean) END AS missing_bytes, 'local_mean' AS size_source FROM need""")
def shard_need_plan(spark, d):
    return _shard_plan(spark, d, unlisted=(5,))


@query("shard_disk_budget", SHARD_SQL + """
, m AS (SELECT coalesce(sum(bytes), 0)::BIGINT AS missing_bytes, coalesce(max(bytes), 0)::BIGINT AS largest FROM need JOIN size USING (shard) WHERE shard >= 4),
p AS (SELECT round_even(sum(wanted_rows) * 12.5::DOUBLE, 0)::BIGINT AS packed_bytes FROM need)
SELECT missing_bytes, largest AS largest_bytes, packed_bytes, missing_bytes + packed_bytes AS keep_bytes, missing_bytes + packed_bytes <= 900000::DOUBLE AS keep_fits,
  packed_bytes + largest AS streaming_bytes, packed_bytes + largest <= 900000::DOUBLE AS streaming_fits FROM m, p""")
def shard_disk_budget(spark, d):
    return planning.disk_budget(_shard_plan(spark, d), bytes_per_row=12.5, free_bytes=1_000_000)


@query("selection_digest", """
WITH h AS (SELECT lang, sha256(doc_id::VARCHAR) AS h FROM documents)
SELECT lang, count(*)::VARCHAR || '-' || sum(('0x' || substr(h, 1, 15))::BIGINT)::VARCHAR || '-' || sum(('0x' || substr(h, 16, 15))::BIGINT)::VARCHAR AS digest, count(*) AS rows FROM h GROUP BY lang""")
def selection_digest(spark, d):
    return docs(spark, d).groupBy("lang").agg(hashing.selection_digest(F.col("doc_id")).alias("digest"), F.count("*").alias("rows"))


@query("issue_report", """
WITH r AS (SELECT doc_id, lang, CASE WHEN doc_id % 50 = 0 THEN '' ELSE source END AS source FROM documents),
i AS (SELECT 'missing_entity' AS code, doc_id::VARCHAR || '||' || lang AS e FROM r WHERE source = ''
  UNION ALL SELECT 'invalid_category', lang FROM r WHERE lang NOT IN ('en', 'fr', 'de'))
SELECT 'documents' AS "check", code, count(*) AS count, array_to_string(list_sort(list(DISTINCT e))[1:10], ',') AS examples FROM i GROUP BY code""")
def issue_report(spark, d):
    df = docs(spark, d).withColumn("source", F.when(F.col("doc_id") % 50 == 0, "").otherwise(F.col("source")))
    out = validation.table_issues(df, id_col="doc_id", entity_col="source", category_col="lang", categories=("en", "fr", "de"), name="documents", path_prefix=False)
    return out.withColumn("examples", F.array_join("examples", ","))


@query("protocol_report", f"""
WITH k AS (SELECT DISTINCT {SPLIT_SQL} AS s, source FROM documents),
o AS (SELECT 'disjoint:' || a.s || '/' || b.s AS "check", 'entity_overlap' AS code, count(*) AS count FROM k a JOIN k b ON a.source = b.source AND a.s < b.s GROUP BY 1),
c AS (SELECT 'constraint:train' AS "check", 'category_not_allowed' AS code, count(DISTINCT lang) AS count FROM documents WHERE doc_id % 10 < 7 AND lang NOT IN ('en', 'fr'))
SELECT * FROM o UNION ALL SELECT * FROM c WHERE count > 0""")
def protocol_report(spark, d):
    df = docs(spark, d)
    out = validation.protocol_issues(
        df, split_of(df), id_col="doc_id", entity_col="source", category_col="lang", part_col="split", disjoint=[("train", "dev", "test")],
        allowed={"train": ["en", "fr"], "dev": list(LANGS), "test": list(LANGS)}, covers=("train", "dev", "test"),
    )
    return out.select("check", "code", "count")


@query("geometry_check", """
SELECT 'geometry:' || (doc_id % 8)::VARCHAR AS "check", CASE WHEN doc_id % 31 = 0 THEN 'missing_ids' ELSE 'extra_ids' END AS code, count(*) AS count
FROM documents WHERE doc_id % 8 < 3 AND (doc_id % 31 = 0 OR doc_id % 37 = 0) AND NOT (doc_id % 31 = 0 AND doc_id % 37 = 0) GROUP BY ALL""")
def geometry_check(spark, d):
    df = docs(spark, d).select("doc_id", (F.col("doc_id") % 8).alias("shard"))
    local = df.where("shard < 3 AND doc_id % 31 <> 0")
    return validation.geometry_issues(df.where("doc_id % 37 <> 0"), local, id_col="doc_id").select("check", "code", "count")


@query("state_differences", """
SELECT doc_id, 'lang' AS field FROM documents WHERE doc_id % 19 = 0 AND doc_id % 23 <> 0 UNION ALL SELECT doc_id, '(row)' FROM documents WHERE doc_id % 23 = 0""")
def state_differences(spark, d):
    df = docs(spark, d).select("doc_id", "lang", "source")
    other = df.where("doc_id % 23 <> 0").withColumn("lang", F.when(F.col("doc_id") % 19 == 0, "xx").otherwise(F.col("lang")))
    return validation.value_differences(df, other, id_col="doc_id", columns=["lang", "source"])


@query("stable_keys", """
SELECT doc_id, sha256('2026|' || doc_id::VARCHAR) AS row_key, sha256('2026' || chr(0) || lang || chr(0) || source) AS entity_key,
  sha256('2026' || chr(0) || 'train' || chr(0) || lang || chr(0) || doc_id::VARCHAR) AS purpose_key FROM documents""")
def stable_keys(spark, d):
    return docs(spark, d).select(
        "doc_id", keys.row_key(SEED, F.col("doc_id")).alias("row_key"), keys.entity_key(SEED, F.col("lang"), F.col("source")).alias("entity_key"),
        keys.purpose_key(SEED, "train", F.col("lang"), F.col("doc_id")).alias("purpose_key"),
    )
