"""Stable order, allocation, splits, quotas, and ordered-sequence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import keys
from tallyloom.operators import dedup, sampling, windows
from tallyloom.plans.integrity import LANGS, SEED, SPLIT_SQL, docs, hashed, split_of
from tallyloom.plans.registry import query, table


@query("stable_key_topk", "SELECT doc_id, lang FROM documents ORDER BY sha256('2026|' || doc_id::VARCHAR), doc_id::VARCHAR LIMIT 50")
def stable_key_topk(spark, d):
    return sampling.first_by_key(docs(spark, d).select("doc_id", "lang"), SEED, 50, "doc_id")


@query("topk_per_group", """
SELECT lang, doc_id, rank::INT AS rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR), doc_id) AS rank FROM documents) WHERE rank <= 5""")
def topk_per_group(spark, d):
    return windows.top_per_group(docs(spark, d).select("lang", "doc_id"), ["lang"], [F.sha2(F.col("doc_id").cast("string"), 256), F.col("doc_id")], 5)


@query("round_robin_balanced_subset", """
WITH k AS (SELECT doc_id, lang, sha256('2026' || chr(0) || 'dev' || chr(0) || lang || chr(0) || doc_id::VARCHAR) AS k,
    sha256('2026' || chr(0) || 'dev' || chr(0) || 'manifest' || chr(0) || doc_id::VARCHAR) AS m FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY k, doc_id::VARCHAR) AS rn FROM k),
pos AS (SELECT doc_id, lang, m FROM r WHERE lang <> 'en' ORDER BY rn, list_position(['fr', 'de', 'es'], lang) LIMIT 40),
neg AS (SELECT doc_id, lang, m FROM r WHERE lang = 'en' ORDER BY rn LIMIT 40)
SELECT doc_id, lang, (row_number() OVER (ORDER BY m, doc_id::VARCHAR) - 1)::INT AS position FROM (SELECT * FROM pos UNION ALL SELECT * FROM neg)""")
def round_robin_balanced_subset(spark, d):
    return sampling.balanced_subset(docs(spark, d).select("doc_id", "lang"), SEED, "dev", 40, id_col="doc_id", category_col="lang", negative="en", positives=("fr", "de", "es"))


@query("largest_remainder", """
WITH w AS (SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS w FROM orders GROUP BY ALL),
f AS (SELECT *, 1000 * w // sum(w) OVER (PARTITION BY s) AS fl, (1000 * w) % sum(w) OVER (PARTITION BY s) AS rest FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY rest DESC, p) AS rn, 1000 - sum(fl) OVER (PARTITION BY s) AS lft FROM f)
SELECT s AS o_orderstatus, p AS o_orderpriority, w AS rows, (fl + CASE WHEN rn <= lft THEN 1 ELSE 0 END)::BIGINT AS quota FROM k""")
def largest_remainder(spark, d):
    w = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("rows"))
    return sampling.largest_remainder(w, ["o_orderstatus"], "rows", F.lit(1000), [F.col("o_orderpriority")])


QUOTA_SQL = f"""
WITH g AS (SELECT s.v AS split, s.o AS so, c.v AS lang, c.o AS co FROM (SELECT unnest(['train', 'dev', 'test']) AS v, unnest([0, 1, 2]) AS o) s,
  (SELECT unnest(['en', 'fr', 'de', 'es']) AS v, unnest([0, 1, 2, 3]) AS o) c),
n AS (SELECT g.*, coalesce(k, 0) AS n FROM g LEFT JOIN (SELECT {SPLIT_SQL} AS split, lang, count(*) AS k FROM documents GROUP BY ALL) USING (split, lang)),
z AS (SELECT split, so, sum(n) AS size FROM n GROUP BY ALL),
zf AS (SELECT *, 200 * size // sum(size) OVER () AS fl, (200 * size) % sum(size) OVER () AS rest FROM z),
zq AS (SELECT split, fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, so) <= 200 - sum(fl) OVER () THEN 1 ELSE 0 END AS sq FROM zf),
cf AS (SELECT n.*, sq, sq * n // sum(n) OVER (PARTITION BY split) AS fl, (sq * n) % sum(n) OVER (PARTITION BY split) AS rest FROM n JOIN zq USING (split)),
q AS (SELECT split, lang, (fl + CASE WHEN row_number() OVER (PARTITION BY split ORDER BY rest DESC, co) <= sq - sum(fl) OVER (PARTITION BY split) THEN 1 ELSE 0 END)::BIGINT AS quota FROM cf)
"""


def _quotas(spark, d):
    full = split_of(docs(spark, d)).select("doc_id", "split", "lang")
    return sampling.two_level_quota(full, 200, split_col="split", category_col="lang", splits=("train", "dev", "test"), categories=LANGS)


@query("two_level_quota", QUOTA_SQL + "SELECT * FROM q")
def two_level_quota(spark, d):
    return _quotas(spark, d)


SAMPLE_SQL = QUOTA_SQL + f""", h AS (SELECT doc_id, {SPLIT_SQL} AS split, lang, sha256(text) AS h, sha256('2026|' || doc_id::VARCHAR) AS k FROM documents),
kept AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY h ORDER BY k, doc_id::VARCHAR) = 1)
"""


def _eligible(spark, d):
    return dedup.content_representatives(hashed(spark, d), SEED, hash_col="h", id_col="doc_id").where("kept").select("doc_id", "split", "lang")


@query("quota_sample_dedup", SAMPLE_SQL + """
SELECT split, lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY split, lang ORDER BY k, doc_id::VARCHAR) AS rn FROM kept) JOIN q USING (split, lang) WHERE rn <= quota""")
def quota_sample_dedup(spark, d):
    return sampling.quota_sample(_eligible(spark, d), _quotas(spark, d), SEED, id_col="doc_id", by=["split", "lang"])


@query("shortfall_report", SAMPLE_SQL + """
SELECT split, lang, quota * 9 AS required, coalesce(a, 0) AS available, quota * 9 - coalesce(a, 0) AS missing
FROM q LEFT JOIN (SELECT split, lang, count(*) AS a FROM kept GROUP BY ALL) USING (split, lang) WHERE coalesce(a, 0) < quota * 9""")
def shortfall_report(spark, d):
    quotas = _quotas(spark, d).withColumn("quota", F.col("quota") * 9)
    return sampling.shortfalls(_eligible(spark, d), quotas, ["split", "lang"])


SPLIT_ENTITY_SQL = """
WITH e AS (SELECT o_custkey::VARCHAR AS entity, CASE list_sort(list(DISTINCT o_orderstatus)) WHEN ['F'] THEN 'done' WHEN ['O'] THEN 'open' WHEN ['F', 'O'] THEN 'both' ELSE 'other' END AS stratum FROM orders GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('2026' || chr(0) || stratum || chr(0) || entity), entity) AS rn, count(*) OVER (PARTITION BY stratum) AS n FROM e),
x AS (SELECT *, n * 0.7::DOUBLE AS a, n * 0.15::DOUBLE AS b FROM r),
f AS (SELECT *, floor(a)::BIGINT AS fa, floor(b)::BIGINT AS fb, a - floor(a) AS ra, b - floor(b) AS rb FROM x),
g AS (SELECT *, n - fa - 2 * fb AS lft, (rb > ra)::INT * 2 AS ka, (ra >= rb)::INT AS kb FROM f),
h AS (SELECT *, fa + (ka < lft)::INT AS na, fb + (kb < lft)::INT AS nb FROM g),
s AS (SELECT entity, stratum, CASE WHEN rn <= na THEN 'train' WHEN rn <= na + nb THEN 'dev' ELSE 'test' END AS split FROM h)
"""


def _assigned(spark, d):
    statuses = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("entity")).agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), "").alias("p"))
    stratum = F.when(F.col("p") == "F", "done").when(F.col("p") == "O", "open").when(F.col("p") == "FO", "both").otherwise("other")
    return sampling.split_entities(statuses.select("entity", stratum.alias("stratum")), SEED)


@query("entity_split_assignment", SPLIT_ENTITY_SQL + "SELECT * FROM s")
def entity_split_assignment(spark, d):
    return _assigned(spark, d)


RULES = (
    ("closed_train", "train", (), ()), ("closed_dev", "dev", (), ()), ("closed_test", "test", (), ()), ("open_unseen_other", "*", ("other",), ("F", "P")),
    ("open_train", "train", ("done", "open", "both"), ("F", "O")), ("open_dev", "dev", ("done", "open", "both"), ("F", "O")), ("open_seen_test", "test", ("done", "open", "both"), ("F",)),
)


@query("protocol_partitions", SPLIT_ENTITY_SQL + """
, r2 AS (SELECT o_orderkey, o_orderstatus AS c, stratum, split FROM orders JOIN s ON entity = o_custkey::VARCHAR)
SELECT partition, count(*) AS rows, sum(o_orderkey)::BIGINT AS keys FROM (
  SELECT 'closed_' || split AS partition, o_orderkey FROM r2
  UNION ALL SELECT 'open_unseen_other', o_orderkey FROM r2 WHERE stratum = 'other' AND c IN ('F', 'P')
  UNION ALL SELECT 'open_' || split, o_orderkey FROM r2 WHERE stratum <> 'other' AND split IN ('train', 'dev') AND c IN ('F', 'O')
  UNION ALL SELECT 'open_seen_test', o_orderkey FROM r2 WHERE stratum <> 'other' AND split = 'test' AND c = 'F') GROUP BY 1""")
def protocol_partitions(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("c"), "o_orderstatus")
    parts = sampling.protocol_partitions(orders, _assigned(spark, d), RULES, entity_col="c", category_col="o_orderstatus")
    return parts.groupBy("partition").agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys"))


@query("epoch_batches_resume", """
WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('2026:3:' || doc_id::VARCHAR), doc_id::VARCHAR) - 1 AS position FROM documents)
SELECT doc_id, position, position // 32 AS batch FROM p WHERE position // 32 >= 5 AND (position // 32 + 1) * 32 <= (SELECT count(*) FROM documents)""")
def epoch_batches_resume(spark, d):
    return sampling.epoch_batches(docs(spark, d).select("doc_id"), SEED, 3, 32, id_col="doc_id", cursor=5, drop_last=True)


@query("even_and_strided_positions", """
WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
SELECT lang, unnest([i * (n - 1) // 6 for i in range(7)])::BIGINT AS even, unnest([least(i * 50, n - 1) for i in range(7)])::BIGINT AS strided FROM n""")
def even_and_strided_positions(spark, d):
    n = docs(spark, d).groupBy("lang").agg(F.count("*").alias("n"))
    both = F.arrays_zip(sampling.even_positions(F.col("n"), 7).alias("even"), sampling.strided_positions(F.col("n"), 50, 7).alias("strided"))
    return n.select("lang", F.inline(both).alias("even", "strided"))


@query("head_with_both_classes", """
WITH t AS (SELECT doc_id, CASE WHEN lang = 'es' THEN 1 ELSE 0 END AS target FROM documents),
h AS (SELECT * FROM t ORDER BY doc_id LIMIT 12), lack AS (SELECT target, min(doc_id) AS doc_id FROM t WHERE target NOT IN (SELECT target FROM h) GROUP BY target)
SELECT * FROM (SELECT * FROM h ORDER BY doc_id LIMIT (SELECT 12 - count(*) FROM lack)) UNION ALL SELECT doc_id, target FROM lack""")
def head_with_both_classes(spark, d):
    df = docs(spark, d).select("doc_id", F.when(F.col("lang") == "es", 1).otherwise(0).alias("target"))
    return sampling.head_with_both(df, 12, index_col="doc_id", target_col="target")


@query("class_representatives", "SELECT lang, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) = 1")
def class_representatives(spark, d):
    return sampling.representatives(docs(spark, d).select("lang", "doc_id", "n_chars"), "lang", [F.col("n_chars").desc(), F.col("doc_id")])


@query("gap_check", """
WITH x AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders),
y AS (SELECT * FROM x WHERE (o_orderkey + i) % 11 <> 0), l AS (SELECT *, coalesce(lag(i) OVER w + 1, 0) AS ei, coalesce(lag(i * 5 + 5) OVER w, 0) AS eo FROM y WINDOW w AS (PARTITION BY o_custkey ORDER BY i))
SELECT o_custkey, i::BIGINT AS i, ei::BIGINT AS expected_index, eo::BIGINT AS expected_offset FROM l WHERE i <> ei OR i * 5 <> eo""")
def gap_check(spark, d):
    from pyspark.sql import Window

    x = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("long").alias("i"))
    y = x.where("(o_orderkey + i) % 11 <> 0").withColumns({"off": F.col("i") * 5, "len": F.lit(5).cast("long")})
    return windows.sequence_gaps(y, ["o_custkey"], "i", "off", "len").select("o_custkey", "i", "expected_index", "expected_offset")


@query("best_so_far_patience", """
WITH a AS (SELECT user_id, event_id, value, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events),
i AS (SELECT *, b IS NULL OR value < b AS improved, sum((b IS NULL OR value < b)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM a),
s AS (SELECT user_id, event_id, improved, least(value, coalesce(b, value)) AS best, row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) - 1 AS stale FROM i)
SELECT user_id, event_id, best, improved, stale::INT AS stale, stale >= 3 AS stop FROM s""")
def best_so_far_patience(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    return windows.best_so_far(e, ["user_id"], ["event_id"], "value", 3).select("user_id", "event_id", "best", "improved", "stale", "stop")


@query("consecutive_failure_stop", """
WITH f AS (SELECT user_id, event_id, (value < 20)::INT AS f FROM events),
i AS (SELECT *, sum(1 - f) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM f),
r AS (SELECT *, sum(f) OVER (PARTITION BY user_id, island ORDER BY event_id) AS run FROM i)
SELECT user_id, event_id, run::BIGINT AS run, coalesce(max((run >= 2)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS stopped FROM r""")
def consecutive_failure_stop(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    return windows.failure_runs(e, ["user_id"], ["event_id"], F.col("value") < 20, 2).select("user_id", "event_id", "run", "stopped")


@query("crop_seeds", """
SELECT doc_id, ('0x' || substr(sha256('2026:3:' || doc_id::VARCHAR), 1, 16))::UBIGINT::VARCHAR AS seed FROM documents""")
def crop_seeds(spark, d):
    return docs(spark, d).select("doc_id", keys.crop_seed(SEED, 3, F.col("doc_id")).cast("string").alias("seed"))
