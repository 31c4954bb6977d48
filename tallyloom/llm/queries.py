"""Registered queries of the corpus operators and their SQL.

Every query applies an operator with production parameters to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, decontamination, htmltree, langid, quality, simhash, substring, tokencount, urlfilter, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def word_vocabulary() -> str:
    """Where the vocabulary file of the BPE query lies."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item it contains."""
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents with the verdict of the production policy."""
    return quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document; boundary-crossing tokens go to the line with most of their bytes."""
    import public_tokenizers

    path = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    found = tokencount.token_counts(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return found.withColumn("n_tokens", F.col("n_tokens").cast("long"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back."""
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its text without repeated sentence runs, and how many runs went."""
    done = substring.trimmed(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "text", F.col("__removed_runs").alias("removed_runs"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and decoded text."""
    return bpe.digests(table(spark, sf_dir, "documents"), word_vocabulary())


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = langid.learn(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), langid.identified(F.col("text"), model).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return htmltree.extract(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Host and path rules of the URL query.
URL_RULES = (
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's address; the trees learn from the addresses that a rule labels."""
    return urlfilter.judged(table(spark, sf_dir, "pages"), URL_RULES)


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_quality_rules": op2_quality_rules,
    "op3_token_counts": op3_token_counts,
    "op4_warc": op4_warc,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_bpe": op6_bpe,
    "op7_language_id": op7_language_id,
    "op8_html_extraction": op8_html_extraction,
    "op9_simhash": op9_simhash,
    "op10_url_filter": op10_url_filter,
}

SQL: dict[str, str] = {}

SQL["op2_quality_rules"] = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
pos AS (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS c FROM pos),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words
        FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM win WHERE c > 1) GROUP BY r),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0)::BIGINT AS n_lines,
         length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_shouts,
         length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper
  FROM w LEFT JOIN lines USING (r) LEFT JOIN rep USING (r)),
b AS (
  SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
    + 8 * (5 * n_dup_lines > 2 * n_lines)::INT + 16 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT
    + 32 * (10 * n_shouts > 3 * n_words)::INT + 64 * (2 * n_upper > word_chars)::INT)::BIGINT AS fail_bits FROM m)
SELECT *, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept FROM b
"""

SQL["op1_decontamination"] = r"""
WITH iw AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM benchmark),
ig AS (SELECT DISTINCT item_id, w, least(len(w), 5) AS k, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS gram
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM iw WHERE len(w) > 0)),
size AS (SELECT item_id, w, count(*) AS n FROM ig GROUP BY item_id, w),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM documents),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS gram
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM ig) WHERE len(w) >= k)),
hit AS (SELECT doc_id, item_id, ig.w, count(*) AS c FROM dg JOIN ig USING (gram) GROUP BY ALL)
SELECT doc_id, hit.item_id, n::BIGINT AS n_shingles, c::BIGINT AS n_shared, c::DOUBLE / n AS containment
FROM hit JOIN size ON hit.item_id IS NOT DISTINCT FROM size.item_id AND hit.w = size.w WHERE c >= 0.8::DOUBLE * n
"""

SQL["op5_substring_dedup"] = r"""
WITH u AS (
  SELECT row_number() OVER () AS r, doc_id, text,
    list_filter(regexp_extract_all(coalesce(text, ''), '(?s).*?(?:[.!?,;:]+["\x27\x{201d}\x{2019}\x{bb})\]]*[ \t\n\x0b\x0c\r]+|\n[ \t\n\x0b\x0c\r]*|\z)'), lambda x: x <> '') AS parts
  FROM documents),
p AS (SELECT r, doc_id, unnest(range(1, len(parts) + 1)) AS k, unnest(parts) AS part FROM u),
w AS (
  SELECT r, doc_id, k, regexp_extract_all(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM p WHERE regexp_matches(part, '[^\x20\x09-\x0D]')),
s AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY k) AS i,
    (sum(len(ws)) OVER (PARTITION BY r ORDER BY k))::BIGINT AS upto FROM w),
s2 AS (SELECT *, upto - len(ws) AS before FROM s),
d AS (SELECT r, doc_id, flatten(list(ws ORDER BY i)) AS words, max(i) AS n, list(before ORDER BY i) AS before, list(upto ORDER BY i) AS upto FROM s2 GROUP BY r, doc_id),
down AS (SELECT a.r, a.i AS a, greatest(b.i, a.i + 1) AS b FROM (SELECT r, i, before + 25 AS need FROM s2) a ASOF JOIN s2 b ON a.r = b.r AND a.need <= b.upto),
up AS (SELECT b.r, least(a.i, b.i - 1) AS a, b.i AS b FROM (SELECT r, i, upto - 25 AS need FROM s2) b ASOF JOIN s2 a ON a.r = b.r AND b.need >= a.before),
span AS (SELECT * FROM down UNION SELECT * FROM up),
run AS (
  SELECT span.r, doc_id, a, b, array_to_string(words[before[a] + 1 : upto[b]], ' ') AS run
  FROM span JOIN d USING (r) WHERE a >= 1 AND b <= n),
marked AS (
  SELECT *, min(doc_id) OVER (PARTITION BY run) AS first, row_number() OVER (PARTITION BY run, r ORDER BY a) AS nth FROM run),
gone AS (SELECT r, a, b FROM marked WHERE doc_id <> first OR nth > 1),
cover AS (SELECT DISTINCT r, unnest(range(a, b + 1)) AS i FROM gone),
lost AS (SELECT s.r, s.k FROM s JOIN cover USING (r, i)),
kept AS (SELECT p.r, string_agg(part, '' ORDER BY k) AS text FROM p ANTI JOIN lost USING (r, k) GROUP BY p.r),
n AS (SELECT r, count(*) AS c FROM gone GROUP BY r)
SELECT doc_id, CASE WHEN u.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text, coalesce(c, 0)::INTEGER AS removed_runs
FROM u LEFT JOIN kept USING (r) LEFT JOIN n USING (r)
"""

SQL["op4_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS hex FROM p),
s AS (
  SELECT *, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (((('0x' || substr(hex, (i // 4 * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - i % 4 * 5)::BIGINT) & 31) + 1)::BIGINT, 1)), 'string_agg', '') AS payload_digest,
    max(page_id) OVER (PARTITION BY hex) AS response
  FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM s
"""

# Holds for pages whose main text is one article without noise inside, as in the tables.
SQL["op8_html_extraction"] = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS body FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(body, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM a),
d AS (SELECT page_id, url, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&') AS t FROM t),
s AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM d)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM s
"""
