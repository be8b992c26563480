"""One query for each corpus operator, over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactspark.llm import lexical, licences, lines, mining, mixing, neardup, packing, pii, quality, shards, suffixes, topk, warc
from contactspark.llm.common import fresh_path, table


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long") + 8
    records = docs.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("group"))
    dealt = shards.assign(records, F.col("size"), F.col("group"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit(shards.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.dedup_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.assess(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), ["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classify(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.digest(table(spark, sf_dir, "documents"), ["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(joined(of(*pii.BASE)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    captures = warc.assemble(warc.read(spark, folder, payload=False))
    new = F.col("response.warc_type") == "response"
    field = lambda name: F.try_element_at("metadata.fields", F.lit(name)).cast("long")
    return captures.select(
        field("page-id").alias("page_id"),
        F.when(new, F.col("response.payload_bytes")).otherwise(field("payload-bytes")).alias("payload_bytes"),
        F.when(new, F.col("response.digest")).otherwise(F.col("response.header_digest")).alias("payload_digest"),
        F.col("response.warc_type").alias("record_type"),
        field("refers-to-page-id").alias("refers_to"),
        F.col("response.target_uri").alias("url"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    wrong = F.col("vec_id") % 7 == 0
    label = F.when(wrong, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mining.mine(vectors.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffixes.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_topk_search, op2_sharding, op3_line_dedup, op4_quality_rules, op5_minhash_neardup, op6_best_fit_packing, op7_source_mixing, op8_pii, op9_license_scan, op10_warc)
    own += (op11_hard_negatives, op12_lexical_search, op13_suffix_dedup)
    return {f.__name__: f for f in own}


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.c, c.c), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.c) = len(c.c)
),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP10_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, url, html, list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) % 32, 1)), 'string_agg', '') AS payload_digest
  FROM p
),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM d)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to, url
FROM f
"""

OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
r AS (SELECT *, row_number() OVER () AS rid FROM v),
scored AS (
  SELECT a.rid AS aid, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.c, b.c), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND b.rid <> a.rid AND len(a.c) = len(b.c)
),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY aid ORDER BY score DESC, vec_id, rid) AS turn FROM scored WHERE same) WHERE turn <= 5),
h AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER (PARTITION BY p.aid, p.turn ORDER BY n.score DESC, n.vec_id, n.rid))::INTEGER AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM p JOIN scored n ON n.aid = p.aid AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT * FROM h WHERE rank <= 3
"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
i AS (SELECT row_number() OVER () AS iid, item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
asked AS (SELECT iid, item_id, term, count(*) AS times FROM i GROUP BY ALL),
size AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
tf AS (SELECT uid, doc_id, n, term, count(*) AS tf FROM (SELECT uid, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, size GROUP BY term),
scored AS (
  SELECT iid, item_id, uid, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN w USING (term), size GROUP BY ALL
),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id))::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

OP13_SQL = """
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT uid, p, md5(b[p + 1 : p + 400]) AS h FROM (SELECT uid, b, unnest(range(0, octet_length(b) - 399)) AS p FROM d WHERE octet_length(b) >= 400)),
again AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
hit AS (SELECT uid, p, lag(p) OVER (PARTITION BY uid ORDER BY p) AS before FROM w SEMI JOIN again USING (h)),
run AS (SELECT uid, p, sum(CASE WHEN before IS NULL OR p > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY p) AS span FROM hit),
span AS (SELECT uid, span, min(p) AS a, max(p) + 400 AS z FROM run GROUP BY ALL),
cut AS (SELECT uid, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM span GROUP BY uid)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN a IS NULL THEN b ELSE unhex(list_aggregate(list_transform(range(0, len(a) + 1), lambda i: hex(b[(CASE WHEN i = 0 THEN 0 ELSE z[i] END) + 1 : CASE WHEN i = len(a) THEN octet_length(b) ELSE a[i + 1] END])), 'string_agg', '')) END) AS kept_sha256
FROM d LEFT JOIN cut USING (uid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_search": OP1_SQL, "op9_license_scan": licences.oracle(), "op10_warc": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_lexical_search": OP12_SQL, "op13_suffix_dedup": OP13_SQL}
