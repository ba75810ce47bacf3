"""Queries of the training-data operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, importance, licenses, media_chunks, mixing, ngram_join, packing, suffix_dedup, token_blocks, tool_calls, toxicity, warc, whitening

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.chunked_media(table(spark, sf_dir, "documents"))


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.linked_conversations(table(spark, sf_dir, "conversations"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), 1024, 2)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), 400, words=50)


def op5_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.token_documents(table(spark, sf_dir, "documents"), tokenizer_path(), 2)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_digests(table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), 5, 0.8)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"), 4)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 25, 20, 2, 10_000, 7)


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), (5, 2, 1), 1.5, 2)


QUERIES = {f.__name__: f for f in (op1_media_chunks, op2_tool_calls, op3_best_fit_packing, op4_suffix_dedup, op5_token_blocks, op6_warc, op7_decontamination, op8_ngram_join, op9_license_scan, op10_toxicity, op11_whitening, op12_importance, op13_source_mix)}


ORACLE_SQL = {
    "op2_tool_calls": """
WITH RECURSIVE t AS (SELECT *, len(string_split(text, ' ')) AS words, string_split(text, ' ')[1] AS word FROM conversations),
c AS (
  SELECT conv_id, 'turn-' || turn AS call_id, turn AS position, CASE role WHEN 'user' THEN 'reply' ELSE 'configure' END AS name, true AS valid,
    '{"chars":' || length(text) || ',"text":' || to_json(text) || ',"turn":' || turn || '}' AS args, words > 20 AS nested,
    role = 'user' AND turn >= 2 AND conv_id % 4 <> 1 AS back, role = 'user' AND conv_id % 4 IN (1, 2) AS forth FROM t WHERE role IN ('user', 'system')
  UNION ALL SELECT conv_id, 'turn-' || turn || '/lookup', turn, 'lookup', conv_id % 7 <> 3 AND turn % 3 > 0,
    CASE WHEN conv_id % 7 <> 3 THEN '{"limit":' || CASE WHEN turn % 3 = 0 THEN '"' || words || '"' ELSE words::VARCHAR END || ',"word":' || to_json(word) || '}' END, false, false, false FROM t WHERE role IN ('user', 'system') AND words > 20),
e AS (SELECT conv_id, call_id, 'turn-' || (position - 2) AS need FROM c WHERE back UNION ALL SELECT conv_id, call_id, 'turn-' || (position + 2) FROM c WHERE forth UNION ALL SELECT conv_id, call_id, call_id || '/lookup' FROM c WHERE nested),
p AS (SELECT conv_id, call_id, call_id AS at, position, 0 AS d FROM c
  UNION SELECT p.conv_id, p.call_id, c.call_id, c.position, d + 1 FROM p JOIN e ON e.conv_id = p.conv_id AND e.call_id = p.at JOIN c ON c.conv_id = e.conv_id AND c.call_id = e.need WHERE d < 40),
k AS (SELECT conv_id, call_id, max((position, d)) AS k, max(d) = 40 AS cyclic FROM p GROUP BY ALL),
m AS (SELECT e.conv_id, e.call_id, count(*) AS missing FROM e ANTI JOIN c ON c.conv_id = e.conv_id AND c.call_id = e.need GROUP BY ALL),
r AS (SELECT conv_id, 'turn-' || (turn - 1) AS call_id, text AS content FROM t WHERE role = 'assistant' UNION ALL SELECT conv_id, 'turn-' || turn || '/lookup', word FROM t WHERE role IN ('user', 'system') AND words > 20 AND words % 2 = 0)
SELECT c.conv_id, c.call_id, c.name, CASE WHEN NOT cyclic THEN row_number() OVER (PARTITION BY c.conv_id, cyclic ORDER BY k, c.call_id) END AS step, r.call_id IS NOT NULL AS linked, c.valid, coalesce(m.missing, 0)::BIGINT AS missing, cyclic,
  '{"arguments":' || coalesce(args, 'null') || ',"id":"' || c.call_id || '","name":"' || c.name || '","result":' || coalesce(to_json(r.content)::VARCHAR, 'null') || '}' AS message
FROM c JOIN k USING (conv_id, call_id) LEFT JOIN m USING (conv_id, call_id) LEFT JOIN r USING (conv_id, call_id)""",
    "op6_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, d.h AS payload_digest,
       CASE WHEN n >= 100 AND f.first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND f.first <> page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f ON d.h = f.h""",
    "op9_license_scan": licenses.scan_sql(),
    "op12_importance": r"""
WITH RECURSIVE bits AS (SELECT i, i AS c, 0 AS step FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE step = 8),
w AS (SELECT 'd' AS side, row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 't', row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT side, r, unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS f FROM w),
h AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
b AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(h, 2 * i + 1, 2))::BIGINT FOR i IN range(len(h) // 2)]), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM h, tab),
n AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t FROM f JOIN b USING (f) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((sum(s) OVER ())::DOUBLE + 10000) / ((s + 1)::DOUBLE * ((sum(t) OVER ())::DOUBLE + 10000))))::BIGINT AS gain FROM n),
k AS (SELECT r, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM f JOIN b USING (f) JOIN g USING (bucket) WHERE side = 'd' GROUP BY r),
c AS (SELECT doc_id, r, len(w) >= 20 AS may, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM w LEFT JOIN k USING (r) WHERE side = 'd'),
o AS (SELECT *, row_number() OVER (ORDER BY may DESC, score DESC, doc_id NULLS LAST, r) AS k, (sum(may::INT) OVER () * 25 // 100) AS drawn FROM c)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN k <= drawn THEN k END AS rank FROM o""",
    "op13_source_mix": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place FROM documents),
w AS (SELECT source, sum(size)::BIGINT AS source_size, ([5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1])::DOUBLE AS weight FROM d GROUP BY source),
l AS (SELECT *, 2 * source_size / weight AS dry, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER below, 0)::DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0)) AS level
  FROM w WINDOW below AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, weight, least(2 * source_size::DOUBLE, coalesce(weight * (SELECT min_by(level, dry) FROM l WHERE dry > level), 2 * source_size::DOUBLE)) AS target FROM l),
q AS (SELECT d.r, d.doc_id, d.size, d.place, d.source, t.source_size, t.weight, t.target, turn, sum(d.size) OVER (PARTITION BY d.source, turn ORDER BY d.place, d.r) + turn * t.source_size AS served
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source CROSS JOIN range(2) e(turn)),
p AS (SELECT *, size AS words FROM q WHERE NOT (floor(target) > served - size AND floor(target) < served)
  UNION ALL BY NAME SELECT * REPLACE (floor(target)::BIGINT AS served), floor(target)::BIGINT - served + size AS words FROM q WHERE floor(target) > served - size AND floor(target) < served
  UNION ALL BY NAME SELECT *, served - floor(target)::BIGINT AS words FROM q WHERE floor(target) > served - size AND floor(target) < served),
o AS (SELECT *, sum(words) OVER (ORDER BY served / weight, source NULLS LAST, turn, place, r, served ROWS UNBOUNDED PRECEDING) AS through, floor(1.5 * (SELECT sum(size) FROM d)) AS budget FROM p)
SELECT doc_id, size, source_size, target, sum(least(words, greatest(budget - (through - words), 0)))::BIGINT AS taken FROM o GROUP BY r, doc_id, size, source_size, target""",
}
