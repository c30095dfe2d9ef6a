"""The thin queries of the operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, filter_audit, importance, jaccard, licenses, maxent, media, packing, pii, quality, sharding, suffixes, toxicity
from .common import documents


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    judged = quality.judge(docs, quality.learn(docs, labels(spark, sf_dir)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(documents(spark, sf_dir), form="sha256")
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_texts(documents(spark, sf_dir), keep_media=False)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return licenses.scan_licenses(docs, licenses.word_weights(docs))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return bytebpe.encode_texts(documents(spark, sf_dir), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN, keep_ids=False, digests=True)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digest(pii.find_spans(documents(spark, sf_dir), pii.train(spark)))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.kd_shards(documents(spark, sf_dir), n_shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.language_model(docs)
    weights, prior = toxicity.learn(docs, labels(spark, sf_dir), model)
    scored = toxicity.score(docs, model, weights, prior)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return packing.pack_documents(documents(spark, sf_dir), tokenizers.path("word_bpe_49k.json"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_texts(documents(spark, sf_dir))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), labels(spark, sf_dir))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return importance.resample(documents(spark, sf_dir), benchmark).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_suffix_dedup, op3_media_columns, op4_license_scan, op5_byte_bpe, op6_pii, op7_ngram_jaccard, op8_sharding, op9_toxicity, op10_best_fit_packing, op11_lm_scoring, op12_filter_audit, op13_importance_resampling)}
#: The results that can be written in SQL as a whole; tests hold the base columns of the others against brute force.
ORACLES: dict[str, str] = {
    "op2_suffix_dedup": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
 c AS (SELECT r, c * 2000 AS base, substr(h, c * 4000 + 1, 4798) AS part FROM d, unnest(range(0, len(h) // 4000 + 1)) AS t(c)),
 s AS (SELECT r, base + i AS i, md5(substr(part, 2 * i + 1, 800)) AS w FROM c, unnest(range(0, least(2000, len(part) // 2 - 399))) AS t(i)),
 g AS (SELECT r, i FROM s JOIN (SELECT w FROM s GROUP BY w HAVING count(*) > 1) USING (w)),
 n AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM g),
 l AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM n),
 u AS (SELECT r, min(i) AS low, max(i) + 400 AS high FROM l GROUP BY r, run),
 a AS (SELECT r, sum(high - low) AS removed, count(*) AS spans, max(high) AS last FROM u GROUP BY r),
 k AS (SELECT r, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS low, low AS high FROM u UNION ALL SELECT d.r, coalesce(a.last, 0), len(d.h) // 2 FROM d LEFT JOIN a USING (r)),
 t AS (SELECT r, string_agg(substr(h, 2 * low + 1, 2 * (high - low)), '' ORDER BY low) AS kept FROM k JOIN d USING (r) GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN t USING (r) LEFT JOIN a USING (r)""",
    "op3_media_columns": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 p AS (SELECT doc_id, len(h) // 2 AS n_bytes, h || repeat('20', CAST(CASE WHEN h = '' THEN 192 ELSE (192 - len(h) // 2 % 192) % 192 END AS INTEGER)) AS x FROM d),
 b AS (SELECT *, len(x) // 2 AS n, list_transform(regexp_extract_all(x, '..'), lambda y: 16 * (strpos('0123456789ABCDEF', y[1]) - 1) + strpos('0123456789ABCDEF', y[2]) - 1) AS v FROM p),
 m AS (SELECT *, '52494646' || printf('%02X%02X%02X%02X', (n + 36) & 255, (n + 36) >> 8 & 255, (n + 36) >> 16 & 255, (n + 36) >> 24 & 255) || '57415645666D74201000000001000100401F0000401F00000100080064617461' || printf('%02X%02X%02X%02X', n & 255, n >> 8 & 255, n >> 16 & 255, n >> 24 & 255) || x AS f,
  list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(v[-16:], lambda y: list_transform(range(8), lambda k: (y >> k::INTEGER & 1)::BIGINT)))), lambda c, y: xor(c >> 1, CASE WHEN xor(c, y) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)) AS crc FROM b)
SELECT doc_id, n_bytes, n AS payload_bytes, sha256(unhex(x)) AS payload_sha256, xor(crc, 4294967295::BIGINT) AS tail_crc32, len(f) // 2 AS media_bytes, sha256(unhex(f)) AS media_sha256,
 'audio/wav;rate=8000;samples=' || n || ';low=' || list_min(v) || ';high=' || list_max(v) || ';sum=' || list_sum(v) || ';embedded=none' AS feature FROM m""",
    "op7_ngram_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= 80 * (x.n + y.n - both_have)),
 r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.root) AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id""",
    "op12_filter_audit": r"""
WITH x AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
 w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM x),
 y AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
 m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b, 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t) AS c,
   regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w LEFT JOIN y USING (doc_id)),
 k AS (SELECT part, good, toxic, [a, b, c, d, e] AS fails, count(*) AS n FROM m GROUP BY ALL),
 l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
 o AS (SELECT p.f || q.f || r.f || s.f || u.f AS filter_order FROM l p JOIN l q ON q.f <> p.f JOIN l r ON r.f NOT IN (p.f, q.f) JOIN l s ON s.f NOT IN (p.f, q.f, r.f) JOIN l u ON u.f NOT IN (p.f, q.f, r.f, s.f)),
 g AS (SELECT filter_order, step, ascii(filter_order[step]) - 64 AS place FROM o, unnest([1, 2, 3, 4, 5]) AS t(step)),
 h AS (SELECT *, list_position(list_transform(string_split(filter_order, ''), lambda z: fails[ascii(z) - 64]), true) AS first FROM g, k),
 v AS (SELECT part, filter_order, step, place, sum(CASE WHEN first IS NULL OR first > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN first = step THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails[place] AND first < step THEN n ELSE 0 END) AS redundant,
   sum(CASE WHEN fails[place] AND len(list_filter(fails, lambda z: z)) = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN first = step THEN n * good ELSE 0 END) AS good_lost, sum(CASE WHEN first = step THEN n * toxic ELSE 0 END) AS toxic_lost FROM h GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
 CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, place) AS BIGINT) AS shapley FROM v""",
    "op13_importance_resampling": r"""
WITH x AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
 y AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
 p AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM x) GROUP BY ALL),
 a AS (SELECT w, sum(n) AS n FROM p GROUP BY w), b AS (SELECT w, count(*) AS n FROM y GROUP BY w),
 h AS (SELECT w, list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda c: 16 * (strpos('0123456789ABCDEF', c[1]) - 1) + strpos('0123456789ABCDEF', c[2]) - 1) AS v FROM (SELECT w FROM a UNION SELECT w FROM b)),
 c AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(v, lambda z: list_transform(range(8), lambda k: (z >> k::INTEGER & 1)::BIGINT)))), lambda c, z: xor(c >> 1, CASE WHEN xor(c, z) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)), 4294967295::BIGINT) % 10000 AS bucket FROM h),
 s AS (SELECT bucket, sum(n) AS n FROM a JOIN c USING (w) GROUP BY 1), t AS (SELECT bucket, sum(n) AS n FROM b JOIN c USING (w) GROUP BY 1),
 u AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM a) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM b), 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
 g AS (SELECT doc_id, sum(n * gain) AS weight FROM p JOIN c USING (w) JOIN u USING (bucket) GROUP BY 1),
 f AS (SELECT doc_id, len(ws) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM x LEFT JOIN g USING (doc_id)),
 e AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM f),
 r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM e WHERE n_features >= 20)
SELECT e.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM r) THEN rank END AS rank FROM e LEFT JOIN r USING (doc_id)""",
}
