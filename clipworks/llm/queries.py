"""Registered queries of this package, one per operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipworks.llm import alignment, ann, embedding_dedup, line_dedup, lm, minhash, mixing, pieces, quality, secrets, spelling, toxicity, url_filter
from clipworks.llm.frames import read
from clipworks.plans.registry import query


@query("op9_minhash_near_dedup")
def op9(spark, sf_dir):
    out = minhash.near_duplicates(read(spark, sf_dir, "documents"), width=2, percent=80)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


@query("op3_toxicity")
def op3(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    index = toxicity.fit(docs, labels, keep=~toxicity.held_out())
    out = toxicity.score_texts(docs.select("doc_id", "text"), index)
    score = F.col("toxicity.score")
    return out.select("doc_id", toxicity.held_out().alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.size("toxicity.neighbours").alias("n_neighbours"))


@query("op6_mix_sources", """WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, sqrt(n) / (SELECT sum(sqrt(n)) FROM n) * (SELECT sum(n) FROM n) / n AS rate FROM n),
points AS (SELECT d.doc_id, d.source, d.text, rate, ('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, '') || ':0'), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
terms AS (SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM rates, (SELECT unnest(range(80)) AS k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
counted AS (SELECT doc_id, p.source, text, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM p.source AND c <= u) AS n_copies FROM points p),
copies AS (SELECT *, unnest(range(n_copies)) AS copy FROM counted)
SELECT doc_id, source, copy, n_copies, md5('11:order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy) AS shuffle_key, md5(text) AS text_md5 FROM copies""")
def op6(spark, sf_dir):
    return mixing.mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "source", "copy", "n_copies", "shuffle_key", F.md5("text").alias("text_md5"))


@query("op10_line_dedup")
def op10(spark, sf_dir):
    out = line_dedup.dedup_runs(read(spark, sf_dir, "documents"), drop_emptied=False)
    return out.select("doc_id", "removed_lines", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("text_md5"))


@query("op1_sentencepiece")
def op1(spark, sf_dir):
    out = pieces.encode_texts(read(spark, sf_dir, "documents").select("doc_id", "text"))
    out = out.withColumn("decoded", pieces.decode_column(F.col("piece_ids")))
    return out.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), F.xxhash64("piece_ids").alias("ids_hash"),
                      (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"), F.md5("decoded").alias("decoded_md5"))


@query("op4_quality")
def op4(spark, sf_dir):
    measured = quality.measure(read(spark, sf_dir, "documents"))
    out = quality.score(measured, quality.fit(measured, read(spark, sf_dir, "labels"), keep=~quality.held_out()))
    score = F.col("quality_score")
    return out.select(F.col("id").alias("doc_id"), quality.held_out("id").alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


@query("op7_embedding_near_dedup")
def op7(spark, sf_dir):
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@query("op5_secret_scan")
def op5(spark, sf_dir):
    out = secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "no", F.md5("value").alias("value_md5"), F.length("value").alias("length"), F.round("score", 6).alias("score"), "is_secret")


@query("op2_lm_scoring")
def op2(spark, sf_dir):
    out = lm.score_texts(read(spark, sf_dir, "documents"), keep=~lm.held_out())
    return out.select(F.col("id").alias("doc_id"), (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op8_nearest_neighbours")
def op8(spark, sf_dir):
    out = ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return out.withColumnRenamed("id", "vec_id")


@query("op12_cross_tokenizer")
def op12(spark, sf_dir):
    return alignment.link_statistics(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op13_spelling_variants")
def op13(spark, sf_dir):
    return spelling.spelling_variants(read(spark, sf_dir, "documents"), every=199)


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query("op11_url_filter", r"""WITH RECURSIVE rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
urls AS (SELECT row_number() OVER () AS r, page_id, html, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
ruled AS (SELECT r, max_by({'rule': s.host || s.path, 'verdict': s.verdict}, length(s.host || s.path)) AS best FROM urls u JOIN rules s ON (u.host = s.host OR ends_with(u.host, '.' || s.host)) AND starts_with(u.path, s.path) GROUP BY r),
judged AS (SELECT u.*, best.rule AS rule, best.verdict AS verdict FROM urls u LEFT JOIN ruled USING (r)),
linked AS (SELECT DISTINCT r, host AS src, translate(unnest(regexp_extract_all(html, '\b(?:href|src|action|cite)\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^\s"''<>/?#\\]+)', 1, 'i')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM urls WHERE host <> ''),
edges AS (SELECT src, dst, count(*) AS n FROM linked WHERE src <> dst GROUP BY ALL),
shares AS (SELECT 'trust' AS kind, src AS node, dst AS goal, n / sum(n) OVER (PARTITION BY src) AS share FROM edges
  UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM edges),
seeds AS (SELECT host AS node, avg((verdict = 'allow')::INT) AS trust, avg((verdict = 'block')::INT) AS distrust FROM judged WHERE verdict IS NOT NULL AND host <> '' GROUP BY host),
walk AS (SELECT 0 AS k, 'trust' AS kind, node, trust * 0.15::DOUBLE AS x FROM seeds WHERE trust > 0 UNION ALL SELECT 0, 'distrust', node, distrust * 0.15::DOUBLE FROM seeds WHERE distrust > 0
  UNION ALL (SELECT k + 1, w.kind, goal, sum(x * share) * 0.85::DOUBLE FROM walk w JOIN shares s ON w.kind = s.kind AND w.node = s.node WHERE k < 40 AND x >= 1e-6 GROUP BY k, w.kind, goal)),
scores AS (SELECT node, sum(x) FILTER (kind = 'trust') AS trust, sum(x) FILTER (kind = 'distrust') AS distrust FROM walk GROUP BY node)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN scores ON host = node""")
def op11(spark, sf_dir):
    return url_filter.judge(read(spark, sf_dir, "pages"), URL_RULES).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")
