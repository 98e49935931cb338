"""The queries op1 to op13 over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.store import table


#: Rules of the URL query: verdict, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Host labels of the hosts on the URL query's blocklist.
BLOCKED_LABELS = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def op1_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paceline.llm.quality import quality

    return quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op2_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paceline.llm import pii

    docs = table(spark, sf_dir, "documents")
    return pii.digests(pii.detect(docs, pii.fit(docs)))


def op3_url_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paceline.llm.urls import host_and_path, judge

    pages = table(spark, sf_dir, "pages")
    listed = pages.select(host_and_path(F.col("url"))[0].alias("host")).filter(F.col("host").rlike(rf"(^|\.)({'|'.join(BLOCKED_LABELS)})\.")).distinct()
    return judge(pages, URL_RULES, listed)


def op4_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paceline.llm.edits import apply_edits, build, sample_edits

    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("edits", sample_edits())
    return apply_edits(build(docs)).select("doc_id", "n_tokens", "edited_tokens", "n_pieces", "recoded_pieces")


def op5_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paceline.llm.packing import packed

    return packed(table(spark, sf_dir, "documents"))


def op6_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paceline.llm.chat import digests, formatted

    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = F.lit("</s>[INST] ok [/INST]")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    return digests(formatted(conversations.unionByName(own)))


def op7_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paceline.llm.toxicity import fit, held_out, score

    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    scored = score(docs, fit(docs, labels.filter(~held_out())))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paceline.llm.encoding import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op9_exact_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paceline.llm.fingerprints import against_edits

    return against_edits(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paceline.llm.minhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), k=4, threshold=80)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op11_rank_matrix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paceline.llm.rowmerge import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paceline.llm.vectorcodes import compress

    return compress(table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paceline.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (op1_mcd_quality, op2_weak_supervision_pii, op3_url_bloom_cascade, op4_edit_token_counts, op5_bm25_packing, op6_chat_round_trip, op7_toxicity_grammar, op8_trie_bpe, op9_exact_digest, op10_minhash_near_dedup, op11_rank_matrix_bpe, op12_vector_codes, op13_whitening)
}

ORACLES = {
    "op3_url_bloom_cascade": r"""
WITH a AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, split_part(split_part(rest, '#', 1), '?', 1) AS rest FROM a),
c AS (SELECT page_id, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  CASE WHEN position('/' IN rest) > 0 THEN substr(rest, position('/' IN rest)) ELSE '' END AS path FROM b),
rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict
  FROM c JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT c.page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, m.rule,
  coalesce(m.verdict, CASE WHEN regexp_matches(host, '(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.') THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN m ON m.page_id = c.page_id""",
    "op6_chat_round_trip": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(text, '(\\*)(<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|\[ROLE|\[/ROLE\])', '\1\1\\\2', 'g') AS escaped FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(length(escaped) + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE 16 + length(role) END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op10_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3])) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id WHERE r.root < l.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.root) AS component_id, d.doc_id = min(r.root) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op12_vector_codes": r"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS z FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, t.j AS part, z[t.j * (len(z) // 4) + 1 : (t.j + 1) * (len(z) // 4)] AS q FROM v, (SELECT unnest(range(4)) AS j) t),
b0 AS MATERIALIZED (SELECT part, r - 1 AS e, q AS c FROM p WHERE r <= 256),
a0 AS MATERIALIZED (SELECT r, p.part, any_value(q) AS q, min(list_sum(list_transform(list_zip(q, c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT * 256 + e) AS best FROM p JOIN b0 b ON b.part = p.part GROUP BY r, p.part),
s0 AS (SELECT part, e, i, floor(sum(x) / count(*))::BIGINT AS m FROM (SELECT part, best % 256 AS e, unnest(q) AS x, unnest(range(len(q))) AS i FROM a0) GROUP BY part, e, i),
n0 AS (SELECT part, e, list(m ORDER BY i) AS c FROM s0 GROUP BY part, e),
b1 AS MATERIALIZED (SELECT b.part, b.e, coalesce(n.c, b.c) AS c FROM b0 b LEFT JOIN n0 n ON n.part = b.part AND n.e = b.e),
a1 AS MATERIALIZED (SELECT r, p.part, any_value(q) AS q, min(list_sum(list_transform(list_zip(q, c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT * 256 + e) AS best FROM p JOIN b1 b ON b.part = p.part GROUP BY r, p.part),
s1 AS (SELECT part, e, i, floor(sum(x) / count(*))::BIGINT AS m FROM (SELECT part, best % 256 AS e, unnest(q) AS x, unnest(range(len(q))) AS i FROM a1) GROUP BY part, e, i),
n1 AS (SELECT part, e, list(m ORDER BY i) AS c FROM s1 GROUP BY part, e),
b2 AS MATERIALIZED (SELECT b.part, b.e, coalesce(n.c, b.c) AS c FROM b1 b LEFT JOIN n1 n ON n.part = b.part AND n.e = b.e),
a2 AS MATERIALIZED (SELECT r, p.part, any_value(q) AS q, min(list_sum(list_transform(list_zip(q, c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT * 256 + e) AS best FROM p JOIN b2 b ON b.part = p.part GROUP BY r, p.part),
s2 AS (SELECT part, e, i, floor(sum(x) / count(*))::BIGINT AS m FROM (SELECT part, best % 256 AS e, unnest(q) AS x, unnest(range(len(q))) AS i FROM a2) GROUP BY part, e, i),
n2 AS (SELECT part, e, list(m ORDER BY i) AS c FROM s2 GROUP BY part, e),
b3 AS MATERIALIZED (SELECT b.part, b.e, coalesce(n.c, b.c) AS c FROM b2 b LEFT JOIN n2 n ON n.part = b.part AND n.e = b.e),
a3 AS MATERIALIZED (SELECT r, p.part, any_value(q) AS q, min(list_sum(list_transform(list_zip(q, c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT * 256 + e) AS best FROM p JOIN b3 b ON b.part = p.part GROUP BY r, p.part),
s3 AS (SELECT part, e, i, floor(sum(x) / count(*))::BIGINT AS m FROM (SELECT part, best % 256 AS e, unnest(q) AS x, unnest(range(len(q))) AS i FROM a3) GROUP BY part, e, i),
n3 AS (SELECT part, e, list(m ORDER BY i) AS c FROM s3 GROUP BY part, e),
b4 AS MATERIALIZED (SELECT b.part, b.e, coalesce(n.c, b.c) AS c FROM b3 b LEFT JOIN n3 n ON n.part = b.part AND n.e = b.e),
a4 AS MATERIALIZED (SELECT r, p.part, any_value(q) AS q, min(list_sum(list_transform(list_zip(q, c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT * 256 + e) AS best FROM p JOIN b4 b ON b.part = p.part GROUP BY r, p.part),
o AS (SELECT r, string_agg(lpad(to_hex(best % 256), 2, '0'), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM a4 GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b4)
SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN o ON o.r = v.r, h""",
}
