"""The registered queries of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, collocations, conversations, embedding_dedup, exact_dedup, language_id, line_dedup, media, near_dup, packing, sharding, token_counts, toxicity
from .common import crc_mod


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.text_media(_documents(spark, sf_dir)))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_common_lines(_documents(spark, sf_dir).select("doc_id", "text"), min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_documents(spark, sf_dir), shards=40)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_mod(F.col("doc_id"), 4) != 2)
    return toxicity.score_texts(docs, model).select(
        "doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_documents(spark, sf_dir), shingle=4, percent=80)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = language_id.train(docs, crc_mod(F.col("doc_id"), 5) != 0)
    return language_id.predict_texts(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.98)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(conversations.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")), gone_col="gone")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_media,
        op2_token_counts,
        op3_byte_bpe,
        op4_line_dedup,
        op5_packing,
        op6_sharding,
        op7_toxicity,
        op8_near_dup,
        op9_language_id,
        op10_embedding_dedup,
        op11_collocations,
        op12_conversation_repair,
        op13_exact_dedup,
    )
}

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES = {
    "op4_line_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {_SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY r, doc_id""",
    "op8_near_dup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n_shingles FROM s),
e AS (SELECT DISTINCT doc_id, unnest(sh) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * shared >= 80 * (u.n_shingles + v.n_shingles - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept
FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n_shingles""",
    "op10_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(any_value(n.n_links), 0) AS n_links, min(r.b) AS component_id, e.vec_id = min(r.b) AS kept
FROM embeddings e JOIN r ON r.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id GROUP BY e.vec_id""",
    "op11_collocations": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
k AS (SELECT lang, ws, unnest(range(1, 6)) AS k FROM w WHERE len(ws) > 0),
o AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM k WHERE len(ws) >= k),
f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM o GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (
  SELECT c.lang, c.k, c.phrase, c.a, x.a AS l, y.a AS r, n.n, cut, ((1000::HUGEINT * c.a * n.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM c JOIN n ON n.lang = c.lang JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
m AS (
  SELECT b.lang, b.phrase FROM b JOIN f q ON q.lang = b.lang AND q.k > b.k AND contains(' ' || q.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * q.a >= 100 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b ANTI JOIN m USING (lang, phrase) QUALIFY rank <= 2000""",
    "op12_conversation_repair": r"""
WITH RECURSIVE c AS (
  SELECT list_transform(range(256), lambda v: list_reduce([v] || range(8), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t),
b AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, row_number() OVER () AS r,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS bs
  FROM conversations),
e AS (SELECT b.*, xor(list_reduce([4294967295] || bs, lambda x, y: xor(x >> 8, t[xor(x, y) % 256 + 1])), 4294967295) % 20 AS code FROM b, c),
d AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    r, unnest(range(CASE code WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM e WHERE code <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, copy) AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final FROM d),
f AS (
  SELECT *, CASE WHEN final = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN final NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair
  FROM o),
z AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
    count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM f GROUP BY conv_id),
g AS (
  SELECT * FROM (VALUES ('', '', 0, '', '', ''), ('', 'u', 5, 'I', 'user:', ''), ('', 'a', 10, 'II', 'user:', 'assistant:'), ('s', 's', 0, '', '', ''), ('s', 'u', 5, 'I', 'user:', ''),
    ('s', 'a', 10, 'II', 'user:', 'assistant:'), ('u', 'u', 0, '', '', ''), ('u', 'a', 5, 'I', 'assistant:', ''), ('a', 'a', 0, '', '', ''), ('a', 'u', 5, 'I', 'user:', '')) AS v (s, s2, c, a, t1, t2)),
k AS (
  SELECT g.*, w.* FROM g JOIN (VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')) AS w (w1, initial, w3) ON w1 = s2),
p AS (
  SELECT conv_id, 0::BIGINT AS i, '' AS s, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM conversations GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, s, (min(x)).cost, (min(x)).audit, arg_min(lines, x) FROM (
    SELECT p.conv_id, f.i, g.s2 AS s, {'cost': p.cost + g.c + 2, 'audit': p.audit || g.a || 'D'} AS x, p.lines || [g.t1, g.t2] AS lines
    FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 JOIN g ON g.s = p.s
    UNION ALL
    SELECT p.conv_id, f.i, k.w3, {'cost': p.cost + k.c + m.c + CASE f.fault WHEN 3 THEN 5 ELSE 0 END, 'audit': p.audit || k.a || m.a},
      p.lines || [k.t1, k.t2, CASE m.a WHEN 'K' THEN f.role WHEN 'R' THEN CASE k.initial WHEN 'u' THEN 'user' ELSE 'assistant' END END || ':' || f.text]
    FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 AND f.fault IN (0, 3) JOIN k ON k.s = p.s
    JOIN (VALUES ('K', 0), ('R', 1)) AS m (a, c) ON (m.a = 'K' AND role[1] = k.initial) OR (m.a = 'R' AND k.initial <> 's')
  ) GROUP BY conv_id, i, s),
q AS (
  SELECT p.conv_id, min({'cost': cost + g.c, 'audit': audit || g.a}) AS x, arg_min(lines || [g.t1, g.t2], {'cost': cost + g.c, 'audit': audit || g.a}) AS lines
  FROM p LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM p.conv_id JOIN g ON g.s = p.s AND g.s2 IN ('', 'a') WHERE i = coalesce(n, 0) GROUP BY p.conv_id)
SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  x.cost AS cost, x.audit AS audit, sha256(array_to_string(list_filter(lines, lambda l: l <> ''), chr(10))) AS repaired_sha256
FROM q LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM q.conv_id""",
    "op13_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
}
