"""The queries of this package and their SQL, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.llm import (ann, chat, covertree, jaccard, langid, linededup, mixing, packing, prefixtrie, tokens, toxicity,
                          vafile, warc)
from sigframe.llm.common import fold, scratch, table, written

TOKENIZER = "byte_bpe_50k.json"


def op1_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return ann.search(e, e.where(F.col("vec_id") % 100 == 0), k=10, factor=1.0).drop("query_key")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), k=5, percent=80)


def language_model(docs: DataFrame) -> langid.Model:
    """Learned from the folds 0, 1 and 3 alone."""
    return langid.fit(docs.where(F.coalesce(fold(), F.lit(0)) != 2))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs.select("doc_id", "text"), language_model(docs))
    return out.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), limit=512)


def op5_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/archives-{_fresh()}"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    records = written(warc.read_records(spark, path, with_payload=False))
    captures = warc.assemble(records)
    ids = captures.select("capture_id", F.col("metadata.fields")["pageId"].cast("long").alias("page_id"))
    first = ids.select(F.col("capture_id").alias("to"), F.col("page_id").alias("refers_to"))
    rows = captures.withColumn("page_id", F.col("metadata.fields")["pageId"].cast("long")).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.join(first, F.col("response.refers_to") == F.col("to"), "left").select(
        "page_id", F.col("response.payload_bytes").cast("long").alias("payload_bytes"),
        F.regexp_replace("response.payload_digest", "^sha256:", "").alias("payload_digest"),
        F.col("response.type").alias("record_type"), "refers_to")


def _fresh() -> str:
    import uuid

    return uuid.uuid4().hex


def op6_cover_tree_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op7_order_preserving_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), window=2048, end_id=1,
                        with_ids=False).drop("ids")


def op8_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat.transcripts(table(spark, sf_dir, "conversations"))
    return chat.link_calls(calls, results, {"reply": chat.REPLY}).withColumnRenamed("thread", "conv_id")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learned from labelled documents of the folds 0, 1 and 3."""
    return toxicity.fit(docs, labels.where(F.coalesce(fold(), F.lit(0)) != 2))


def op9_toxicity_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", "toxic", "grade", "severity", "toxic_prob")


def op10_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", F.regexp_count(
        F.coalesce("text", F.lit("")), F.lit(mixing.WORD)).cast("long").alias("words")))
    out = mixing.assign(sized, size_col="words")
    return out.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy("position", "doc_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = prefixtrie.rebuild(prefixtrie.sequences(table(spark, sf_dir, "conversations")))
    return prefixtrie.nodes(seqs).drop("node")


def op12_va_file_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    return vafile.cluster(table(spark, sf_dir, "embeddings"), keep=["vec_id"], k=16, rounds=3, seed_key=seed)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs, min_chars=20, min_docs=3).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_vantage_point_search, op2_ngram_jaccard_join, op3_language_id, op4_token_counts, op5_warc_transactions,
    op6_cover_tree_duplicates, op7_order_preserving_packing, op8_tool_call_linking, op9_toxicity_severity,
    op10_curriculum_mix, op11_prefix_trie, op12_va_file_clusters, op13_line_dedup, pipeline)}

_FINITE = """SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0"""



def _rounds_sql(rounds: int) -> str:
    """CTEs ``a0`` (first centroids ``c0`` assigned), ..., ``a<rounds>``: each round's
    means rounded down, exactly."""
    out = []
    for r in range(rounds + 1):
        if r:
            out.append(f"""m{r} AS (SELECT cluster, d, floor_div(sum(x)::HUGEINT, count(*)) AS x FROM
  (SELECT cluster, unnest(g) AS x, unnest(range(64)) AS d FROM a{r - 1}) GROUP BY cluster, d),
n{r} AS (SELECT cluster, list(x ORDER BY d) AS c FROM m{r} GROUP BY cluster),
c{r} AS (SELECT p.cluster, coalesce(n.c, p.c) AS c FROM c{r - 1} p LEFT JOIN n{r} n ON n.cluster = p.cluster)""".replace(
                "floor_div(sum(x)::HUGEINT, count(*))",
                "((sum(x)::HUGEINT - ((sum(x)::HUGEINT % count(*)) + count(*)) % count(*)) // count(*))::BIGINT"))
        out.append(f"""p{r} AS (SELECT v.row, v.vec_id, v.g, c.cluster,
  list_sum(list_transform(list_zip(v.g, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance FROM v, c{r} c),
a{r} AS (SELECT row, any_value(vec_id) AS vec_id, any_value(g) AS g, arg_min(cluster, (distance, cluster)) AS cluster,
  min(distance) AS distance FROM p{r} GROUP BY row)""")
    return ",\n".join(out)


SQL: dict[str, str] = {
    "op1_vantage_point_search": f"""
WITH v AS ({_FINITE}),
d AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
        sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score
        , a.e FROM (SELECT DISTINCT vec_id, e FROM v) a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        AND len(a.e) = len(b.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, e ORDER BY score, vec_id)::INTEGER AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op5_warc_transactions": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
             sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100""",
    "op6_cover_tree_duplicates": f"""
WITH RECURSIVE v AS ({_FINITE}),
u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) / (a.norm * b.norm) >= 0.9),
r(vec_id, low) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.a, r.low FROM r JOIN l ON l.b = r.vec_id),
c AS (SELECT vec_id, min(low) AS component_id FROM r GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT c.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept
FROM c LEFT JOIN n ON n.vec_id = c.vec_id""",
    "op8_tool_call_linking": """
WITH c AS (SELECT conv_id, turn, text, conv_id || ':' || turn AS call_id,
             row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) * 2 - turn AS run
           FROM conversations WHERE role = 'user'),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1 AS level FROM c),
a AS (SELECT conv_id, turn, text, conv_id || ':' || (turn - 1) AS call_id FROM conversations WHERE role = 'assistant'),
j AS (SELECT k.conv_id, k.turn AS call_position, a.turn AS result_position, k.call_id, k.level, k.text,
        a.text AS content, a.call_id IS NOT NULL AS answered FROM k LEFT JOIN a ON a.call_id = k.call_id)
SELECT conv_id, call_position, result_position, call_id, CASE WHEN answered THEN 'linked' ELSE 'unanswered' END AS status,
  level, length(text) BETWEEN 1 AND 300 AS valid,
  CASE WHEN text IS NULL THEN '$.prompt: not string' WHEN length(text) < 1 THEN '$.prompt: too short'
       WHEN length(text) > 300 THEN '$.prompt: too long' END AS error,
  '{"arguments":{"prompt":' || to_json(text)::VARCHAR || ',"turn":' || call_position || '},"id":"' || call_id
    || '","level":' || level || ',"name":"reply","needs":["' || conv_id || ':' || (call_position - 2) || '"],"result":'
    || CASE WHEN answered THEN '{"content":' || to_json(content)::VARCHAR || ',"position":' || result_position || '}'
            ELSE 'null' END || '}' AS json FROM j
UNION ALL
SELECT conv_id, NULL, turn, call_id, 'orphan', NULL, NULL, NULL,
  '{"id":"' || call_id || '","result":{"content":' || to_json(text)::VARCHAR || ',"position":' || turn || '}}'
FROM a WHERE call_id NOT IN (SELECT call_id FROM k)""",
    "op10_curriculum_mix": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn
      FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][turn % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, turn
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, turn
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, turn, least(cap, weight * (SELECT arg_min(level, cap / weight) FROM f
        WHERE level <= cap / weight)) AS target FROM f),
c AS (SELECT doc_id, size, source_size, target, turn, coalesce(sum(size) OVER (PARTITION BY d.source
        ORDER BY md5(doc_id::VARCHAR), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (SELECT *, least(before / greatest(target, 1), 1) AS share FROM c)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, floor(target) - before))
   + greatest(0, least(size, floor(target) - source_size - before)))::BIGINT AS taken,
  CASE turn % 3 WHEN 0 THEN 1.5 - sqrt(2.25 - 2 * share) WHEN 1 THEN share
                ELSE sqrt(0.25 + 2 * share) - 0.5 END AS position
FROM u""",
    "op11_prefix_trie": """
WITH t AS (SELECT conv_id AS c, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS h,
             octet_length(encode(coalesce(text, ''))) AS b,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS d
           FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT c, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT),
        lambda s, x: list_reduce([xor(s, x)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0],
                                 lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295::BIGINT) % 9 AS h
      FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT i.c, t.h, t.b, 0 AS part, t.d FROM i JOIN t ON t.c = i.c - i.c % 5 AND t.d <= i.h
      UNION ALL SELECT i.c, t.h, t.b, 1, t.d FROM i JOIN t ON t.c = i.c AND t.d > i.h),
p AS (SELECT c, b, row_number() OVER w AS d, md5(string_agg(h, '') OVER w) AS k FROM r
      WINDOW w AS (PARTITION BY c ORDER BY part, d ROWS UNBOUNDED PRECEDING)
      UNION ALL SELECT c, 0, 0, '' FROM i),
n AS (SELECT k, d, min(c) AS c, count(*) AS n_convs, any_value(b) AS b FROM p GROUP BY k, d),
e AS (SELECT n.k, n.d, n.c, n_convs, n.b, u.k AS up FROM n LEFT JOIN p u ON u.c = n.c AND u.d = n.d - 1),
ch AS (SELECT up AS k, count(*) AS n_children FROM e WHERE up IS NOT NULL GROUP BY up),
s AS (SELECT p.k, count_if(ch.k IS NULL)::BIGINT AS n_leaves, sum((n_convs - 1) * e.b)::BIGINT AS saved_tokens
      FROM e LEFT JOIN ch ON ch.k = e.k JOIN p ON p.c = e.c AND p.d <= e.d GROUP BY p.k),
l AS (SELECT k, string_agg(p.c::VARCHAR, ',' ORDER BY p.c) AS ids
      FROM p JOIN (SELECT c, max(d) AS d FROM p GROUP BY c) m ON m.c = p.c AND m.d = p.d GROUP BY k)
SELECT e.c AS conv_id, e.d AS depth, u.c AS parent_conv_id, e.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
  saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM e LEFT JOIN n u ON u.k = e.up LEFT JOIN ch ON ch.k = e.k JOIN s ON s.k = e.k LEFT JOIN l ON l.k = e.k""",
    "op12_va_file_clusters": f"""
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS g
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), g) - 1 AS cluster, g AS c FROM v
  QUALIFY cluster < 16),
{_rounds_sql(3)},
i AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM a3 GROUP BY cluster)
SELECT a.vec_id, a.cluster::INTEGER AS cluster, a.distance, i.cluster_inertia,
  (SELECT sum(distance)::BIGINT FROM a3) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a3 a JOIN i ON i.cluster = a.cluster JOIN c3 c ON c.cluster = a.cluster""",
    "op13_line_dedup": """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
d AS (SELECT k.doc_id, pos, line, f.key IS NOT NULL AND k.doc_id <> last AS dropped FROM k LEFT JOIN f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, count_if(dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256 FROM d GROUP BY doc_id""",
}
