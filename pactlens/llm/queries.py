"""The operators of this subpackage over their whole tables, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.llm import chat, covertree, digests, lines, packing, pieces, quality, repair, simhash, substrings, toxicity, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text again."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(docs["text"], F.lit(""))
    tokens = pieces.encoded(docs, F.struct(docs["doc_id"], F.xxhash64(text).alias("of")))
    back = pieces.decoded(tokens.select(F.struct("key", "ids").alias("key"), "ids"))
    ids = F.col("key.ids")
    return back.select("key.key.doc_id", ids.alias("ids"), F.size(ids).alias("n_tokens"), (F.xxhash64("text") == F.col("key.key.of")).alias("same_text"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every line that is not alone, and the line of its class that stays."""
    return lines.line_classes(table(spark, sf_dir, "documents"), min_chars=lines.ANY_LINE)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.nearest(table(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.packed(docs, docs["doc_id"]).withColumnRenamed("key", "doc_id")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.report(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_sentencepiece,
        op2_warc,
        op3_quality_rules,
        op4_line_dedup,
        op5_toxicity,
        op6_simhash,
        op7_top_k,
        op8_packing,
        op9_suffix_dedup,
        op10_chat,
        op11_fingerprints,
        op12_conversation_repair,
        op13_embedding_whitening,
    )
}

ORACLES = {
    "op2_warc": """
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, url, sha256(html) AS digest, strlen(html) AS size FROM p),
        f AS (SELECT digest, min(page_id) AS first FROM d WHERE size >= 100 GROUP BY digest)
        SELECT page_id, url, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to, digest AS payload_digest, size AS payload_bytes
        FROM d LEFT JOIN f USING (digest)
    """,
    "op7_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, d.vec_id,
                     list_sum(list_transform(list_zip(q.v, d.v), lambda z: z[1] * z[2]))::BIGINT AS score
              FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op10_chat": """
        WITH i AS (
            SELECT *, CASE WHEN conv_id IS NULL THEN 'row ' || row_number() OVER () ELSE 'conversation ' || conv_id END AS own FROM conversations),
        t AS (
            SELECT own, conv_id, row_number() OVER w AS n, coalesce(role, '') AS r, coalesce(text, '') AS x,
                   lower(trim(coalesce(role, 'user'))) AS shown_role
            FROM i WINDOW w AS (PARTITION BY own ORDER BY turn, role, text)),
        h AS (
            SELECT *, list(md5(r) || md5(x)) OVER (PARTITION BY own ORDER BY n) AS so_far,
                   count(*) OVER (PARTITION BY own) AS total FROM t),
        k AS (SELECT md5(array_to_string(so_far, '')) AS key, n, total, conv_id, own FROM h),
        whole AS (
            SELECT key, n AS n_turns, first(conv_id ORDER BY conv_id NULLS FIRST) AS conv_id, first(own ORDER BY conv_id NULLS FIRST, own) AS own,
                   count(*) AS n_copies
            FROM k WHERE n = total GROUP BY key, n),
        kept AS (SELECT * FROM whole WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.n < k.total AND k.n = whole.n_turns AND k.key = whole.key)),
        e AS (SELECT own, n, shown_role AS a, x AS b FROM t)
        SELECT kept.conv_id, n_turns, n_copies, string_agg(
            '<|im_start|>' || replace(replace(a, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || chr(10)
            || replace(replace(b, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || '<|im_end|>' || chr(10), '' ORDER BY n) AS text
        FROM kept JOIN e ON e.own = kept.own GROUP BY kept.own, kept.conv_id, n_turns, n_copies
    """,
    "op12_conversation_repair": """
        WITH RECURSIVE b AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, dense_rank() OVER (ORDER BY conv_id) AS k,
                   list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT) AS bytes
            FROM conversations),
        c AS (
            SELECT *, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, x: list_reduce(
                   [xor(a, x), 1, 2, 3, 4, 5, 6, 7, 8], lambda y, n: CASE WHEN (y & 1) = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END))) % 20 AS f
            FROM b),
        d AS (
            SELECT conv_id, k, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
                   CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS copy
            FROM c WHERE f <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, md5(text)) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d),
        e AS (
            SELECT *, left(role, 1) AS r, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 'duplicate'
                   WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY k ORDER BY i) AS before
            FROM o),
        keep(st, r, nxt) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
        new(st, r, nxt) AS (VALUES (0, 'user:', 2), (1, 'user:', 2), (2, 'assistant:', 3), (3, 'user:', 2)),
        ins AS (
            SELECT st, st AS nxt, '' AS edits, '' AS body FROM new
            UNION ALL SELECT st, nxt, 'I', r || chr(10) FROM new
            UNION ALL SELECT x.st, y.nxt, 'II', x.r || chr(10) || y.r || chr(10) FROM new x JOIN new y ON x.nxt = y.st),
        p(k, i, st, cost, audit, body) AS (
            SELECT DISTINCT k, 0::BIGINT, 0, 0, '', '' FROM e
            UNION ALL
            SELECT k, i, st, cost, audit, body FROM (
                SELECT p.k, e.i, w.nxt AS st, p.cost + 2 * length(ins.edits) + w.price AS cost, p.audit || ins.edits || w.edit AS audit, p.body || ins.body || w.body AS body
                FROM p JOIN e ON e.k = p.k AND e.i = p.i + 1 JOIN ins ON ins.st = p.st JOIN LATERAL (
                    SELECT ins.nxt AS nxt, 3 AS price, 'D' AS edit, '' AS body
                    UNION ALL SELECT keep.nxt, (e.fault = 'truncated')::INTEGER, 'K', e.role || ':' || e.text || chr(10) FROM keep
                    WHERE keep.st = ins.nxt AND keep.r = e.r AND e.fault NOT IN ('blank', 'duplicate')
                    UNION ALL SELECT new.nxt, 2 + (e.fault = 'truncated')::INTEGER, 'R', new.r || e.text || chr(10) FROM new
                    WHERE new.st = ins.nxt AND e.fault NOT IN ('blank', 'duplicate')) w ON true
                QUALIFY row_number() OVER (PARTITION BY p.k, w.nxt ORDER BY p.cost + 2 * length(ins.edits) + w.price, p.audit || ins.edits || w.edit) = 1)),
        z AS (
            SELECT p.k, cost + 2 * length(t.edits) AS cost, audit || t.edits AS audit, p.body || t.body AS body
            FROM p JOIN (SELECT k, max(i) AS n FROM e GROUP BY k) m ON m.k = p.k AND m.n = p.i
            JOIN (SELECT * FROM ins WHERE (st IN (0, 3) AND edits = '') OR (st = 1 AND edits = 'II') OR (st = 2 AND edits = 'I')) t ON t.st = p.st
            QUALIFY row_number() OVER (PARTITION BY p.k ORDER BY cost + 2 * length(t.edits), audit || t.edits) = 1),
        g AS (
            SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                   count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal
            FROM e GROUP BY k)
        SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
               coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
               coalesce(audit, '') AS audit, sha256(left(coalesce(body, ''), greatest(length(coalesce(body, '')) - 1, 0))) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id, k FROM b) a LEFT JOIN g ON g.k = a.k LEFT JOIN z ON z.k = a.k
    """,
}
