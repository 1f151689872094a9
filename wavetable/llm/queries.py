"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetable.llm import chat, decontam, embdedup, exactdedup, html, langid, merkle, packing, simhash, tokencount, toxicity, warc, whitening
from wavetable.llm.util import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.round_trip(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.format_conversations(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "step", "pos", "call_id", "linked", "valid", F.sha2(F.col("json").cast("binary"), 256).alias("json_sha256"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening(table(spark, sf_dir, "embeddings"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.manifest(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_simhash, op3_html, op4_packing, op5_warc, op6_token_counts, op7_language, op8_toxicity, op9_chat, op10_embedding_dedup, op11_whitening, op12_merkle, op13_exact_dedup,
    )
}

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS} w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) n FROM (SELECT item_id, {WORDS} w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s+n-1], ' ') win FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) s FROM b)),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s+n-1], ' ') win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT DISTINCT doc_id, s, n, item_id FROM dw JOIN bw USING (n, win)),
h AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) p FROM m) GROUP BY 1),
i AS (SELECT doc_id, count(*) n_items, string_agg(i, ',' ORDER BY i) l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR i FROM m) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items,
       sha256(coalesce(l, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id
"""

OP10_SQL = """
WITH RECURSIVE e AS (
    SELECT vec_id, label, embedding::DOUBLE[] v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id u, b.vec_id w FROM e a JOIN e b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT u, u w FROM l UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u),
c AS (SELECT u, min(w) component_id FROM r GROUP BY u),
n AS (SELECT u, count(*) n_links FROM l GROUP BY u)
SELECT vec_id, coalesce(n_links, 0)::BIGINT n_links, coalesce(component_id, vec_id)::BIGINT component_id, coalesce(component_id, vec_id) = vec_id kept
FROM embeddings LEFT JOIN n ON n.u = vec_id LEFT JOIN c ON c.u = vec_id
"""

OP5_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT payload_bytes, sha1(coalesce(html, '')) hex FROM pages),
g AS (SELECT page_id, payload_bytes, list_transform(range(0, 8), lambda i: ('0x' || substr(hex, (5 * i + 1)::BIGINT, 5))::BIGINT) five FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((five[(i // 4 + 1)::BIGINT] >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1, 1)), '') payload_digest FROM g),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id OR (page_id IS NULL AND first IS NOT NULL) THEN 'revisit' ELSE 'response' END record_type,
       CASE WHEN first <> page_id OR page_id IS NULL THEN first END refers_to FROM f
"""

OP9_SQL = """
WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
c AS (SELECT u.conv_id, u.turn pos, 'turn-' || u.turn call_id, u.text q, a.text r, a.turn IS NOT NULL linked,
             row_number() OVER (PARTITION BY u.conv_id, (u.turn % 2) ORDER BY u.turn) - 1 n, (u.turn - min(u.turn) OVER (PARTITION BY u.conv_id, u.turn % 2)) // 2 k
      FROM u LEFT JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1),
s AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, pos % 2, k - n ORDER BY pos) - 1)::BIGINT step FROM c)
SELECT conv_id, step, pos, call_id, linked, q IS NOT NULL AND length(q) > 0 valid,
       sha256('{"arguments":{' || coalesce('"text":' || to_json(q), '') || '},"id":"' || call_id || '","name":"reply","result":' || coalesce(to_json(r)::VARCHAR, 'null') || ',"step":' || step || '}') json_sha256
FROM s
UNION ALL
SELECT t.conv_id, NULL, t.turn, NULL, false, t.role IS NOT NULL AND length(t.text) > 0 AND t.text IS NOT NULL,
       sha256('{"content":' || coalesce(to_json(t.text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(t.role)::VARCHAR, 'null') || '}')
FROM conversations t LEFT JOIN (SELECT DISTINCT conv_id, turn FROM u) b ON b.conv_id = t.conv_id AND b.turn = t.turn - 1
WHERE NOT coalesce(t.role IN ('user', 'assistant') AND t.conv_id IS NOT NULL AND t.turn IS NOT NULL, false) OR (t.role = 'assistant' AND b.turn IS NULL)
"""

#: The tree level by level, what stands beside each node, and the fold of the leaf that is given.
OP12_SQL = r"""
WITH RECURSIVE f AS (
    SELECT doc_id, source, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') head FROM documents),
l AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) leaf, sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) given FROM f),
z AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 pos, count(*) OVER (PARTITION BY source) n FROM l),
t(source, lvl, pos, d, n) AS (
    SELECT source, 0, pos, leaf, n FROM z
    UNION ALL SELECT source, lvl + 1, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), any_value((n + 2) // 3) FROM t WHERE n > 1 GROUP BY source, lvl, pos // 3),
s AS (SELECT source, d subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 pos, count(*) OVER () n FROM t WHERE n = 1),
u(lvl, pos, d, n) AS (
    SELECT 0, pos, subroot, n FROM s
    UNION ALL SELECT lvl + 1, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), any_value((n + 2) // 3) FROM u WHERE n > 1 GROUP BY lvl, pos // 3),
b AS (SELECT a.source, a.lvl, a.pos, coalesce(string_agg(o.d, '' ORDER BY o.pos) FILTER (o.pos < a.pos), '') l, coalesce(string_agg(o.d, '' ORDER BY o.pos) FILTER (o.pos > a.pos), '') r
      FROM t a LEFT JOIN t o ON o.source IS NOT DISTINCT FROM a.source AND o.lvl = a.lvl AND o.pos // 3 = a.pos // 3 WHERE a.n > 1 GROUP BY ALL),
v AS (SELECT a.lvl, a.pos, coalesce(string_agg(o.d, '' ORDER BY o.pos) FILTER (o.pos < a.pos), '') l, coalesce(string_agg(o.d, '' ORDER BY o.pos) FILTER (o.pos > a.pos), '') r
      FROM u a LEFT JOIN u o ON o.lvl = a.lvl AND o.pos // 3 = a.pos // 3 WHERE a.n > 1 GROUP BY ALL),
w AS (SELECT z.source, z.pos, b.lvl, l, r FROM z JOIN b ON b.source IS NOT DISTINCT FROM z.source AND b.pos = z.pos // pow(3, b.lvl)::BIGINT
      UNION ALL SELECT z.source, z.pos, 1000 + v.lvl, l, r FROM z JOIN s ON s.source IS NOT DISTINCT FROM z.source JOIN v ON v.pos = s.pos // pow(3, v.lvl)::BIGINT),
k AS (SELECT *, row_number() OVER (PARTITION BY source, pos ORDER BY lvl) i FROM w),
g(source, pos, i, d) AS (
    SELECT source, pos, 0, CASE WHEN crc32_even THEN given ELSE leaf END FROM (SELECT *, coalesce(EVEN_CRC, false) crc32_even FROM z)
    UNION ALL SELECT g.source, g.pos, g.i + 1, sha256(l || d || r) FROM g JOIN k ON k.source IS NOT DISTINCT FROM g.source AND k.pos = g.pos AND k.i = g.i + 1),
q AS (SELECT source, pos, arg_max(d, i) folded FROM g GROUP BY ALL), p AS (SELECT source, pos, string_agg(l || r, '' ORDER BY lvl) proof FROM w GROUP BY ALL)
SELECT z.doc_id, z.leaf, s.subroot, e.d root, sha256(coalesce(p.proof, '')) proof_sha256, q.folded folded_root, q.folded = e.d verified
FROM (SELECT d FROM u WHERE n = 1) e, z JOIN s ON s.source IS NOT DISTINCT FROM z.source LEFT JOIN p ON p.source IS NOT DISTINCT FROM z.source AND p.pos = z.pos JOIN q ON q.source IS NOT DISTINCT FROM z.source AND q.pos = z.pos
"""

#: The CRC-32 of the decimal doc_id is even: bytes and bits of the reflected polynomial, written out.
CRC_STEP = "lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
OP12_SQL = OP12_SQL.replace("EVEN_CRC", f"list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda h: ascii(h)::BIGINT)), {CRC_STEP}) & 1 = 1")

OP13_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t FROM documents)
SELECT doc_id, max(doc_id) OVER w keep_id, count(*) OVER w group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w kept, sha256(t) text_sha256 FROM d WINDOW w AS (PARTITION BY t)
"""

ORACLE_SQL = {"op12_merkle": OP12_SQL, "op13_exact_dedup": OP13_SQL, "op5_warc": OP5_SQL, "op9_chat": OP9_SQL, "op1_decontamination": OP1_SQL, "op10_embedding_dedup": OP10_SQL}
