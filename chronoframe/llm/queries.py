"""Registered queries of the operators, with their production parameters, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, chat, convtrie, decontam, fingerprint, langid, minhash, resample, secrets, sharding, tokencount, vectors, warc
from .common import read

N_SHARDS = 8


def op1_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), words=2, percent=80)


def op2_token_counts(spark, sf_dir):
    return tokencount.count_tokens(read(spark, sf_dir, "documents"))


def op3_secret_scan(spark, sf_dir):
    found = secrets.scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex",
                        F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans",
                        "n_guess", F.round("max_bits", 6).alias("max_bits"))


def op4_warc_bundles(spark, sf_dir):
    return warc.read_bundles(warc.write_bundles(read(spark, sf_dir, "pages"))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_chat_rotation(spark, sf_dir):
    return chat.rotate(read(spark, sf_dir, "conversations"))


def op6_decontamination(spark, sf_dir):
    return decontam.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_byte_bpe(spark, sf_dir):
    coded = bpe.encode(read(spark, sf_dir, "documents"), decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_sharding(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.col("row.text")
    return sharding.shard(docs, N_SHARDS).select(
        F.col("row.doc_id").alias("doc_id"), sharding.record_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        "shard", "slot", "grown_shard")


def held_out(doc_id):
    """Documents that language ID doesn't learn from; one without id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def language_model(docs):
    return langid.learn(docs.where(~held_out(F.col("doc_id"))))


def op9_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), language_model(docs), carry=["doc_id"])
    doc_id = F.col("row.doc_id")
    return found.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "lang_pred",
                        F.round("score", 6).alias("score"), F.size("spans").alias("n_spans"))


def op10_embedding_near_dedup(spark, sf_dir):
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings"), cosine=0.9)


def op11_prefix_trie(spark, sf_dir):
    return convtrie.trie(convtrie.rebuilt(convtrie.ordered_turns(read(spark, sf_dir, "conversations"))))


def op12_fingerprints(spark, sf_dir):
    return fingerprint.fingerprints(read(spark, sf_dir, "documents"))


def op13_importance_resampling(spark, sf_dir):
    return resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_minhash_near_dedup, op2_token_counts, op3_secret_scan, op4_warc_bundles, op5_chat_rotation,
    op6_decontamination, op7_byte_bpe, op8_sharding, op9_language_id, op10_embedding_near_dedup, op11_prefix_trie, op12_fingerprints, op13_importance_resampling, pipeline)}

_COMPONENTS = """
links AS (SELECT DISTINCT a, b FROM pairs UNION SELECT DISTINCT b, a FROM pairs),
reach(node, other) AS (
  SELECT a, b FROM links
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
comp AS (SELECT node, least(node, min(other)) AS component_id FROM reach GROUP BY node)"""

def _crc_nibbles():
    """crc32 remainders of the 16 values of a half byte."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = (c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1
        out.append(c)
    return out


ORACLES = {
    # A node is named by its smallest member and depth; its subtree is the nodes whose first member goes through it.
    "op11_prefix_trie": f"""
WITH h AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
o AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY i) AS own FROM h GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id::VARCHAR AS g FROM o),
nibbles AS (SELECT g, hex(encode(g)) AS x FROM ids),
crc AS (
  SELECT g, xor(list_reduce([CAST(4294967295 AS UBIGINT)] || list_transform(range(len(x)),
      lambda i: CAST(instr('0123456789ABCDEF', x[i + 2 - 2 * (i % 2)]) - 1 AS UBIGINT)),
    lambda s, d: xor(s >> 4, ({_crc_nibbles()}::UBIGINT[])[CAST(xor(s, d) & 15 AS BIGINT) + 1])), 4294967295) % 6 AS h
  FROM nibbles),
c AS (
  SELECT o.conv_id, coalesce(b.own[1:h::BIGINT], []) || o.own[h::BIGINT + 1:] AS turns
  FROM o JOIN crc ON crc.g = o.conv_id::VARCHAR LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 100),
p AS (SELECT conv_id, len(turns) AS n, d, turns[1:d] AS prefix, CASE WHEN d = 0 THEN 0 ELSE length(turns[d].t) END AS chars
      FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM c)),
node AS (
  SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM p GROUP BY d, prefix),
path AS (SELECT p.conv_id AS member, node.d, node.conv_id FROM p JOIN node ON p.d = node.d AND p.prefix = node.prefix),
up AS (SELECT n.*, m.conv_id AS parent_conv_id FROM node n LEFT JOIN path m ON m.member = n.conv_id AND m.d = n.d - 1),
kids AS (SELECT parent_conv_id AS c, d - 1 AS d, count(*) AS n FROM up WHERE d > 0 GROUP BY ALL),
sub AS (
  SELECT a.conv_id AS c, a.d, count(*) FILTER (k.n IS NULL) AS n_leaves, sum((x.n_convs - 1) * x.chars) AS saved
  FROM node x LEFT JOIN kids k ON k.c = x.conv_id AND k.d = x.d
  JOIN path a ON a.member = x.conv_id AND a.d <= x.d GROUP BY ALL)
SELECT u.conv_id, u.d AS depth, u.parent_conv_id, u.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves,
  s.saved::BIGINT AS saved_tokens, u.ends_sha256
FROM up u LEFT JOIN kids k ON k.c = u.conv_id AND k.d = u.d JOIN sub s ON s.c = u.conv_id AND s.d = u.d""",
    # crc32 goes over half bytes, the lower one of each byte first.
    "op13_importance_resampling": f"""
WITH texts AS (
  SELECT 'd' AS side, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
w AS (
  SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM texts),
f AS (
  SELECT side, r, unnest(ws || [ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) AS g FROM w),
c AS (SELECT side, r, g, count(*) AS n FROM f GROUP BY ALL),
h AS (SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM c)),
crc AS (
  SELECT g, xor(list_reduce([CAST(4294967295 AS UBIGINT)] || list_transform(range(len(x)),
      lambda i: CAST(instr('0123456789ABCDEF', x[i + 2 - 2 * (i % 2)]) - 1 AS UBIGINT)),
    lambda s, d: xor(s >> 4, ({_crc_nibbles()}::UBIGINT[])[CAST(xor(s, d) & 15 AS BIGINT) + 1])), 4294967295) % 10000 AS b
  FROM h),
k AS (SELECT side, r, b, sum(n) AS n FROM c JOIN crc USING (g) GROUP BY ALL),
tot AS (SELECT coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM k),
gain AS (
  SELECT b, floor(1000 * ln((coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE + 1) * (any_value(tot.s)::DOUBLE + 10000)
                  / ((coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE + 1) * (any_value(tot.t)::DOUBLE + 10000)))) AS v
  FROM k, tot GROUP BY b),
m AS (SELECT r, sum(n) AS n, sum(n * v) AS v FROM k JOIN gain USING (b) WHERE side = 'd' GROUP BY r),
d AS (
  SELECT w.doc_id, len(ws) AS words, coalesce(m.n, 0)::BIGINT AS n_features, coalesce(floor(m.v / m.n), 0)::BIGINT AS weight,
    ('0x' || sha256('7:' || coalesce(w.doc_id::VARCHAR, ''))[:8])::BIGINT AS h
  FROM w LEFT JOIN m USING (r) WHERE side = 'd'),
e AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d),
o AS (
  SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS i,
    count(*) OVER (PARTITION BY words >= 20) AS total FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND i <= 25 * total // 100 THEN i END AS rank FROM o""",
    # Pairs at 0.8 share a shingle among the n - ceil(0.8 n) + 1 rarest of either set.
    "op1_minhash_near_dedup": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws
    ELSE list_distinct([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
f AS (SELECT g, count(*) AS df FROM e GROUP BY g),
r AS (SELECT e.doc_id, e.n, e.g, row_number() OVER (PARTITION BY e.doc_id ORDER BY f.df, e.g) AS k
      FROM e JOIN f ON e.g = f.g),
p AS (SELECT doc_id, n, g FROM r WHERE k <= n - ceil(0.8 * n) + 1),
cand AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM p x JOIN p y ON x.g = y.g AND x.doc_id < y.doc_id
         WHERE 10 * least(x.n, y.n) >= 8 * greatest(x.n, y.n)),
inter AS (SELECT c.a, c.b, count(*) AS i FROM cand c JOIN e x ON x.doc_id = c.a
          JOIN e y ON y.doc_id = c.b AND y.g = x.g GROUP BY c.a, c.b),
pairs AS (SELECT a, b FROM inter JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b
          WHERE 100 * i >= 80 * (len(sa.sh) + len(sb.sh) - i)),
{_COMPONENTS}
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id,
       s.doc_id = coalesce(c.component_id, s.doc_id) AS kept
FROM s LEFT JOIN comp c ON c.node = s.doc_id""",
    "op4_warc_bundles": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM f""",
    "op5_chat_rotation": """
WITH t AS (
  SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS role,
         replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations),
people AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
h AS (
  SELECT t.conv_id, speaker, turn, role, body, role = speaker AS target,
         CASE WHEN role = speaker THEN '<|assistant|>' || chr(10) WHEN role = 'system' THEN '<|system|>' || chr(10)
              ELSE '<|user name=' || role || '|>' || chr(10) END AS head
  FROM t JOIN people ON t.conv_id IS NOT DISTINCT FROM people.conv_id),
g AS (SELECT *, head || body || '<|end|>' || chr(10) AS segment FROM h),
o AS (
  SELECT *, row_number() OVER w - 1 AS seq, sum(length(segment)) OVER (w ROWS UNBOUNDED PRECEDING) AS stop
  FROM g WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, body))
SELECT conv_id, speaker, seq, segment, target, CAST(stop - length(segment) AS BIGINT) AS "start",
       CAST(stop AS BIGINT) AS "end",
       CASE WHEN target THEN CAST(stop - length(segment) + length(head) AS BIGINT) END AS mask_start,
       CASE WHEN target THEN CAST(stop - 1 AS BIGINT) END AS mask_end
FROM o""",
    "op10_embedding_near_dedup": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding, [CAST(y AS DOUBLE) for y in embedding] AS x FROM embeddings),
u AS (SELECT vec_id, x, sqrt(list_sum([y * y for y in x])) AS norm FROM v
      WHERE x IS NOT NULL AND len(x) > 0 AND len([y for y in x if y IS NULL OR NOT isfinite(y)]) = 0
        AND list_sum([abs(y) for y in x]) > 0),
pairs AS (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.vec_id < q.vec_id
          WHERE list_dot_product(p.x, q.x) / (p.norm * q.norm) >= 0.9),
{_COMPONENTS},
deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, coalesce(c.component_id, v.vec_id) AS component_id,
       v.vec_id = coalesce(c.component_id, v.vec_id) AS kept
FROM v LEFT JOIN comp c ON c.node = v.vec_id LEFT JOIN deg d ON d.a = v.vec_id""",
}
