"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op2_byte_level_bpe
from .langid import op6_language_id
from .lattice import op1_embedding_near_dedup
from .minhash import op8_document_fingerprints
from .ngram_join import op5_ngram_jaccard_join
from .packing import op10_best_fit_packing
from .resampling import byte_table, op11_importance_resampling
from .secrets import op7_secret_scans
from .sharding import op13_sharding
from .substring import op3_substring_dedup
from .toxicity import op4_toxicity
from .trie import op12_prefix_trie
from .warc import op9_warc

#: The text of the first 50 words on, in DuckDB's SQL: every window with the smallest id that has it.
OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), v AS (
  SELECT doc_id, unnest(range(0, greatest(len(words) - 49, 0)::BIGINT)) AS i, words FROM w
), h AS (
  SELECT doc_id, i, sha256(array_to_string(words[i + 1 : i + 50], ' ')) AS window_hash FROM v
), r AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i
  FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY window_hash) AS first_id FROM h) WHERE first_id < doc_id
), g AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_filter(words, lambda x, k: gone IS NULL OR NOT list_contains(gone, k - 1)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""

OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm FROM embeddings
), good AS (SELECT * FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL AND norm > 0 AND isfinite(norm)),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""

OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) < 3 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i : i + 2], ' ')) END) AS shingle FROM w WHERE len(words) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 90 * (p.n + q.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM documents JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP9_SQL = r"""
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
         strftime(to_timestamp(1704067200 + page_id % 1000000000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS captured,
         split_part(regexp_replace(regexp_replace(lower(coalesce(url, '')), '^[a-z]+://', ''), '^www\.', ''), '#', 1) AS rest
  FROM pages
), k AS (
  SELECT *, array_to_string(list_reverse(string_split(split_part(rest, '/', 1), '.')), ',') || ')' || substr(rest, length(split_part(rest, '/', 1)) + 1) AS url_key,
         max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN first_id END AS refers_to, url_key, captured,
       row_number() OVER (ORDER BY url_key, captured, page_id) - 1 AS position
FROM k
"""

def crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, as unsigned number: a table of what each byte leaves, made here, and a fold over the bytes."""
    each = "(" + str(byte_table().tolist()) + "::BIGINT[])"
    bytes_ = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: ('0x' || b)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda a, b: xor(a >> 8, {each}[1 + (xor(a, b) & 255)])), 4294967295::BIGINT)"


OP11_SQL = rf"""
WITH x AS (SELECT true AS mine, doc_id, text FROM documents UNION ALL SELECT false, item_id, text FROM benchmark),
w AS (
  SELECT mine, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM x
), f AS (
  SELECT mine, doc_id, feature, count(*) AS n FROM (
    SELECT mine, doc_id, unnest(flatten(list_transform([1, 2, 3], lambda k: list_transform(range(1, greatest(len(words) - k + 2, 1)), lambda i: array_to_string(words[i : i + k - 1], ' '))))) AS feature FROM w
  ) GROUP BY ALL
), b AS (SELECT feature, {crc32_sql("feature")} % 10000 AS bucket FROM (SELECT DISTINCT feature FROM f)),
g AS (SELECT mine, doc_id, bucket, sum(n)::DOUBLE AS n FROM f JOIN b USING (feature) GROUP BY ALL),
s AS (SELECT sum(n) FILTER (mine) AS s_all, sum(n) FILTER (NOT mine) AS t_all FROM g),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain
  FROM (SELECT bucket, coalesce(sum(n) FILTER (mine), 0) AS s, coalesce(sum(n) FILTER (NOT mine), 0) AS t FROM g GROUP BY bucket), s
), d AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n::BIGINT * gain)::BIGINT AS weight FROM g JOIN gain USING (bucket) WHERE mine GROUP BY doc_id),
o AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM w LEFT JOIN d USING (doc_id) WHERE mine
), r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank, n_words FROM r
"""

OP12_SQL = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS nth, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY nth) AS own, {crc32_sql("conv_id::VARCHAR")} % 9 AS h FROM t GROUP BY conv_id),
m AS (SELECT c.conv_id, list_concat(coalesce(b.own[1 : c.h], []), coalesce(c.own[c.h + 1 :], [])) AS turns FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 5),
p AS (SELECT conv_id, d AS depth, turns[1 : d] AS prefix, len(turns) = d AS ending FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM m)),
n AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ending), '') AS ends,
         (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE octet_length(encode(prefix[depth].text)) END AS own
  FROM p GROUP BY depth, prefix
), k AS (SELECT depth - 1 AS depth, prefix[1 : depth - 1] AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
l AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, prefix)),
s AS (
  SELECT d AS depth, prefix[1 : d] AS prefix, sum(own) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM l) GROUP BY ALL
)
SELECT l.conv_id, l.depth, u.conv_id AS parent_conv_id, l.n_convs::BIGINT AS n_convs, l.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(l.ends) AS ends_sha256
FROM l JOIN s USING (depth, prefix) LEFT JOIN n u ON u.depth = l.depth - 1 AND u.prefix = l.prefix[1 : l.depth - 1]
"""

OP13_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
r AS (
  SELECT *, substr(sha256('42:' || doc_id), 1, 16) AS h, row_number() OVER (PARTITION BY source ORDER BY substr(sha256('42:' || doc_id), 1, 16), doc_id) - 1 AS nth, count(*) OVER (PARTITION BY source) AS n FROM d
), a AS (SELECT *, row_number() OVER (ORDER BY (2 * nth + 1)::DOUBLE / (2 * n)::DOUBLE, source NULLS FIRST, h, doc_id) - 1 AS place, count(*) OVER () AS every FROM r)
SELECT doc_id, (octet_length(encode(text)) + 16)::BIGINT AS size, {crc32_sql("text")} AS text_crc32, 'rows' AS law, (place * 40 // every)::INTEGER AS shard,
       row_number() OVER (PARTITION BY place * 40 // every ORDER BY place) - 1 AS slot, NULL::INTEGER AS grown_shard, source
FROM a
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_embedding_near_dedup, op2_byte_level_bpe, op3_substring_dedup, op4_toxicity, op5_ngram_jaccard_join, op6_language_id, op7_secret_scans, op8_document_fingerprints, op9_warc, op10_best_fit_packing, op11_importance_resampling, op12_prefix_trie, op13_sharding)
}
ORACLE_SQL: dict[str, str] = {"op1_embedding_near_dedup": OP1_SQL, "op3_substring_dedup": OP3_SQL, "op5_ngram_jaccard_join": OP5_SQL, "op9_warc": OP9_SQL, "op11_importance_resampling": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_sharding": OP13_SQL}
