"""DuckDB twins of the corpus queries that SQL can express."""

from __future__ import annotations

from .mixing import Mix

_WORDS = r"'[^\x20\x09-\x0D]+'"
_MIX = Mix()


def _key(seed: int, *parts: str) -> str:
    text = ", ".join(f"coalesce(({p})::VARCHAR, '')" for p in parts)
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', {text})), 1, 15))::BIGINT"


#: The table of CRC-32 (bits reflected), and the checksum of a text with it.
_CRC_TABLE = """crc AS (SELECT list(v ORDER BY i) AS tab FROM (
  SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b:
    CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) AS v FROM range(256) r(i)))"""
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(t)) + 1),
  lambda k: ('0x' || substr(hex(encode(t)), 2 * k - 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, tab[1 + (xor(a, b) & 255)])), 4294967295::BIGINT)"""

OP4 = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {_WORDS})), 0)::BIGINT AS size,
    {_key(_MIX.seed, "doc_id", "md5(coalesce(text, ''))")} AS key FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][place % 3 + 1] AS weight, 2 * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS share FROM src),
levels AS (
  SELECT *, cap * sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= (share - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS is_full
  FROM weighed),
goals AS (
  SELECT *, CASE WHEN is_full THEN cap::DOUBLE ELSE (share - coalesce(sum(cap) FILTER (is_full) OVER (), 0)) * weight / sum(weight) FILTER (NOT is_full) OVER () END AS target,
    (source_size + {_MIX.block_words - 1}) // {_MIX.block_words} AS n_blocks FROM levels),
parts AS (SELECT *, target / sum(target) OVER () AS part, round(sum(target) OVER () / {_MIX.block_words})::BIGINT AS seats FROM goals WHERE target > 0),
awards AS (
  SELECT place, seats, row_number() OVER (ORDER BY (k - 0.5) / part, place) AS nth
  FROM (SELECT *, unnest(range(1, (seats * part)::BIGINT + 50)) AS k FROM parts)),
quotas AS (SELECT place, count(*) AS won FROM awards WHERE nth <= seats GROUP BY place),
plan AS (
  SELECT g.*, least(coalesce(won, 0), 2 * n_blocks) AS quota,
    CASE WHEN n_blocks > 0 THEN {_key(_MIX.seed, "place")} % n_blocks END AS first FROM goals g LEFT JOIN quotas USING (place)),
placed AS (
  SELECT s.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sized s)
SELECT doc_id, size, source_size, target, (CASE WHEN n_blocks = 0 THEN 0 ELSE quota // n_blocks * size
  + greatest(0, least(least(first + quota % n_blocks, n_blocks) * {_MIX.block_words}, start + size) - greatest(first * {_MIX.block_words}, start))
  + greatest(0, least(greatest(first + quota % n_blocks - n_blocks, 0) * {_MIX.block_words}, start + size) - start) END)::BIGINT AS taken
FROM placed JOIN plan ON placed.source IS NOT DISTINCT FROM plan.source
"""

OP7 = f"""
WITH {_CRC_TABLE},
sized AS (
  SELECT doc_id, source, (octet_length(encode(t)) + 16)::BIGINT AS size, CASE WHEN t = '' THEN 0 ELSE {_CRC} END::BIGINT AS text_crc32,
    {_key(7, "doc_id", "md5(t)")} AS key FROM (SELECT *, coalesce(text, '') AS t FROM documents), crc),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY key, doc_id, text_crc32) AS r, count(*) OVER (PARTITION BY source) AS n FROM sized),
placed AS (SELECT *, row_number() OVER (ORDER BY (2 * r - 1) / (2 * n), source NULLS LAST, r) - 1 AS pos, count(*) OVER () AS everyone FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, (pos * 40 // everyone)::INT AS shard,
  (pos - (pos * 40 // everyone * everyone + 39) // 40)::BIGINT AS slot, NULL::INT AS grown_shard FROM placed
"""

OP10 = """
WITH codes AS (SELECT DISTINCT vec_id AS id, list_transform(embedding[1:64], lambda x: x > 0) AS code FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
pairs AS (
  SELECT q.id AS query_id, c.id AS neighbor_id, list_sum(list_transform(list_zip(q.code, c.code), lambda z: (z[1] <> z[2])::INT))::INT AS distance
  FROM codes q JOIN codes c ON q.id % 20 = 0 AND q.id <> c.id)
SELECT query_id, rank::INT AS rank, neighbor_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM pairs) WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_sainte_lague": OP4, "op7_interleaving": OP7, "op10_multi_index": OP10}
