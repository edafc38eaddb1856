"""Queries over the driver's tables, one for each operator, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdforge.llm import (
    bloom_lm,
    decontaminate,
    fill_in_middle,
    hamming_join,
    langid,
    lattice_hash,
    mixing,
    permutation_index,
    prefix_trie,
    repeats,
    sp_codec,
    token_counts,
    toxicity,
)
from mdforge.llm.common import ready

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), WORDS)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(_table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_codec.encode_digests(_table(spark, sf_dir, "documents"), PIECES)

def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"), PIECES)

def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_join.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=4)

def op6_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digests(_table(spark, sf_dir, "documents"))

def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_hash.near_vectors(_table(spark, sf_dir, "embeddings"))

def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)

def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score(_table(spark, sf_dir, "documents"))

def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.severities(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))

def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(_table(spark, sf_dir, "documents"))

def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))

def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_token_counts, op3_nearest_neighbours, op4_toxicity, op5_source_mixing, op6_repeated_bytes, op7_near_vectors, op8_lm_scores, op9_near_duplicates, op10_sentencepiece, op11_fill_in_middle, op12_decontamination, op13_prefix_trie)}

ORACLE: dict[str, str] = {
    "op5_source_mixing": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('11:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::DOUBLE AS n,
         ((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::DOUBLE AS w
  FROM d GROUP BY source),
-- Each source that stays full at the common level, tried from the one that fills first.
t AS (
  SELECT a.source, a.n, a.w,
         ((SELECT sum(n) FROM s) - coalesce((SELECT sum(3 * b.n) FROM s b WHERE 3 * b.n / b.w < 3 * a.n / a.w), 0))
           / (SELECT sum(b.w) FROM s b WHERE 3 * b.n / b.w >= 3 * a.n / a.w) AS level
  FROM s a),
r AS (SELECT arg_min(level, 3 * n / w) FILTER (WHERE 3 * n / w > level) AS rate FROM t),
g AS (
  SELECT source, n, least(3 * n, coalesce(rate * w, 3 * n)) AS target,
         (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 2 = 0 AS rising
  FROM t, r),
q AS (
  SELECT d.*, g.n::BIGINT AS source_size, g.target, g.rising,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
n AS (SELECT row_number() OVER () AS r, * FROM q),
e AS (
  SELECT r, e * source_size + b + words / 2 AS middle, words, target, rising
  FROM (SELECT *, greatest(0, least(size, round(target)::BIGINT - e * source_size - b::BIGINT)) AS words
        FROM (SELECT r, size, b, source_size, target, rising, unnest([0, 1, 2]) AS e FROM n))
  WHERE words > 0),
-- The moment at which the integral of a weight that falls or rises by half reaches the middle.
p AS (
  SELECT r, words, 2 * y / (1.0::DOUBLE - a + sqrt(greatest((1.0::DOUBLE - a) * (1.0::DOUBLE - a) + 4 * a * y, 0.0::DOUBLE))) AS position
  FROM (SELECT r, words, least(middle / target, 1.0::DOUBLE) AS y, CASE WHEN rising THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS a FROM e)),
u AS (SELECT r, sum(words)::BIGINT AS taken, count(*)::INT AS epochs, min(position) AS position FROM p GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(epochs, 0)::INT AS epochs, position
FROM n LEFT JOIN u USING (r)
""",
    "op11_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
""",
    "op12_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
found AS (
  SELECT r, i, x.k, item_id
  FROM (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS phrase
        FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)) x
  JOIN windows y ON x.k = y.k AND x.phrase = y.phrase),
hit AS (SELECT r, count(DISTINCT i + j) AS n FROM (SELECT r, i, unnest(range(k)) AS j FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
""",
    "op13_prefix_trie": r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
-- crc32 of the id's digits: the fold of its bytes, each with its eight steps.
digits AS (SELECT conv_id, count(*) AS n, [ord(x) FOR x IN string_split(conv_id::VARCHAR, '')] AS bytes FROM t GROUP BY conv_id),
crc AS (
  SELECT conv_id, n, xor(list_reduce(list_concat([4294967295::BIGINT], [x::BIGINT FOR x IN bytes]),
    lambda a, x: list_reduce(list_concat([xor(a, x)], [0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT]),
      lambda c, y: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT) AS crc
  FROM digits),
convs AS (
  SELECT c.conv_id, c.n, c.conv_id - c.conv_id % 20 AS base, c.crc % 4 AS h, least(c.crc % 4, coalesce(b.n, 0)) AS shared
  FROM crc c LEFT JOIN crc b ON b.conv_id = c.conv_id - c.conv_id % 20),
r AS (
  SELECT c.conv_id, t.place, t.role, t.text FROM convs c JOIN t ON t.conv_id = c.base WHERE t.place < c.shared
  UNION ALL
  SELECT c.conv_id, t.place - c.h + c.shared, t.role, t.text FROM convs c JOIN t USING (conv_id) WHERE t.place >= c.h),
pre AS (
  SELECT conv_id, place + 1 AS depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         list(role || chr(31) || text) OVER (PARTITION BY conv_id ORDER BY place) AS seq
  FROM r UNION ALL SELECT conv_id, 0, 0, [] FROM convs),
path AS (SELECT conv_id, depth, words, min(conv_id) OVER (PARTITION BY depth, seq) AS rep FROM pre),
nodes AS (
  SELECT p.rep AS conv_id, p.depth, count(*) AS n_convs, max(p.words) AS words, max(q.rep) AS parent_conv_id
  FROM path p LEFT JOIN path q ON q.conv_id = p.conv_id AND q.depth = p.depth - 1 GROUP BY ALL),
children AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
own AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (conv_id, depth)),
sums AS (
  SELECT p.rep AS conv_id, p.depth, sum((o.n_children = 0)::BIGINT) AS n_leaves, sum((o.n_convs - 1) * o.words) AS saved
  FROM own o JOIN path p ON p.conv_id = o.conv_id AND p.depth <= o.depth GROUP BY ALL),
ends AS (
  SELECT rep AS conv_id, depth, string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) AS ids
  FROM path p JOIN (SELECT conv_id, max(depth) AS depth FROM path GROUP BY ALL) USING (conv_id, depth) GROUP BY ALL)
SELECT o.conv_id::BIGINT AS conv_id, o.depth::BIGINT AS depth, o.parent_conv_id::BIGINT AS parent_conv_id, o.n_convs::BIGINT AS n_convs,
       o.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM own o JOIN sums s USING (conv_id, depth) LEFT JOIN ends e USING (conv_id, depth)
""",
}
