"""The registered queries of the operators, with the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (ball_codes, exact_dedup, line_crf, maxscore, minhash, mixing, pii, quality, secret_scan, sentence_pieces, sharding,
               sketch_search, suffix_dedup)
from .common import table

SHARDS = 24
#: A public SentencePiece model; any other path may be set in the environment.
PIECES = os.environ.get("CLIENTELE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def op1_zstd_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op2_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"), k=3, percent=85)


def op4_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))


def op5_maxscore_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.search(table(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op9_sparse_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode(table(spark, sf_dir, "documents"), sentence_pieces.load(PIECES))


def op11_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_codes.report(table(spark, sf_dir, "embeddings"))


def op13_sketch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_zstd_secret_scan, op2_byte_cnn_quality, op3_circulant_minhash, op4_rendezvous_sharding, op5_maxscore_search, op6_mixing, op7_exact_dedup, op8_pii,
        op9_sparse_suffix_repeats, op10_sentencepiece, op11_line_crf, op12_ball_codes, op13_sketch_search)}

def _ball_codes_sql(parts: int = ball_codes.PARTS, entries: int = ball_codes.ENTRIES, rounds: int = ball_codes.ROUNDS) -> str:
    """Plain rounds of assignment and mean over all entries, as DuckDB SQL."""
    ctes = [f"""v AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
            f"""p AS (
  SELECT r, vec_id, label, j AS part, list_slice(vec, j * len(vec) // {parts} + 1, (j + 1) * len(vec) // {parts}) AS x
  FROM v, range(0, {parts}) t(j))""",
            f"""e0 AS (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id NULLS LAST, r) - 1 AS entry, x AS c FROM p
  QUALIFY entry < {entries})"""]
    for i in range(rounds + 1):
        ctes.append(f"""a{i} AS (
  SELECT r, part, min(d * {entries} + entry) % {entries} AS entry, min(d * {entries} + entry) // {entries} AS d FROM (
    SELECT p.r, p.part, e.entry, list_sum(list_transform(list_zip(p.x, e.c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT AS d
    FROM p JOIN e{i} e ON p.part = e.part) GROUP BY r, part)""")
        if i < rounds:
            ctes.append(f"""m{i} AS (
  SELECT part, entry, list(fl ORDER BY k) AS c FROM (
    SELECT p.part, a.entry, k, ((sum(p.x[k]) - ((sum(p.x[k]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS fl
    FROM p JOIN a{i} a ON p.r = a.r AND p.part = a.part, LATERAL (SELECT unnest(range(1, len(p.x) + 1)) AS k) GROUP BY p.part, a.entry, k)
  GROUP BY part, entry)""")
            ctes.append(f"e{i + 1} AS (SELECT part, entry, coalesce(m.c, e.c) AS c FROM e{i} e LEFT JOIN m{i} m USING (part, entry))")
    return "WITH " + ",\n".join(ctes) + f""",
b AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM e{rounds}),
z AS (SELECT r, string_agg(lower(printf('%02x', entry::INT)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT v.vec_id, z.code, z.error, sum(z.error) OVER (PARTITION BY v.label)::BIGINT AS label_error, b.codebooks_sha256
FROM z JOIN v USING (r), b"""


BALL_CODES_SQL = _ball_codes_sql()

ORACLES: dict[str, str] = {
    "op5_maxscore_search": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.vec, c.vec), lambda t: t[1] * t[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM p)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op6_mixing": r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, '')) || ':mix') AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS full_at, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
f AS (
  SELECT *, (total - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM c
  WINDOW b AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(level, full_at) AS level FROM f WHERE level <= full_at),
t AS (SELECT source, source_size, CASE WHEN (SELECT level FROM l) IS NULL THEN cap ELSE least(cap, (SELECT level FROM l) * w) END AS target FROM c),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 1 END::BIGINT AS epochs FROM t),
r AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs,
         2 * sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS UNBOUNDED PRECEDING) - d.size
           <= 2 * (e.target - e.epochs * e.source_size) AND e.target > e.epochs * e.source_size AS more
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (epochs + more::INT))::BIGINT AS taken FROM r""",
    "op7_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS c,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER g = 1 AS kept, h AS text_sha256
FROM t WINDOW g AS (PARTITION BY h ORDER BY c DESC, doc_id NULLS LAST)""",
    "op12_ball_codes": BALL_CODES_SQL,
    "op13_sketch_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ts
  FROM documents),
c AS (SELECT count(*)::HUGEINT AS n, sum(len(ts))::HUGEINT AS l FROM d WHERE len(ts) > 0),
f AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * (SELECT n FROM c) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::HUGEINT AS w FROM f GROUP BY term),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
  FROM benchmark),
m AS (SELECT r, doc_id, (10 + (90 * len(ts)::HUGEINT * (SELECT n FROM c)) // (SELECT l FROM c)) AS m FROM d WHERE len(ts) > 0),
s AS (
  SELECT q.item_id, m.r, m.doc_id, sum(w.w * ((1000000000::HUGEINT * f.tf) // (1000 * f.tf + 8 * m.m)))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN w USING (term) JOIN m ON m.r = f.r GROUP BY q.item_id, m.r, m.doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 10""",
}
