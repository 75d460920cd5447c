"""The queries opN_<name> of this package, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bottomk, bpe, hard_negatives, kneser_ney, minhash, packing, periodic, sharding, simhash, suffix_dedup, topk, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_dedup.remove_repeats(docs, 200)
    return out.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.size("_spans").cast("long").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))


OP1_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
n AS (SELECT doc_id, h, octet_length(h) AS size FROM d),
p AS (SELECT doc_id, size, unnest(range(0, greatest(size - 199, 0), 500)) AS p, h FROM n),
w AS (SELECT doc_id, p, array_slice(h, p + 1, p + 699) AS part, unnest(range(least(500, size - 199 - p))) AS j FROM p),
m AS (SELECT doc_id, p + j AS i, md5(array_slice(part, j + 1, j + 200)) AS m FROM w),
again AS (SELECT m FROM m GROUP BY m HAVING count(*) > 1),
hit AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, true) AS new FROM m WHERE m IN (SELECT m FROM again)),
numbered AS (SELECT doc_id, i, sum(new::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hit),
spans AS (SELECT doc_id, run, min(i) AS s, max(i) + 200 AS e FROM numbered GROUP BY doc_id, run),
kept AS (
  SELECT doc_id, string_agg(CASE WHEN upto > begun THEN hex(array_slice(h, begun + 1, upto)) ELSE '' END, '' ORDER BY begun) AS k FROM (
    SELECT doc_id, h, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS begun, s AS upto FROM (
      SELECT doc_id, s, e, h FROM spans JOIN n USING (doc_id) UNION ALL SELECT doc_id, size, size + 1, h FROM n)) GROUP BY doc_id),
told AS (SELECT doc_id, sum(e - s) AS removed, count(*) AS spans FROM spans GROUP BY doc_id)
SELECT n.doc_id, n.size AS n_bytes, coalesce(t.removed, 0)::BIGINT AS n_removed, coalesce(t.spans, 0)::BIGINT AS n_spans, sha256(unhex(k.k)) AS kept_sha256
FROM n JOIN kept k USING (doc_id) LEFT JOIN told t USING (doc_id)
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("l_id")))
    scored = toxicity.with_score(docs.select("doc_id", "lang", F.col("text").cast("string").alias("text")), model)
    cut = toxicity.threshold_of(model, F.col("lang"))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), cut.alias("lang_threshold"), (F.col("score") >= cut).alias("flagged"))


def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.pages_through_archives(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
q AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN first_id END AS refers_to
FROM r
"""


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, 2, with_ids=False)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.minimax_shards(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_hash")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprints_with_edits(table(spark, sf_dir, "documents"))


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("key")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), tau=2, size=3)


def op9_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), *vocab), *vocab)
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 5, 10, (30, 90, 100), label=label, scale=256)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, c.label = a.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
      FROM v a JOIN v c ON c.vec_id <> a.vec_id AND len(c.e) = len(a.e) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score WHERE p.r <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def periodic_tail(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The words of one document in ten with a tail that repeats a period, by the checksum of its id."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.repetition(table(spark, sf_dir, "documents"), 4, 6, rewrite=periodic_tail))


OP12_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS o,
  xor(4294967295::BIGINT, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda c, b: list_reduce([0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295::BIGINT)) AS h FROM documents),
g AS (SELECT doc_id, o, len(o) AS n, h % 10 = 0 AND len(o) > 0 AS planted, h // 10 AS g FROM d),
a AS (SELECT *, CASE WHEN planted THEN g % n ELSE 0 END AS a FROM g),
p AS (SELECT *, CASE WHEN planted THEN 1 + (n - a) // (3 + g % 8) ELSE 1 END AS p FROM a),
w AS (SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: o[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE o END AS w FROM p),
lags AS (SELECT doc_id, n, w, unnest(range(1, n // 4 + 1)) AS q FROM w WHERE n >= 6),
steps AS (SELECT *, greatest(6 - q, 3 * q) // 3 AS step FROM lags),
hit AS (SELECT doc_id, n, w, q FROM steps
  WHERE len(list_filter(range(0, n - q - 2 * step, step), lambda j: w[j + 1] = w[j + q + 1] AND w[j + step + 1] = w[j + step + q + 1] AND w[j + 2 * step + 1] = w[j + 2 * step + q + 1])) > 0),
gaps AS (SELECT doc_id, q, unnest(list_concat([-1], list_filter(range(n - q), lambda i: w[i + 1] <> w[i + q + 1]), [n - q])) AS gap FROM hit),
between AS (SELECT doc_id, q, lag(gap) OVER (PARTITION BY doc_id, q ORDER BY gap) + 1 AS start, gap AS stop FROM gaps),
one AS (SELECT doc_id, start, stop - start + q AS length, min(q) AS period FROM between WHERE stop - start + q >= greatest(6, 4 * q) GROUP BY doc_id, start, stop - start + q),
best AS (SELECT doc_id, count(*) AS n_runs, arg_min((start, length, period), (-(length / period), start, period)) AS b, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM one GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM one),
rest AS (SELECT w.doc_id, w.i, w.word FROM (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM w) w ANTI JOIN dropped x ON x.doc_id = w.doc_id AND x.i = w.i),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS k FROM rest GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b[1]::BIGINT AS start, b[2]::BIGINT AS length, b[3]::BIGINT AS period, (1000 * b[2] // b[3])::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k, '')) AS collapsed_sha256
FROM w LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op13_bottomk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.near_duplicates(table(spark, sf_dir, "documents"), bottomk.Rule(3, 85, 100)).drop("key")


OP13_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(array_slice(w, i + 1, i + 3), ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 2, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
c AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least AS component_id, d.doc_id = least AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.a = d.doc_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_arc_to_warc": op3_arc_to_warc,
    "op4_packing": op4_packing,
    "op5_sharding": op5_sharding,
    "op6_minhash": op6_minhash,
    "op7_kneser_ney": op7_kneser_ney,
    "op8_simhash": op8_simhash,
    "op9_maxscore_topk": op9_maxscore_topk,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_bottomk": op13_bottomk,
}

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": OP1_SQL,
    "op3_arc_to_warc": OP3_SQL,
    "op9_maxscore_topk": OP9_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_periodic_runs": OP12_SQL,
    "op13_bottomk": OP13_SQL,
}
