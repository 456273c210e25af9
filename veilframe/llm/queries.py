"""The ten operators as queries over whole tables, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff, bpe, langid, mixing, secrets, sharding, simhash, vectors, warc
from .common import small_batches

RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op2_sampled_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op4_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.lm_scores(_table(spark, sf_dir, "documents"))


def op5_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_pages(_table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp", "capture")


def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(_table(spark, sf_dir, "documents")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op8_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(_table(spark, sf_dir, "embeddings"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_vector_near_dedup, op2_sampled_sharding, op3_byte_bpe, op4_backoff_scores, op5_warc_index, op6_secret_ledger,
        op7_simhash, op8_permutation_index, op9_source_mix, op10_language,
    )
}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

# Every pair of one label by its cosine, and the components of the links by a recursive walk.
_OP1 = """
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS r, * FROM embeddings
), v AS (
  SELECT r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM t
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.r AS a, b.r AS b, b.vec_id AS id FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), walk(a, b, id) AS (
  SELECT a, b, id FROM l UNION SELECT walk.a, l.b, l.id FROM walk JOIN l ON walk.b = l.a
), c AS (SELECT a, min(id) AS low FROM walk GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.low, vec_id)) AS component_id,
  coalesce(vec_id <= coalesce(c.low, vec_id), true) AS kept
FROM t LEFT JOIN c ON c.a = r LEFT JOIN n ON n.a = r
"""

# The order by digests, the shard of each record's middle byte; CRC-32 by its table of 256 remainders.
_OP2 = """
WITH t AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))
), d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT + 8 AS size, md5(coalesce(text, '')) || md5(coalesce(doc_id::VARCHAR, '')) AS k,
    hex(encode(coalesce(text, ''))) AS h FROM documents
), s AS (
  SELECT *, sum(size) OVER (ORDER BY k, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total, row_number() OVER (ORDER BY k, size) AS nth FROM d
), p AS (
  SELECT doc_id, size, h, nth, least(23, (2 * upto - size) * 24 // (2 * total))::INTEGER AS shard FROM s
)
SELECT doc_id, size,
  xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS text_crc32,
  'bytes' AS law, shard, nth - min(nth) OVER (PARTITION BY shard) AS slot, NULL::INTEGER AS grown_shard
FROM p, t
"""

_OP4 = f"""
WITH w AS (
  SELECT rowid AS r, doc_id, {_WORDS} AS w FROM documents_r
), g AS (
  SELECT r, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a
  FROM w, unnest(range(1, len(w) + 1)) AS u(i)
), c1 AS (SELECT c, count(*) AS n FROM g GROUP BY c),
c2 AS (SELECT b, c, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY b, c),
c3 AS (SELECT a, b, c, count(*) AS n FROM g WHERE a IS NOT NULL GROUP BY a, b, c),
s AS (
  SELECT g.r, sum(ln(CASE
    WHEN c3.n >= 2 THEN c3.n / h2.n::DOUBLE
    WHEN c2.n >= 2 THEN CASE WHEN g.a IS NOT NULL THEN 0.4 ELSE 1 END * c2.n / h1.n::DOUBLE
    ELSE CASE WHEN g.a IS NOT NULL THEN 0.16 WHEN g.b IS NOT NULL THEN 0.4 ELSE 1 END * c1.n / (SELECT count(*) FROM g)::DOUBLE END)) AS s, count(*) AS n
  FROM g JOIN c1 ON c1.c = g.c LEFT JOIN c2 ON c2.b = g.b AND c2.c = g.c LEFT JOIN c3 ON c3.a = g.a AND c3.b = g.b AND c3.c = g.c
    LEFT JOIN c1 h1 ON h1.c = g.b LEFT JOIN c2 h2 ON h2.b = g.a AND h2.c = g.b
  GROUP BY g.r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(round(s.s, 6), 0)::DOUBLE AS score, round(s.s / s.n, 6)::DOUBLE AS mean_score
FROM w LEFT JOIN s USING (r)
""".replace("rowid AS r, doc_id", "row_number() OVER () AS r, doc_id").replace("documents_r", "documents")

_OP5 = """
WITH u AS (
  SELECT *, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top,
    regexp_replace(coalesce(url, 'urn:page:' || coalesce(page_id::VARCHAR, '')), '#.*', '') AS link,
    strftime(make_timestamp((coalesce(page_id, 0) % 4102444800) * 1000000), '%Y%m%d%H%M%S') AS stamp
  FROM pages
), k AS (
  SELECT *, regexp_extract(link, '://(?:www\\.)?([^/?]*)', 1) AS host, regexp_extract(link, '://[^/?]*(.*)$', 1) AS tail FROM u
), p AS (
  SELECT *, CASE WHEN contains(link, '://') THEN array_to_string(list_reverse(string_split(lower(host), '.')), ',') || ')' || CASE WHEN tail = '' THEN '/' ELSE tail END ELSE link END AS url_key FROM k
)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(s, (5 * i // 4 + 1)::BIGINT, 2))::BIGINT >> (3 - 5 * i % 4)) & 31)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN top IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN top IS DISTINCT FROM page_id THEN top END AS refers_to,
  url_key, stamp AS timestamp, row_number() OVER (ORDER BY encode(url_key), stamp, page_id NULLS FIRST) - 1 AS capture
FROM p
"""

# Offsets from the lengths of gaps and matches, kind by kind.
_OP6_KIND = """
SELECT r, {ord} AS ord, '{kind}' AS kind, s AS start, s + len(m[i]) AS "end", m[i] AS hit FROM (
  SELECT r, i, m, len(g[i]) + coalesce(list_sum(list_transform(range(1, i), lambda j: len(g[j]) + len(m[j]))), 0)::BIGINT AS s FROM (
    SELECT r, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT r, regexp_extract_all(t, $p${pattern}$p$) AS m, regexp_split_to_array(t, $p${pattern}$p$) AS g FROM d)))
WHERE {passes}"""
_OP6 = (
    "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), f AS ("
    + " UNION ALL ".join(
        _OP6_KIND.format(ord=n, kind=r.kind, pattern=r.pattern, passes=(
            f"len(regexp_extract(hit, $p${r.pattern}$p$, {r.group})) >= {r.least}" if r.group else f"len(hit) >= {r.least}"))
        for n, r in enumerate(secrets.RULES)
    )
    + """), s AS (
SELECT r, list(f ORDER BY start, ord) AS f FROM f GROUP BY r)
SELECT doc_id, len(list_filter(f, lambda x: x.kind = 'assign'))::BIGINT AS n_assign, len(list_filter(f, lambda x: x.kind = 'access'))::BIGINT AS n_access,
  len(list_filter(f, lambda x: x.kind = 'hex'))::BIGINT AS n_hex,
  sha256(array_to_string(list_transform(list_filter(f, lambda x: x.ord < 3), lambda x: x.kind || ':' || x.start || ':' || x."end"), ',')) AS base_sha256,
  array_to_string(list_transform(f, lambda x: x.kind || ':' || x.start || ':' || x."end"), ',') AS spans
FROM (SELECT doc_id, coalesce(f, []) AS f FROM d LEFT JOIN s USING (r))
"""
)

# Caps are met in the order of size by weight; then the prefix by seeded digest and the one nearest document.
_OP9 = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    md5(CASE WHEN doc_id IS NULL THEN '' ELSE doc_id || ':' END || '11:' || md5(coalesce(text, ''))) AS k FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS total, [5, 2, 1][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)] AS w FROM d GROUP BY source
), o AS (
  SELECT *, 3 * total AS cap, coalesce(sum(3 * total) OVER before, 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS weight, sum(total) OVER () AS everything
  FROM s WINDOW before AS (ORDER BY 3 * total / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), r AS (
  SELECT (everything - capped) / weight::DOUBLE AS rate FROM o WHERE cap * weight >= (everything - capped) * w
  ORDER BY cap / w::DOUBLE, source NULLS LAST LIMIT 1),
t AS (
  SELECT source, total, least(cap::DOUBLE, coalesce(w * rate, cap)) AS target FROM o, r
), q AS (
  SELECT source, total, target, CASE WHEN total = 0 THEN 0 ELSE least(floor(target + 0.5)::BIGINT // total, 3) END AS base FROM t
), n AS (SELECT *, CASE WHEN base >= 3 THEN 0 ELSE floor(target + 0.5)::BIGINT - base * total END AS rest FROM q),
e AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k) AS r FROM d), c AS (
  SELECT e.doc_id, e.source, e.size, e.k, e.r, n.total, n.target, n.base, n.rest,
    sum(e.size) OVER (PARTITION BY e.source ORDER BY e.r ROWS UNBOUNDED PRECEDING) AS upto
  FROM e JOIN n ON e.source IS NOT DISTINCT FROM n.source
), g AS (SELECT source, any_value(rest) - coalesce(sum(size) FILTER (upto <= rest), 0) AS gap FROM c GROUP BY source),
b AS (
  SELECT c.source, first(c.r ORDER BY abs(g.gap - c.size), c.r) AS r FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source
  WHERE c.upto > c.rest AND c.size > 0 AND abs(g.gap - c.size) < g.gap GROUP BY c.source
)
SELECT c.doc_id, c.size, c.total AS source_size, round(c.target, 6)::DOUBLE AS target,
  (c.size * (c.base + CASE WHEN c.upto <= c.rest OR (c.size > 0 AND c.r = b.r) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c LEFT JOIN b ON c.source IS NOT DISTINCT FROM b.source
"""

ORACLE_SQL: dict[str, str] = {
    "op1_vector_near_dedup": _OP1, "op2_sampled_sharding": _OP2, "op4_backoff_scores": _OP4, "op5_warc_index": _OP5,
    "op6_secret_ledger": _OP6, "op9_source_mix": _OP9,
}
