"""The registered corpus queries: thin digests over the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (exact_dedup, html_text, langid, licenses, minhash, mixing, negatives, packing, pii, secret_scan,
                         simhash, topk, whitening)
from tessera.sources.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


@register("op1_mix_sources", r"""
WITH b AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST(CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '~') || '|' || md5(coalesce(text, ''))), 1, 13)
      AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM b GROUP BY source),
r AS (SELECT *, 2.0 * source_size AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w,
    sum(source_size) OVER () * 1.5 AS total FROM s),
o AS (SELECT *, sum(cap) OVER k - cap AS cap_before, sum(w) OVER () - (sum(w) OVER k - w) AS w_left FROM r
  WINDOW k AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT max((total - cap_before) / w_left) AS level FROM o WHERE (total - cap_before) / w_left <= cap / w),
t AS (SELECT source, source_size, least(cap, w * coalesce(level, 1e300)) AS target FROM r, l)
SELECT b.doc_id, b.size, t.source_size, CAST(t.target AS DOUBLE) AS target,
  CAST(b.size * CASE WHEN t.source_size = 0 THEN 0 ELSE floor(t.target / t.source_size)
    + CASE WHEN b.u < t.target / t.source_size - floor(t.target / t.source_size) THEN 1 ELSE 0 END END AS BIGINT) AS taken
FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source""")
def op1(spark, sf_dir):
    p = mixing.mix_plan(read(spark, sf_dir, "documents"))
    return p.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@register("op7_exact_dedup", """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY body)""")
def op7(spark, sf_dir):
    return exact_dedup.classify(read(spark, sf_dir, "documents"))


def _listed(kinds):
    """kind:start:end of the spans of these kinds, comma-joined, in the spans' order."""
    mine = F.filter("spans", lambda s: s["kind"].isin(*kinds)) if kinds else F.col("spans")
    return F.array_join(F.transform(mine, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _counts(kinds) -> list:
    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return [count(k) for k in kinds]


@register("op2_pii")
def op2(spark, sf_dir):
    found = pii.find_pii(read(spark, sf_dir, "documents"))
    return found.select("doc_id", *_counts(pii.BASE_KINDS), F.sha2(_listed(pii.BASE_KINDS), 256).alias("base_sha256"),
                        _listed(()).alias("spans"))


@register("op3_secrets")
def op3(spark, sf_dir):
    found = secret_scan.find_secrets(read(spark, sf_dir, "documents"))
    return found.select("doc_id", *_counts(secret_scan.BASE_KINDS),
                        F.sha2(_listed(secret_scan.BASE_KINDS), 256).alias("base_sha256"), _listed(()).alias("spans"))


@register("op5_licenses")
def op5(spark, sf_dir):
    found = licenses.scan_licenses(read(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


@register("op4_simhash")
def op4(spark, sf_dir):
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op6_language_id")
def op6(spark, sf_dir):
    return langid.identify(read(spark, sf_dir, "documents"))


@register("op9_packing")
def op9(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"))


@register("op8_top_k", """
WITH e AS (SELECT vec_id, [CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""")
def op8(spark, sf_dir):
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@register("op10_html_text")
def op10(spark, sf_dir):
    return html_text.extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


@register("op11_minhash", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
k AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM d WHERE len(s) > 0 GROUP BY s),
x AS (SELECT rep, n, unnest(s) AS g FROM k),
l AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(node, root) AS (SELECT rep, rep FROM k UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id,
  d.doc_id = coalesce(c.root, d.doc_id) AS kept
FROM d LEFT JOIN k ON k.s = d.s LEFT JOIN c ON c.node = k.rep""")
def op11(spark, sf_dir):
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


@register("op12_whitening")
def op12(spark, sf_dir):
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


@register("op13_hard_negatives", """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS a, c.vec_id AS c, a.label = c.label AS same,
    CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.v, c.v)]) AS BIGINT) AS score
  FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT a, c, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, c) <= 5),
n AS (SELECT p.a, p.c AS p, s.c AS n, p.score AS ps, s.score AS ns FROM p JOIN s ON s.a = p.a AND NOT s.same
  AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT a AS anchor_id, p AS positive_id, CAST(row_number() OVER k AS INTEGER) AS rank, n AS negative_id,
  ps AS positive_score, ns AS negative_score
FROM n WINDOW k AS (PARTITION BY a, p ORDER BY ns DESC, n) QUALIFY row_number() OVER k <= 10""")
def op13(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)
