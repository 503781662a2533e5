"""The numbered operators as registered queries over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import (arc, bpe, decontaminate, imi, jaccard_join, packing, pii, quality, suffix_dedup, topk, toxicity,
                           vector_codes, whitening)
from panelcast.llm.common import table

#: Vocabulary file of the token queries; workers open it at the same place.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def in_fold(modulus: int, remainder: int) -> Column:
    """Whether crc32 of the doc_id's text leaves this remainder (a null id is in no fold)."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.coalesce(crc % modulus == remainder, F.lit(False))


@query
def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0, k=10, scale=1024)


ORACLE["op1_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e
           FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT * FROM v WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e::DOUBLE[], v.e::DOUBLE[])::BIGINT AS score
      FROM q JOIN v ON q.vec_id <> v.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
             vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = in_fold(5, 0)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", keep=~held_out)
    scored = toxicity.score(docs, model, score_col="score", columns=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), length=50)


ORACLE["op3_suffix_dedup"] = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, h, octet_length(unhex(h)) AS n FROM d),
w AS MATERIALIZED (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 100)) AS s
      FROM (SELECT doc_id, h, unnest(range(n - 49)) AS i FROM b WHERE n >= 50)),
first AS (SELECT s, min(doc_id) AS doc FROM w GROUP BY s HAVING count(*) > 1),
hit AS (SELECT w.doc_id, w.i FROM w JOIN first USING (s) WHERE w.doc_id > first.doc),
marked AS (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM hit),
grouped AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM grouped GROUP BY doc_id, g),
per AS (SELECT doc_id, sum(z - a) AS cut, count(*) AS k, list(a ORDER BY a) AS starts, list(z ORDER BY a) AS ends FROM spans GROUP BY doc_id),
kept AS (SELECT b.doc_id, n, coalesce(cut, 0) AS cut, coalesce(k, 0) AS k,
    CASE WHEN k IS NULL THEN h ELSE list_aggregate(list_transform(range(k + 1), lambda j: substr(h,
        2 * (CASE WHEN j = 0 THEN 0 ELSE ends[j] END) + 1,
        2 * ((CASE WHEN j = k THEN n ELSE starts[j + 1] END) - (CASE WHEN j = 0 THEN 0 ELSE ends[j] END)))), 'string_agg', '') END AS rest
  FROM b LEFT JOIN per USING (doc_id))
SELECT doc_id, n::BIGINT AS n_bytes, cut::BIGINT AS n_removed, k::BIGINT AS n_spans, sha256(unhex(rest)) AS kept_sha256 FROM kept
"""


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY)


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    held_out = in_fold(4, 2)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", keep=~held_out)
    scored = quality.score(docs, model, score_col="score", columns=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.join_components(docs, jaccard_join.Rule(n=4, percent=85))


ORACLE["op6_jaccard"] = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
r AS (SELECT doc_id AS v, doc_id AS u FROM n UNION SELECT r.v, e.b FROM r JOIN edges e ON r.u = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.u, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT v, min(u) AS u FROM r GROUP BY v) m ON m.v = d.doc_id
"""


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.pseudonymise(docs, found_col="found")
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda f: f["kind"]))), ",")
    return out.select("doc_id", "text", F.size("found").cast("long").alias("n_replaced"), kinds.alias("kinds"))


@query
def op8_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = arc.archive_round_trip(table(spark, sf_dir, "pages"), "page_id", min_bytes=0)
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op8_arc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS s FROM p),
d AS (SELECT page_id, n, s, list_aggregate(list_transform(range(8), lambda k: (
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(s, 5 * k + 1, 5))::INTEGER >> 15) & 31) + 1, 1) ||
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(s, 5 * k + 1, 5))::INTEGER >> 10) & 31) + 1, 1) ||
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(s, 5 * k + 1, 5))::INTEGER >> 5) & 31) + 1, 1) ||
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(s, 5 * k + 1, 5))::INTEGER & 31) + 1, 1))), 'string_agg', '') AS digest
      FROM h)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = max(page_id) OVER (PARTITION BY digest) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = max(page_id) OVER (PARTITION BY digest) THEN NULL ELSE max(page_id) OVER (PARTITION BY digest) END AS refers_to
FROM d
"""


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY)


@query
def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return imi.search(vectors, F.col("vec_id") % 50 == 0, k=5)


@query
def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.find(docs, table(spark, sf_dir, "benchmark"), n=10, found_col="found")
    items = F.array_sort("found.items")
    return out.select("doc_id", "found.n_words", "found.n_hit", F.size(items).cast("long").alias("n_items"),
                      F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
                      (F.col("found.n_hit") > 0).alias("contaminated"))


ORACLE["op11_decontaminate"] = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS MATERIALIZED (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
g AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT k FROM g),
w AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g
      FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, lens WHERE len(ws) >= k)),
hit AS MATERIALIZED (SELECT w.doc_id, w.k, w.i, g.item_id FROM w JOIN g USING (k, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=32, scale=64)


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), scale=1024)


def _codes_sql() -> str:
    """Codebooks round by round; a part is (part, vec_id, x), a codebook (part, entry, c)."""
    parts = ["""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, e[part * len(e) // 4 + 1:(part + 1) * len(e) // 4] AS x FROM v, range(4) t(part)),
c0 AS MATERIALIZED (SELECT part, entry, x AS c FROM p JOIN (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT 256) s USING (vec_id))"""]
    near = """
a{r} AS MATERIALIZED (SELECT part, vec_id, any_value(x) AS x, min((d, entry)) AS best FROM (
  SELECT p.part, p.vec_id, p.x, c.entry, list_sum(list_transform(list_zip(p.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM p JOIN c{r} c USING (part)) GROUP BY part, vec_id)"""
    for r in range(4):
        parts.append(near.format(r=r))
        parts.append(f"""
m{r} AS (SELECT part, entry, list(m ORDER BY i) AS c FROM (
  SELECT part, best[2] AS entry, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS m FROM a{r}, range(1, len(x) + 1) t(i)
  GROUP BY part, best[2], i) GROUP BY part, entry),
c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN m{r} m USING (part, entry))""")
    parts.append(near.format(r=4))
    return ",".join(parts) + """,
o AS (SELECT vec_id, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error FROM a4 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS h FROM c4)
SELECT o.vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256
FROM o JOIN v USING (vec_id), h
"""


ORACLE["op13_vector_codes"] = _codes_sql()
