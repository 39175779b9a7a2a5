"""One query per operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .decontaminate import mark_leaks
from .html import extract
from .minhash import near_duplicates
from .mixing import mix
from .negatives import mine_negatives, relabelled
from .pii import KINDS, find_private, span_text
from .pivots import near_vectors
from .quality import fit_quality, in_fold, score_quality
from .repeats import remove_repeats
from .spelling import group_spellings
from .tokens import count_tokens
from .urls import judge
from .warc import audit, warc_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gam = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, gam)
    return scored.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = mark_leaks(docs, table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "leaked", "leak_item", "leak_share", "leak_answer", "leak_cosine")


@query
def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "shards")


@query
def op7_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    counts = [
        F.size(F.filter("base_spans", (lambda k: lambda s: s["kind"] == k)(k))).cast("bigint").alias(f"n_{kind}")
        for k, kind in enumerate(KINDS[:4])
    ]
    digest = F.sha2(span_text(F.col("base_spans")), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, span_text(F.col("all_spans")).alias("spans"))


@query
def op6_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@query
def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@query
def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "purity", "labels")


@query
def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each section, and one without a section for a document that has none."""
    counted = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select("doc_id", F.explode_outer("sections").alias("s")).select("doc_id", "s.*")


@query
def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


ORACLES["op11_substrings"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(COALESCE(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS k FROM d, unnest(range(1, len(w) - 33)) AS u(i)),
again AS (SELECT r, i FROM s QUALIFY COUNT(*) OVER (PARTITION BY k) > 1),
gone AS (SELECT DISTINCT r, i + o AS i FROM again, range(0, 35) AS x(o)),
word AS (SELECT r, i, w[i] AS v FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
kept AS (
  SELECT r, COUNT(*) AS n, string_agg(v, ' ' ORDER BY i) AS k
  FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - COALESCE(n, 0))::BIGINT AS n_removed, sha256(COALESCE(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


@query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(table(spark, sf_dir, "documents"))


@query
def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_negatives(relabelled(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")))


ORACLES["op13_negatives"] = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, b.r AS other, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
p AS (
  SELECT r, anchor_id, vec_id AS positive_id, other, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY p.r, p.other ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM p JOIN s USING (r, anchor_id)
  WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


@query
def op3_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two replicas of the pages: one has lost some records, the other has lost others and damaged some."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    damage = F.when(F.col("page_id") % 97 == 5, F.concat(F.lit("\x00"), F.substring("html", 2, 1 << 30))).otherwise(F.col("html"))
    first = warc_index(pages.where("page_id % 83 <> 11"))
    second = warc_index(pages.where("page_id % 89 <> 7").withColumn("html", damage))
    return audit(first, second)


_REPLICA = """
{name} AS (
  SELECT page_id AS id, page_id // 4096 AS file, strlen(record) AS length, record,
    COALESCE(SUM(strlen(record)) OVER (PARTITION BY page_id // 4096 ORDER BY page_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
    sha256(sha256(record)) AS hash
  FROM (
    SELECT page_id, 'WARC/1.1' || nl || 'WARC-Type: resource' || nl || 'WARC-Record-ID: <urn:page:' || page_id || '>' || nl
      || 'WARC-Target-URI: ' || url || nl || 'Content-Type: text/html' || nl || 'Content-Length: ' || strlen(body) || nl || nl
      || body || nl || nl AS record
    FROM (SELECT page_id, url, {body} AS body, chr(13) || chr(10) AS nl FROM pages WHERE {kept})))
"""
_FIRST = _REPLICA.format(name="a", body="html", kept="page_id % 83 <> 11")
_SECOND = _REPLICA.format(
    name="b", kept="page_id % 89 <> 7", body="CASE WHEN page_id % 97 = 5 THEN chr(0) || substr(html, 2) ELSE html END"
)
ORACLES["op3_fixity"] = f"""
WITH {_FIRST}, {_SECOND}
SELECT COALESCE(a.id, b.id) AS id,
  CASE WHEN b.id IS NULL THEN 'missing' WHEN a.id IS NULL THEN 'extra' ELSE 'changed' END AS state,
  COALESCE(a."offset", b."offset") AS "offset", COALESCE(a.length, b.length) AS length, a.hash AS hash, b.hash AS other_hash
FROM a FULL JOIN b ON a.id = b.id WHERE a.hash IS DISTINCT FROM b.hash
"""
