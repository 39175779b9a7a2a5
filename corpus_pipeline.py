"""From raw documents to a training mix, stage by stage.

Every stage takes all documents that its predecessor kept and is written as Parquet before
the next one reads it. All but the last return the columns of ``documents``. The mix has a
row for each time that a document is taken: its columns, and the output shard and position.

Null and empty texts: the quality model scores them like any text, they link with no
near-duplicate, hold no leak and no personal data, and the mix takes no words from them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.llm.decontaminate import mark_leaks
from riskloom.llm.minhash import Near, near_duplicates
from riskloom.llm.mixing import arrange, mix
from riskloom.llm.pii import find_private, masked
from riskloom.llm.quality import fit_quality, score_quality
from riskloom.session import write_out

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near-duplicates from five-word shingles at a Jaccard similarity of 0.8.
NEAR = Near(percent=80, bands=28, rows=5)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    docs = docs.select(*COLUMNS)
    gam = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, gam).where("predicted = 1").select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts: the one with the smallest id, of several texts
    of that id one. Unrelated texts that share an id stay both, repeated rows become one, and
    rows without words stay, once for each id and text."""
    docs = docs.select(*COLUMNS)
    found = near_duplicates(docs, near=NEAR)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "content")).alias("first")
    chosen = found.where("component is not null").groupBy("component").agg(first).select("first.id", "first.content")
    chosen = chosen.unionByName(found.where("component is null").select("id", "content").distinct())
    keyed = docs.withColumn("key", F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string")))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("id")) & (F.col("key") == F.col("content"))
    named = keyed.join(chosen, same, "left_semi").groupBy("doc_id", "key").agg(F.min(F.struct(*COLUMNS[1:])).alias("d"))
    return named.select("doc_id", "d.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    marked = mark_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.where("not leaked").select(*COLUMNS)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and ``n_chars`` kept in step."""
    found = find_private(docs.select(*COLUMNS))
    text = masked(F.col("text"), F.col("all_spans"))
    size = F.when(F.size("all_spans") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return found.withColumn("text", text).withColumn("n_chars", size).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: the columns of ``documents``, ``shard`` and ``position``."""
    rows = write_out(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "rows")
    placed = arrange(mix(rows, id_col="row", draw_col="doc_id")).select(F.col("id").alias("row"), "shard", "position")
    return rows.join(placed, "row").select(*COLUMNS, "shard", "position")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality), ("MinHash near-dedup", near_duplicate), ("benchmark decontamination", decontamination),
    ("PII", private_data), ("mixing sources", mixture),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = write_out(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
