"""Corpus pipeline: quality rules, near duplicates, benchmark leaks, mixing, token files.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``. An empty table passes through all stages; nulls are
handled as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import decontaminate, mixing, near_dedup, quality, token_output
from pagemill.llm.queries import tokenizer_path
from pagemill.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. The verdict runs on each row as it is read, so rows without
    or with repeated ids keep their own."""
    return quality.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by five-word shingles with a similarity of 0.8: the one
    with the least id, a null id being the greatest; of repeated rows one.

    Rows are told apart by a 64-bit hash of all their columns, so rows that share an id or have none are compared and
    decided each for itself. Documents without words are in no group: only rows alike in all columns are one. Texts
    meet thin tables of the keys that go and of those that are there more than once; no text is sorted or grouped
    but those of repeated rows."""
    key = "key"
    while key in docs.columns:
        key = f"_{key}"
    keyed = docs.withColumn(key, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    found = near_dedup.near_duplicates(keyed, near_dedup.Plan(), doc_id=key)
    found = materialize(found.select(F.col("doc_id").alias(key), "component_id").distinct(), "found")
    ids = keyed.groupBy(key).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    ids = materialize(ids, "ids")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key)).alias("first")
    kept = found.join(ids, key).groupBy("component_id").agg(first).select(F.col(f"first.{key}").alias(key))
    gone = materialize(found.select(key).join(kept, key, "left_anti"), "gone")
    repeated = ids.where("n > 1").select(key)
    left = keyed.join(gone, key, "left_anti")
    once = left.join(repeated, key, "left_anti")
    if not repeated.isEmpty():
        once = once.unionByName(left.join(repeated, key, "left_semi").dropDuplicates([key]))
    return once.select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, decided row by row; null and wordless texts stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminated(docs, items)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one without words is taken in whole copies, the one at a source's limit is
    cut. ``n_chars`` is that of the text as taken. A null source is a source of its own."""
    return mixing.mixed(docs).withColumn("n_chars", F.length("text").cast("long"))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and the digest of each document read back from them; a null text is the end id alone."""
    return token_output.token_output(docs, token_output.Layout(tokenizer_path()))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("token_output", token_files),
]

#: SQL has no tokenizer; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
