"""Corpus pipeline: quality, near duplicates, decontamination, secrets, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and works on all that its predecessor kept.
All but the last return the columns of `documents`; n_chars follows a changed text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spaxelflow.llm import decontamination, ngram_join, packing, quality, secrets
from spaxelflow.llm.kernel import checkpoint, key_filter, key_filter_column
from spaxelflow.llm.queries import held_out

ORACLE_SQL = None  # the classifier's compressed sizes are not expressible in SQL


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go. It is fitted on the stage's own labelled rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    model = quality.train(docs.where(~held_out()), labels)
    scored = quality.score(docs.select(F.struct(*docs.columns).alias("kept"), "text"), model, ["kept"])
    return scored.where(F.col("score") >= quality.THRESHOLD).select("kept.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, the one with the smallest doc_id (null ids last), whatever ids the rows
    have: different texts that share a doc_id, or have none, all stay, as do rows without words."""
    surplus = checkpoint(ngram_join.surplus(docs))
    # A filter of bounded size says which texts may go; only those are shuffled, for the exact answer.
    maybe = key_filter(surplus, "doc_id")
    suspect = key_filter_column(surplus, "doc_id", maybe)
    doubted = ngram_join.with_set_key(docs, maybe)
    same = doubted.row.doc_id.eqNullSafe(surplus.doc_id) & (doubted.set_key == surplus.set_key)
    kept = docs.where(~suspect).unionByName(doubted.join(surplus, same, "left_anti").select("row.*"))
    several = surplus.where("stays").select("doc_id", "set_key")
    if several.isEmpty():
        return kept
    equal = doubted.where(key_filter_column(several, "set_key")).groupBy("row.doc_id", "set_key").agg(F.min("row").alias("row"))
    once = equal.join(several, equal.doc_id.eqNullSafe(several.doc_id) & (equal.set_key == several.set_key), "left_semi")
    return kept.unionByName(once.select("row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontamination.contamination(docs.select(F.struct(*docs.columns).alias("kept"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["kept"])
    return found.where("n_hit = 0").select("kept.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found in a text gives way to a mark."""
    found = secrets.scan(docs.select(F.struct(*docs.columns).alias("kept"), "text"), ["kept"])
    changed = {"text": F.col("clean_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("spans") == "", F.col("kept.n_chars")).otherwise(F.length("clean_text").cast(docs.schema["n_chars"].dataType))
    return found.select(*[changed.get(c, F.col(f"kept.`{c}`")).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts that are left, placed in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_filter),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; between stages the rows are written to the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
