"""documents to packed training sequences: language, near duplicates, personal data, source mix, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. Empty tables, null
columns and extra columns pass through as the operators' docstrings say; all stages but the last return the
columns of documents."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import langid, minhash, mixing, packing, pii
from quarrylight.llm.common import delete, materialize, owned, release, shared_dir, table, unused
from quarrylight.llm.queries import tokenizer_path


OWNER = "pipeline"


def _stage(f):
    """The stage's own tables are known as the pipeline's. Those of earlier stages go first, unless docs reads them."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, OWNER, needed=docs)
        with owned(OWNER):
            return f(spark, docs, sf_dir)

    return run_stage


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language; rejected: null, empty or letterless texts and unsure predictions."""
    return langid.keep_identified(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id, null ids last. Rows are told apart by
    a written row id, so repeated rows and copies with a null or an equal doc_id go like all others."""
    row, own, component, first = unused(docs, "dup_row", "dup_doc_id", "dup_component", "dup_first")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    judged = minhash.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), F.col("component_id").alias(component))
    ids = rows.select(row, F.col("doc_id").cast("long").alias(own))
    least = F.min(F.struct(F.col(own).isNull().alias("none"), own, row)).alias(first)
    stay = judged.join(ids, row).groupBy(component).agg(least).select(F.col(f"{first}.{row}").alias(row))
    gone = judged.join(stay, row, "left_anti").select(row)
    return rows.join(gone, row, "left_anti").select(*docs.columns)


@_stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data in the text replaced by its kind; n_chars follows the new text."""
    out = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return out
    size = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType))


@_stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    return mixing.drawn(docs)


@_stage
def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces with their places in sequences."""
    return packing.packed(docs, tokenizer_path())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("source_mix", source_mix), ("best_fit", best_fit)]

#: Trained models and sketches are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written and read again; a stage's table is deleted once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            delete(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    release(spark, OWNER)
    return docs
