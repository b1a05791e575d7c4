"""Tables as sources: one row is one source, with a synthetic saved path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import expressions as E


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than cores (one small file) is dealt to all of them; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def from_documents(documents: DataFrame) -> DataFrame:
    """source_id, path, source_class, content, text."""
    ext = F.when(F.col("doc_id") % 5 == 0, "md").otherwise("txt")
    vendor = F.when(F.col("doc_id") % 7 == 0, "vendor/").otherwise("")
    path = F.concat(F.lit("/corpus/"), "lang", F.lit("/"), "source", F.lit("/"), vendor, F.col("doc_id").cast("string"), F.lit("."), ext)
    out = documents.select(F.col("doc_id").alias("source_id"), path.alias("path"), F.encode("text", "UTF-8").alias("content"), "text")
    return out.withColumn("source_class", E.source_class(F.col("path")))


def from_conversations(conversations: DataFrame) -> DataFrame:
    """One source a conversation: its turns in order, as `role: text` lines."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    joined = F.array_join(F.transform(turns, lambda t: F.concat_ws(": ", t.role, t.text)), "\n")
    return conversations.groupBy(F.col("conv_id").alias("source_id")).agg(joined.alias("text"))


def from_pages(pages: DataFrame) -> DataFrame:
    """Pages with their url as a path."""
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", "/"), r"[?#].*$", "")
    return pages.select(F.col("page_id").alias("source_id"), path.alias("path"), F.encode("html", "UTF-8").alias("content"), F.col("html").alias("text")).withColumn("source_class", E.source_class(F.col("path")))
