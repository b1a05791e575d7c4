"""Content-addressed objects: naming, deduplication, verified reads, marks and sweeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.errors import EngineError
from quarrylight.functions import expressions as E
from quarrylight.schemas import BROADCAST_KEYS, MAX_ARTIFACT_BYTES, MAX_SLICES, MAX_SOURCE_BYTES, SLICE_BYTES

#: Fixed value: the algorithm is named with every digest.
DIGEST_ALG = "sha256"


def stored(contents: DataFrame, kind: str) -> DataFrame:
    """kind, digest, bytes, name, content: one row for each distinct content."""
    rows = contents.filter("content is not null").select(F.lit(kind).alias("kind"), E.digest(F.col("content")).alias("digest"), F.octet_length("content").cast("long").alias("bytes"), "content")
    return rows.dropDuplicates(["digest"]).withColumn("name", E.object_name(F.col("kind"), F.col("digest")))


def read(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """refs (kind, digest, bytes) with content and status: ok, missing, or integrity_failure."""
    held = objects.select("kind", "digest", F.col("content").alias("content"))
    out = refs.join(held, ["kind", "digest"], "left")
    fine = (F.octet_length("content") == F.col("bytes")) & (E.digest(F.col("content")) == F.col("digest"))
    return out.withColumn("status", F.when(F.col("content").isNull(), "missing").when(fine, "ok").otherwise("integrity_failure"))


def statuses(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """read() without the contents: objects are judged where they lie, and what is joined are facts, not bytes."""
    facts = objects.select("kind", "digest", F.octet_length("content").cast("long").alias("held"), (E.digest(F.col("content")) == F.col("digest")).alias("fine"))
    out = refs.join(facts, ["kind", "digest"], "left")
    return out.withColumn("status", F.when(F.col("held").isNull(), "missing").when(F.col("fine") & (F.col("held") == F.col("bytes")), "ok").otherwise("integrity_failure")).drop("held", "fine")


def marks(*refs: DataFrame) -> DataFrame:
    """All reachable (kind, digest, bytes); one digest with two lengths is refused."""
    every = reduce(lambda a, b: a.unionByName(b), [r.select("kind", "digest", "bytes") for r in refs]).distinct()
    if not every.groupBy("kind", "digest").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        raise EngineError("OBJECT_MARK_CONFLICT")
    return every


def closure(marked: DataFrame, preparations: DataFrame) -> DataFrame:
    """Prepared artifacts pull in their source input; the depth is one."""
    inputs = preparations.select(F.lit("prepared").alias("kind"), F.col("prepared_digest").alias("digest"), F.col("digest").alias("input"), F.col("bytes").alias("input_bytes"))
    pulled = marked.join(inputs, ["kind", "digest"]).select(F.lit("source").alias("kind"), F.col("input").alias("digest"), F.col("input_bytes").alias("bytes"))
    return marks(marked, pulled)


def unreferenced(objects: DataFrame, marked: DataFrame) -> DataFrame:
    return objects.join(marked.select("kind", "digest"), ["kind", "digest"], "left_anti")


def without(objects: DataFrame, gone: DataFrame, n: int) -> DataFrame:
    """objects but for the n that are gone: bytes stay where they are unless too many are gone for a broadcast."""
    names = gone.select("kind", "digest")
    return objects if n == 0 else objects.join(F.broadcast(names) if n <= BROADCAST_KEYS else names, ["kind", "digest"], "left_anti")


def slices(size: int) -> list[Column]:
    """Conditions on the digest, of which every digest fulfils one: about even shares of `size` bytes. They are ranges, as
    objects are stored in the order of their digests."""
    n = min(MAX_SLICES, size // SLICE_BYTES + 1)
    bounds = [f"{256 * k // n:02x}" for k in range(1, n)]
    after = [F.lit(True), *(F.col("digest") >= b for b in bounds)]
    before = [*(F.col("digest") < b for b in bounds), F.lit(True)]
    return [a & b for a, b in zip(after, before)]


def candidates(entries: DataFrame) -> DataFrame:
    """kind, digest, bytes of entries (name, bytes) that a sweep may touch: those with an object's own name and a size
    that its kind allows. All other entries are left alone."""
    part = lambda k: F.regexp_extract("name", r"\Av1-(source|prepared)-([0-9a-f]{64})\z", k)
    most = F.when(F.col("kind") == "source", MAX_SOURCE_BYTES).otherwise(MAX_ARTIFACT_BYTES)
    named = entries.select(part(1).alias("kind"), part(2).alias("digest"), "bytes").filter("kind <> ''")
    return named.filter((F.col("bytes") >= 0) & (F.col("bytes") <= most))
