"""Source inventory as snapshots: compare what is saved with what a scan observed, and derive the next one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.errors import EngineError
from quarrylight.functions import expressions as E


def in_scopes(path, scopes: list[tuple[str, str]]):
    """scopes: (path, kind); a tree holds what is below it, a file only itself."""
    return reduce(lambda a, b: a | b, [E.below(path, p) if kind == "tree" else path == p for p, kind in scopes], F.lit(False))


def diff(saved: DataFrame, observed: DataFrame, scopes: list[tuple[str, str]], present: DataFrame | None = None) -> DataFrame:
    """path, action (new, changed, same, removed, kept), row_revision, digest, bytes of the next snapshot's rows
    and of those removed. saved: path, row_revision, digest, bytes; observed: path, digest, bytes. Removed means
    in scope, not observed, and not among the `present` paths either, which no ignore rule filtered."""
    old = saved.select("path", F.col("row_revision").alias("was"), F.col("digest").alias("old_digest"), F.col("bytes").alias("old_bytes"))
    new = observed.select("path", "digest", "bytes")
    both = old.join(new, "path", "full_outer")
    there = F.lit(False)
    if present is not None:
        both = both.join(present.select("path").distinct().withColumn("there", F.lit(True)), "path", "left")
        there = F.coalesce("there", F.lit(False))
    gone = F.col("digest").isNull() & in_scopes(F.col("path"), scopes) & ~there
    action = F.when(F.col("was").isNull(), "new").when(gone, "removed").when(F.col("digest").isNull(), "kept").when(F.col("digest") == F.col("old_digest"), "same").otherwise("changed")
    revision = F.when(F.col("was").isNull(), F.lit(1)).when(F.col("digest") != F.col("old_digest"), F.col("was") + 1).otherwise(F.col("was")).cast("long")
    return both.select("path", action.alias("action"), revision.alias("row_revision"), F.coalesce("digest", "old_digest").alias("digest"), F.coalesce("bytes", "old_bytes").alias("bytes"))


def totals(sources: DataFrame) -> tuple[int, int]:
    """Count and bytes; a path or id that occurs twice is refused."""
    r = sources.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b"), F.countDistinct("path").alias("p")).first()
    if r["p"] != r["n"]:
        raise EngineError("SOURCE_INVENTORY_CONFLICT")
    return r["n"], r["b"]


def page(sources: DataFrame, size: int, after=None, key: str = "source_id") -> DataFrame:
    """The next `size` rows in the order of the key, from behind the last one seen."""
    rest = sources if after is None else sources.filter(F.col(key) > F.lit(after))
    return rest.orderBy(key).limit(size)


def preflight(changes: DataFrame, max_sources: int | None, max_bytes: int | None) -> None:
    """Projected totals against the limits, before anything is written."""
    r = changes.filter("action <> 'removed'").agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()
    if max_sources is not None and r["n"] > max_sources or max_bytes is not None and r["b"] > max_bytes:
        raise EngineError("SOURCE_CAPACITY_EXCEEDED")


def upsert(saved: DataFrame, path: str, expected_revision: int | None, digest: str, size: int) -> tuple[DataFrame, bool]:
    """Compare-and-set of one row: a stale expectation is refused, equal bytes change nothing."""
    row = saved.filter(F.col("path") == path).select("row_revision", "digest").head(1)
    found = row[0] if row else None
    if (found["row_revision"] if found else None) != expected_revision:
        raise EngineError("SOURCE_STALE")
    if found and found["digest"] == digest:
        return saved, False
    revision = (found["row_revision"] if found else 0) + 1
    one = saved.sparkSession.createDataFrame([(path, revision, digest, size)], "path string, row_revision long, digest string, bytes long")
    return saved.filter(F.col("path") != path).select("path", "row_revision", "digest", "bytes").union(one), True
