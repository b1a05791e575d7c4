"""Immutable generations under a root folder, named by one manifest that is replaced in one step.

Readers resolve the manifest once and then read only that generation's folders, which nothing changes later.
All access goes through Hadoop's file systems, so a root may be any that Spark can open."""

from __future__ import annotations

import gc
import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.errors import EngineError
from quarrylight.functions import expressions as E
from quarrylight.schemas import MAX_RETIRED

EMPTY = {"format": 1, "digest_alg": "sha256", "wanted_revision": 0, "next_generation": 1, "snapshot": 0, "selections": [], "settings": None, "current": None, "retired": [], "objects": 0}


GENERATION_TABLES = ("gen_sources", "units", "postings", "terms")


class Root:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *names) -> str:
        return "/".join([self.path, *map(str, names)])

    def _p(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, *names) -> bool:
        return self._fs.exists(self._p(self.at(*names)))

    def delete(self, *names) -> None:
        self._fs.delete(self._p(self.at(*names)), True)

    def delete_path(self, path: str) -> None:
        self._fs.delete(self._p(path), True)

    def take(self, other: str) -> None:
        """Another root becomes this one, in one step."""
        self._fs.mkdirs(self._p(self.path).getParent())
        if not self._fs.rename(self._p(other), self._p(self.path)):
            raise EngineError("ROOT_NOT_TAKEN")

    def write(self, df: DataFrame, *names, mode: str = "overwrite") -> None:
        """A table below the root, without the shuffle files that it was made of."""
        df.write.mode(mode).option("compression", "zstd").parquet(self.at(*names))
        self.tidy()

    def tidy(self) -> None:
        """The disk would hold the shuffle files of jobs that are over until the driver happens to collect its garbage. What
        listeners have yet to be told of a job still holds it, so they are told first."""
        gc.collect()
        try:
            self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        except Py4JJavaError:  # they are slow; the next call comes soon
            pass
        self._jvm.System.gc()

    def write_text(self, path: str, text: str) -> None:
        out = self._fs.create(self._p(path), True)
        out.write(bytearray(text.encode()))
        out.close()

    def state(self) -> str:
        """absent, incomplete (no manifest) or ready."""
        return "absent" if not self.exists() else "ready" if self.exists("manifest.json") else "incomplete"

    def initialize(self) -> None:
        if self.state() == "ready":
            raise EngineError("ROOT_ALREADY_INITIALIZED")
        self.write_manifest(dict(EMPTY))

    def discard_incomplete(self) -> None:
        if self.state() != "incomplete":
            raise EngineError("ROOT_NOT_INCOMPLETE")
        self.delete()

    def manifest(self) -> dict:
        if not self.exists("manifest.json"):
            raise EngineError("ROOT_NOT_INITIALIZED")
        stream = self._fs.open(self._p(self.at("manifest.json")))
        try:
            out = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        if out.keys() != EMPTY.keys() or out["format"] != 1:
            raise EngineError("ROOT_FORMAT_UNKNOWN")
        return out

    def write_manifest(self, value: dict, expected: dict | None = None) -> None:
        """Compare with what was read, write beside it, replace in one step."""
        if expected is not None and self.manifest() != expected:
            raise EngineError("ROOT_CHANGED")
        side = self.at("_manifest.json")
        self.write_text(side, json.dumps(value, sort_keys=True))
        over = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = over
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._p(self.at()).toUri() if self._p(self.at()).toUri().getScheme() else self._jvm.java.net.URI("file:///"), self.spark._jsc.hadoopConfiguration()).rename(self._p(side), self._p(self.at("manifest.json")), options)


def offsets(counts: DataFrame) -> DataFrame:
    """source_id and the ordinal of its first unit, from the sources' counts n: running offsets over the sources' ranges, so
    that no step sorts all of them in one task."""
    parts = max(1, counts.sparkSession.sparkContext.defaultParallelism)
    dealt = counts.repartitionByRange(parts, "source_id").withColumn("part", F.spark_partition_id())
    dealt = dealt.withColumn("inside", F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("source_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = dealt.groupBy("part").agg(F.sum("n").alias("held"))
    before = sums.select("part", F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a part
    return dealt.join(F.broadcast(before), "part").select("source_id", (F.col("inside") + F.col("before")).cast("long").alias("offset"))


def with_points(units: DataFrame, generation: int) -> DataFrame:
    """Dense ordinals in (source_id, unit) order."""
    counts = units.groupBy("source_id").agg(F.count("*").alias("n"))
    out = units.join(offsets(counts), "source_id").withColumn("ordinal", (F.col("offset") + F.col("unit")).cast("long")).drop("offset")
    return out.withColumn("point_id", E.point_id(generation, F.col("ordinal")))


def faults(units: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows that break the graph: units of unknown sources, gaps or overlaps in units, wrong counts, repeated points."""
    w = Window.partitionBy("source_id").orderBy("unit")
    chained = units.withColumn("before", F.lag("end", 1, 0).over(w)).withColumn("number", F.row_number().over(w) - 1)
    broken = chained.filter("start <> before or unit <> number").select("source_id", F.lit("unit_chain").alias("fault"))
    unknown = units.join(sources, "source_id", "left_anti").select("source_id", F.lit("unknown_source").alias("fault"))
    counted = sources.filter("state = 'ready'").join(units.groupBy("source_id").agg(F.count("*").alias("n")), "source_id", "left")
    short = counted.filter("coalesce(n, 0) <> units").select("source_id", F.lit("unit_count").alias("fault"))
    twice = units.groupBy("point_id").agg(F.count("*").alias("n"), F.min("source_id").alias("source_id")).filter("n > 1").select("source_id", F.lit("repeated_point").alias("fault"))
    return broken.union(unknown).union(short).union(twice)


def drop_generation(root: Root, n: int) -> None:
    for name in GENERATION_TABLES:
        root.delete(name, f"generation={n}")


def expired(manifest: dict, now: float, grace_s: float) -> tuple[list, list]:
    """The retired generations [number, time] whose grace is over, and those that readers may still have pinned.
    Obligations over the limit are refused."""
    if len(manifest["retired"]) > MAX_RETIRED:
        raise EngineError("RETIRED_LIMIT")
    over = [r for r in manifest["retired"] if r[1] + grace_s <= now]
    return over, [r for r in manifest["retired"] if r not in over]
