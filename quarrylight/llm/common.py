"""Reading tables, tables written to the shared folder, and small helpers of the operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and Python form of one word of the contracts: no ASCII white space in it.
WORD = r"[^\x20\x09-\x0D]+"

#: Paths of the tables that materialize() wrote, by application and owner.
_written: dict[tuple[str, str], list[str]] = {}
_owner: list[str] = [""]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where it is unset in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="quarrylight-")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault((spark.sparkContext.applicationId, _owner[-1]), []).append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def owned(owner: str):
    """Tables written inside belong to `owner`, so that release() can tell them from all others."""
    _owner.append(owner)
    try:
        yield
    finally:
        _owner.pop()


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def read_paths(df: DataFrame) -> set[str]:
    """The folders and files that the plan of df reads."""
    leaves, out = df._jdf.queryExecution().analyzed().collectLeaves(), set()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            paths = leaf.relation().location().rootPaths()
            out |= {paths.apply(k).toUri().getPath() for k in range(paths.size())}
    return out


def release(spark: SparkSession, owner: str = "", needed: DataFrame | None = None) -> None:
    """Delete the tables that materialize() wrote for `owner` in this application, but for those that `needed` reads.
    Results of the owner's operators that were not read yet need their tables: call this once they are."""
    key = (spark.sparkContext.applicationId, owner)
    keep = read_paths(needed) if needed is not None else set()
    paths = _written.pop(key, [])
    for path in paths:
        if spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath() in keep:
            _written.setdefault(key, []).append(path)
        else:
            delete(spark, path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


#: Bytes of one Arrow batch; a Python worker holds a few copies of one, as texts, results and output.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """df, after its session's Arrow batches were bounded, unless they were set to something else than Spark's default."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_SETTING) == "67108864b":
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df


def byte_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def sub_batches(batch: pa.RecordBatch, texts: list[bytes | None], limit: int = 1 << 20):
    """(start, end) ranges of rows whose texts hold about `limit` bytes; a longer text has a range of its own."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def ascii_lower(column):
    """A-Z only, as the contracts ask; lower() would fold all of Unicode."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
