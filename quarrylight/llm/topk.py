"""Exact top-k inner products of a stated query set against all vectors, by tiles.

Components x become floor(256 * x) in double precision. Queries are packed into blocks of QUERY_BLOCK rows,
candidates into shards of SHARD rows within their partitions. Every (shard, block) pair is a tile: one
matrix product, a partial selection of each query's k best, and a merge into the task's own lists. The lists
of all tasks are then merged by query in two steps, before and after the shuffle. Products run in float64 while
the largest possible sum is below 2**53, else in exact integers. Query blocks are broadcast only up to
BROADCAST_BYTES, measured; beyond it each part of the shards joins its own copy of them.

Nulls: null vectors and those holding null or non-finite components take no part, as query or candidate; nor
do rows with a null vec_id. Rows are told apart by a written row id: of rows with equal vec_id each is a query
with a list of its own and a candidate of all the others. A query is only scored against vectors of its own
length. An empty vector has the score 0 with every other empty vector. Scores
beyond 64 bits raise an error. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import materialize

QUERY_BLOCK, SHARD, K, EVERY = 2048, 4096, 5, 50
#: Packed query blocks up to this measured size are sent to all executors; beyond it they are shuffled.
BROADCAST_BYTES = 32 << 20


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id, the integer components (exact in double) and a row id of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    floor = F.transform(x, lambda v: F.rint(v * 256) - F.when(F.rint(v * 256) > v * 256, 1.0).otherwise(0.0))  # floor() would go through a long
    return vectors.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), floor.alias("x"), F.monotonically_increasing_id().alias("row"))


def _blocks(size: int):
    """Rows of (dim, row and vector ids, matrix): `size` vectors of one length in each."""

    def run(batches):
        held: dict[int, tuple[list, list]] = {}

        def out(dim, ids, rows):
            data = np.array(rows, dtype=np.float64).reshape(len(ids), dim)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.array(ids, dtype=np.int64).tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())], names=["dim", "ids", "data"])

        for batch in batches:
            for r, i, x in zip(batch.column("row").to_pylist(), batch.column("vec_id").to_pylist(), batch.column("x").to_pylist()):
                ids, rows = held.setdefault(len(x), ([], []))
                ids.append((r, i))
                rows.append(x)
                if len(ids) >= size:
                    yield out(len(x), *held.pop(len(x)))
        for dim, (ids, rows) in held.items():
            yield out(dim, ids, rows)

    return run


def tile(q_rows: np.ndarray, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """The k best (score, vec_id) of each query in this tile but for its own row, ties to the smaller vec_id."""
    dim = q.shape[1]
    top = max(1.0, float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, dim))
    if top < 2**53:
        scores = (q @ x.T).astype(np.int64)
    else:
        a, b = np.array([[int(v) for v in r] for r in q], dtype=object).reshape(q.shape), np.array([[int(v) for v in r] for r in x], dtype=object).reshape(x.shape)
        exact = a.dot(b.T) if dim else np.zeros((len(q), len(x)), dtype=object)
        if any(abs(int(v)) >= 2**63 for v in exact.ravel()):
            raise OverflowError("a score is beyond 64 bits")
        scores = exact.astype(np.int64)
    order = np.argsort(ids, kind="stable")
    ids, rows, scores = ids[order], rows[order], scores[:, order]
    out = []
    for i, own in enumerate(q_rows):
        s, other = scores[i], rows != own
        if not other.all():
            s, names = s[other], ids[other]
        else:
            names = ids
        if len(s) > k:
            least = np.partition(s, len(s) - k)[len(s) - k]
            over = np.flatnonzero(s > least)
            tied = np.flatnonzero(s == least)[: k - len(over)]  # ids ascend
            pick = np.concatenate([over, tied])
        else:
            pick = np.arange(len(s))
        out.append([(int(s[j]), int(names[j])) for j in pick])
    return out


def _tiles(k: int):
    def run(batches):
        best: dict[tuple[int, int], list[tuple[int, int]]] = {}  # by row and vec_id of the query
        for batch in batches:
            for row in range(batch.num_rows):
                dim, qi, q, ids, x = (batch.column(c)[row].as_py() for c in ("dim", "q_ids", "q_data", "ids", "data"))
                q_ids, ids = np.frombuffer(qi, dtype=np.int64).reshape(-1, 2), np.frombuffer(ids, dtype=np.int64).reshape(-1, 2)
                q, x = np.frombuffer(q).reshape(len(q_ids), dim), np.frombuffer(x).reshape(len(ids), dim)
                for name, found in zip(map(tuple, q_ids.tolist()), tile(q_ids[:, 0], q, ids[:, 0], ids[:, 1], x, k)):
                    best[name] = sorted([*best.get(name, []), *found], key=lambda p: (-p[0], p[1]))[:k]
            if len(best) > 4 * QUERY_BLOCK:  # other blocks follow: what is there goes on to the merge
                yield _lists(best)
                best = {}
        yield _lists(best)

    return run


def _lists(best: dict) -> pa.RecordBatch:
    rows = [(*q, i, s) for q, found in best.items() for s, i in found]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], names=["query_row", "query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every query (vec_id divisible by `every`)."""
    spark = vectors.sparkSession
    rows = materialize(whole(vectors), "vectors")
    queries = rows.filter(F.col("vec_id") % every == 0)
    count = queries.count()
    blocks = -(-count // QUERY_BLOCK)
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dealt = queries.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(blocks))).repartition(blocks, "part")
    packed = dealt.mapInArrow(_blocks(QUERY_BLOCK), "dim int, ids binary, data binary").select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    packed = materialize(packed, "queries")
    shards = rows.mapInArrow(_blocks(SHARD), "dim int, ids binary, data binary")
    if (packed.agg(F.sum(F.length("q_data"))).first()[0] or 0) <= BROADCAST_BYTES:
        tiles = shards.join(F.broadcast(packed), F.col("dim") == F.col("q_dim"))
    else:  # every part of the shards gets a copy of the query blocks, by shuffle
        parts = max(1, rows.rdd.getNumPartitions())
        salted = packed.withColumn("q_salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        dealt = shards.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int"))
        tiles = dealt.join(salted, (F.col("dim") == F.col("q_dim")) & (F.col("salt") == F.col("q_salt")))
    lists = tiles.select("dim", "q_ids", "q_data", "ids", "data").mapInArrow(_tiles(k), "query_row long, query_id long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return lists.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
