"""Language identification by multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and runs of anything but letters become one space; n-grams of 1 to 3 code points are
hashed to BUCKETS dimensions. Counts of each class are summed over the training rows; the log-probability
matrix (BUCKETS x classes, float32) is broadcast; its size does not grow with the input, and more than
MAX_CLASSES languages are refused. A batch is scored in numpy as a sparse sum: the matrix rows of a document's
n-grams, added up. Of languages with equal scores the first by code point is predicted.

Training rows: at most PER_CLASS rows of a language on average, taken by a hash of doc_id below a threshold
that the language's row count fixes; this sample bound is the only limit, and all rows are scored whole.

Nulls: a null text, an empty one or one without a letter is `und` with score 0; rows with a null lang do not
train; a null doc_id is scored, is not held out and does not train. Without any training rows all documents
are `und`. Repeated rows are returned as often as they came. Extra columns are not read by identify() and
kept by keep_identified().
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import bounded

BUCKETS, ORDERS, PER_CLASS, SMOOTH, UNKNOWN = 1 << 15, (1, 2, 3), 600, 0.5, "und"
#: More languages than this are refused: the matrix of 128 KiB a language is broadcast.
MAX_CLASSES = 1000
MIN_SCORE = 0.5
_LETTER = re.compile(r"[^\W\d_]")
_MIX = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)]
#: Code points over this table's size count as letters.
_LETTERS = np.array([chr(i).isalpha() for i in range(1 << 16)] + [True])


def _codes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where(_LETTERS[np.minimum(codes, 1 << 16)], codes, np.uint32(32))
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    return codes[keep]


def grams(codes: np.ndarray) -> list[np.ndarray]:
    """Bucket indices of all n-grams, one array for each order."""
    out, h = [], np.zeros(len(codes), dtype=np.uint32)
    for k, order in enumerate(ORDERS):
        h = (h[: len(codes) - k] ^ codes[k:]) * _MIX[k] if len(codes) > k else h[:0]
        h = h ^ (h >> np.uint32(15))
        out.append((h * _MIX[(k + 1) % 3] >> np.uint32(17)).astype(np.int32))
    return out


def _counted(batches):
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if text and _LETTER.search(text):
                into = total.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                for g in grams(_codes(text)):
                    into += np.bincount(g, minlength=BUCKETS)
    for lang, counts in total.items():
        where = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(where), pa.string()), pa.array(where, pa.int64()), pa.array(counts[where])], names=["lang", "bucket", "n"])


def held_out(doc_id):
    """crc32(doc_id as text) mod 3 is 1; such documents never train."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, per_class: int = PER_CLASS) -> tuple[list[str], np.ndarray]:
    """Language values and the log-probability matrix (BUCKETS x languages)."""
    known = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_CLASSES + 1).collect()}  # one row a language
    if not rows:
        return [], np.zeros((BUCKETS, 0), dtype=np.float32)
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{len(rows)} languages: the model's size is bounded at {MAX_CLASSES}")
    share = F.element_at(F.create_map(*(F.lit(x) for lang, n in sorted(rows.items()) for x in (lang, min(1.0, per_class / n)))), F.col("lang"))
    # By a hash of doc_id: the same rows whatever the partitioning.
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).select("text", "lang")
    counts = bounded(sample).mapInArrow(_counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    matrix = np.zeros((BUCKETS, len(langs)))
    matrix[counts["bucket"].to_numpy(), counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()] = counts["n"].to_numpy()
    matrix += SMOOTH
    return langs, np.log(matrix / matrix.sum(axis=0)).astype(np.float32)


def _scored(shared, text_at: int, rest):
    def score(texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, matrix = shared.value
        picked, said = [], []
        for t in texts:
            if not t or not langs or not _LETTER.search(t):
                picked.append(UNKNOWN)
                said.append(0.0)
                continue
            total = np.zeros(len(langs))
            for g in grams(_codes(t)):
                if len(g) > BUCKETS // 4:  # a long text: each bucket once
                    count = np.bincount(g, minlength=BUCKETS)
                    where = np.flatnonzero(count)
                    total += count[where].astype(np.float64) @ matrix[where].astype(np.float64)
                else:
                    total += matrix[g].sum(axis=0, dtype=np.float64)
            best = int(total.argmax())
            picked.append(langs[best])
            said.append(float(1 / np.exp(total - total[best]).sum()))
        return picked, said

    def run(batches):
        for batch in batches:
            yield rest(batch, *score(batch.column(text_at).to_pylist()))

    return run


def identify(docs: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, text, lang)."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, per_class))

    def rest(batch, langs, scores):
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return bounded(source).mapInArrow(_scored(shared, 2, rest), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, per_class: int = PER_CLASS, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs whose text has a language with at least min_score, all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, per_class))

    def rest(batch, langs, scores):
        return batch.filter(pa.array([lang != UNKNOWN and s >= min_score for lang, s in zip(langs, scores)], pa.bool_()))

    return bounded(docs).mapInArrow(_scored(shared, docs.columns.index("text"), rest), docs.schema)
