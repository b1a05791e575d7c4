"""Quality rules with cross-document line frequency.

Each document gives its word, symbol, repeated-line and repeated-window counts. Its lines are then
normalised (A-Z lower-cased, digits to 0, runs of other characters than letters and digits to one space)
and hashed; for each host the documents that hold a line are counted, over all documents. A line is above
its limit if more than `max_docs` documents of the host hold it, whatever the host's size. apply() removes such
lines from the texts; a document left with less than `min_left` of its words is depleted and rejected. judge()
gives the measures of the same pass. The host of a document is its source.

Nulls: a null text has no words and fails the base rule; a null source is a host of its own. Empty and very
long texts are taken whole; repeated rows each count as a document. Extra columns are kept by apply() as they
are and not read by judge(). An empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm import hashing
from quarrylight.llm.common import bounded, byte_texts, materialize, sub_batches

MAX_DOCS, MIN_LEFT = 20, 0.3
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_DIGIT = bytes(48 if 48 <= b <= 57 else b for b in range(256))
_LOOSE = re.compile(rb"[\x00-/:-@\[-`{-\x7f]+")
SCHEMA = "host long, row_id long, doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lines array<long>, line_words array<int>"


def repeated_words(hashes: np.ndarray, width: int = 5) -> int:
    """Words in windows of `width` words that occur twice or more."""
    found = hashing.windows(hashes, width)
    if len(found) < 2:
        return 0
    order = np.sort(found)
    if not (order[1:] == order[:-1]).any():
        return 0
    _, where, count = np.unique(found, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[where] > 1)
    marks = np.zeros(len(hashes) + 1, dtype=np.int64)
    marks[starts] += 1
    np.subtract.at(marks, starts + width, 1)
    return int(np.count_nonzero(np.cumsum(marks)[:-1]))


def normal_line(line: bytes) -> bytes:
    return _LOOSE.sub(b" ", line.lower().translate(_DIGIT)).strip()


def measure(text: bytes) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then fingerprints and word counts of the distinct normalised lines."""
    hashes = hashing.words(text)
    data = np.frombuffer(text, dtype=np.uint8)
    n = len(hashes)
    chars = int(np.count_nonzero((data & 0xC0) != 0x80)) - sum(text.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    symbols = int(np.count_nonzero(_SYMBOLS[data]))
    seen, held, dups = set(), {}, 0
    for line in text.split(b"\n"):
        k = len(line.split())
        if not k:
            continue
        if line in seen:
            dups += 1
        seen.add(line)
        key = normal_line(line)
        if key:
            held[key] = held.get(key, 0) + k
    return n, chars, symbols, dups, repeated_words(hashes), held


def _measured(batches):
    for batch in batches:
        hosts, rows, docs = batch.column("host"), batch.column("row_id"), batch.column("doc_id")
        texts = byte_texts(batch.column("text"))
        for a, b in sub_batches(batch, texts, 4 << 20):
            got = [measure(t or b"") for t in texts[a:b]]
            failed = [x[0] < 10 or 100 * x[4] > 20 * x[0] for x in got]
            keys = [[_line_key(k) for k in x[5]] for x in got]
            yield pa.RecordBatch.from_arrays(
                [hosts.slice(a, b - a), rows.slice(a, b - a), docs.slice(a, b - a), *(pa.array([x[i] for x in got], pa.int64()) for i in range(5)), pa.array(failed), pa.array(keys, pa.list_(pa.int64())), pa.array([list(x[5].values()) for x in got], pa.list_(pa.int32()))],
                names=["host", "row_id", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lines", "line_words"],
            )


def _line_key(line: bytes) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(line, digest_size=8).digest(), "little", signed=True)


def _judged(rows: DataFrame, max_docs: int, min_left: float) -> DataFrame:
    """row_id, the columns of judge() and common_lines, the keys of the lines to remove, for rows (row_id, doc_id, text, source)."""
    # The host travels as its hash: Python hands host, row_id and doc_id through, and nothing else.
    host = F.xxhash64(F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")))
    source = rows.select(host.alias("host"), "row_id", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    measured = materialize(bounded(source).mapInArrow(_measured, SCHEMA), "measured")
    lines = measured.select("host", "row_id", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("host", "row_id", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    common = lines.groupBy("host", "line").agg(F.count("*").alias("docs")).filter(F.col("docs") > max_docs).select("host", "line")
    gone = lines.join(common, ["host", "line"]).groupBy("row_id").agg(F.sum("words").alias("common"), F.collect_list("line").alias("common_lines"))
    out = measured.drop("lines", "line_words").join(gone, "row_id", "left").withColumn("n_common_words", F.coalesce("common", F.lit(0)).cast("long"))
    kept = ~F.col("base_failed") & (F.col("n_words") - F.col("n_common_words") >= min_left * F.col("n_words"))
    return out.withColumn("kept", kept).select("row_id", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_common_words", "common_lines")


def judge(docs: DataFrame, max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """doc_id, the base measures, base_failed, n_common_words (words in removed lines) and kept."""
    return _judged(docs.select("doc_id", "text", "source").withColumn("row_id", F.monotonically_increasing_id()), max_docs, min_left).drop("row_id", "common_lines")


def without_lines(text: bytes, keys: set[int]) -> bytes:
    """The text without the lines whose normalised form has one of the keys; all others stay as they are."""
    return b"\n".join(line for line in text.split(b"\n") if not ((key := normal_line(line)) and _line_key(key) in keys))


def apply(docs: DataFrame, max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """The kept rows of docs, their texts without the common lines."""
    row, gone = "__quality_row", "__quality_lines"
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    judged = _judged(rows.select(F.col(row).alias("row_id"), "doc_id", "text", "source"), max_docs, min_left)
    kept = rows.join(judged.filter("kept").select(F.col("row_id").alias(row), F.col("common_lines").alias(gone)), row)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keys = batch.column(len(docs_columns)).to_pylist()
            texts = [t if not k else without_lines(t, set(k)) for t, k in zip(byte_texts(batch.column(at)), keys)]
            field = batch.schema.field(at)
            yield batch.select(docs_columns).set_column(at, field, pa.array(texts, pa.binary()).cast(field.type))

    docs_columns = docs.columns
    return bounded(kept.select(*docs_columns, gone)).mapInArrow(run, docs.schema)
