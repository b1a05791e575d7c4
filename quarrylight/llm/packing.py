"""Best-fit-decreasing packing of token pieces into sequences.

Lengths lie between 1 and the capacity, so best fit decreasing depends on the number of pieces of each length
alone. The driver gets those at most `capacity` counts, whatever the input's size, and packs them exactly as
document by document: a segment tree over remaining capacities finds the tightest open bin in logarithmic
time, and a run of equal pieces that would all go to bins of that capacity is placed at once. The outcome is
a list of runs (length, first rank, last rank, first bin, pieces in each bin, offset), bounded by the
capacity and not by the input; each piece finds its place by its rank among the pieces of its length.

Ranks come from counts of (length, part): parts are a hash of the piece and of bounded number, so no
length, however common, is one task. Nulls: a null text is empty and holds only the end token; a null doc_id is
kept as it is. Repeated rows are packed as often as they come. Very long texts are cut into pieces of the
capacity, the first of which takes the rest. Extra columns are not read. An empty table gives no pieces.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import bounded, materialize

CAPACITY, END_ID = 1024, 2
#: Ranks are counted in parts of at least PART pieces, and in about PARTS parts at most.
PART, PARTS = 200, 1 << 16
#: The pattern's own white space; runs of so many are cut out before it sees them, as it needs stack for each character.
_LONG_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


class ByteBpe:
    """Token ids of a byte-level BPE file of the tokenizers library (ids in order of merges).

    Added tokens of the file are found first, get their own ids, and the text on each side of them is encoded by
    itself. Of a long run of white space all but the last character are one piece, as the pattern has it (the whole run
    at the end of the text)."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError(f"added tokens that are not plain strings in {path}")
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encoding = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = special
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def ids(self, text: str) -> list[int]:
        if any(c in text for c in self.special):
            return [i for x in self.split.split(text) if x for i in ([self.special[x]] if x in self.special else self._ordinary(x))]
        return self._ordinary(text)

    def _ordinary(self, text: str) -> list[int]:
        at, out = 0, []
        for m in _LONG_SPACE.finditer(text):
            end = m.end() - (m.end() < len(text))
            out += self.encoding.encode_ordinary(text[at : m.start()])
            out += self.encoding._encode_single_piece(text[m.start() : end])
            at = end
        return out + self.encoding.encode_ordinary(text[at:] if at else text)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all of the capacity but the first, which takes the rest."""
    first = n % capacity or capacity
    return [(0, first)] + [(a, capacity) for a in range(first, n, capacity)]


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches):
        bpe = ByteBpe(path)
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            rows = []
            for doc, text in zip(docs, batch.column("text").to_pylist()):
                data = np.array([*bpe.ids(text or ""), end_id], dtype="<u4").tobytes()
                for k, (start, length) in enumerate(cut(len(data) // 4, capacity)):
                    part = data[4 * start : 4 * (start + length)]
                    rows.append((doc, k, start, length, zlib.crc32(part), *([part] if with_ids else [])))
            columns = list(zip(*rows)) or [()] * (5 + with_ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bounded(source).mapInArrow(_pieces(tokenizer, capacity, end_id, with_ids), schema)


class Tightest:
    """Segment tree over remaining capacities 0..capacity: the smallest one with open bins, at least a given need."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, r: int, open_: bool) -> None:
        at = r + self.size
        self.any[at] = open_
        while at > 1:
            at >>= 1
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def find(self, need: int) -> int | None:
        at = need + self.size
        if self.any[at]:
            return need
        while at > 1:  # up to the first right-hand sibling with an open bin, then down to its left-most one
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first bin, pieces in each bin, offset) for counts of pieces by length."""
    tree, open_, bins, runs = Tightest(capacity), {}, 0, []  # open_: remaining capacity -> (first bin, number) spans

    def add(r: int, first: int, n: int) -> None:
        if r > 0 and n > 0:
            open_.setdefault(r, []).append((first, n))
            tree.set(r, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            r = tree.find(length)
            if r is None:
                each = capacity // length
                r, (first, n) = capacity, (bins, -(-left // each))
                bins += n
            else:
                first, n = open_[r].pop()
                if not open_[r]:
                    tree.set(r, False)
                each = r // length  # the bin just used stays the tightest while the piece fits
            full = min(n, left // each)
            if full:
                runs.append((length, rank, rank + full * each, first, each, capacity - r))
                add(r - each * length, first, full)
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if n and left and left < each:
                runs.append((length, rank, rank + left, first, left, capacity - r))
                add(r - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            if n and r < capacity:
                add(r, first, n)
    return runs


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (with doc_id, piece, length) and sequence_id, offset. parts is read twice: pass a written table."""
    spark = parts.sparkSession
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(1 << 30))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    if not counts:
        return parts.select("*", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    runs = best_fit_decreasing(counts, capacity)
    held_by = max(PART, sum(counts.values()) // PARTS)
    split = spark.createDataFrame([(k, -(-n // held_by)) for k, n in counts.items()], "length long, n_parts long")
    dealt = parts.join(F.broadcast(split), "length").withColumn("part", F.pmod(part, F.col("n_parts"))).drop("n_parts")
    held = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = held.select("length", "part", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = dealt.withColumn("own", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("own")).drop("before", "own", "part")
    by_length: dict[int, list] = {}
    for length, *run in runs:
        by_length.setdefault(length, []).append(run)
    plan = spark.createDataFrame([(k, v) for k, v in by_length.items()], "length long, runs array<struct<first:long,end:long,bin:long,each:long,at:long>>")
    placed = ranked.join(F.broadcast(plan), "length")
    run = F.expr("filter(runs, x -> rank >= x.first and rank < x.end)[0]")
    placed = placed.withColumn("run", run).withColumn("own", F.col("rank") - F.col("run.first"))
    sequence = F.col("run.bin") + F.floor(F.expr("own div run.each"))
    offset = F.col("run.at") + F.expr("own % run.each") * F.col("length")
    return placed.select(*[c for c in parts.columns], sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece of docs (doc_id, text) with its sequence and offset."""
    return pack(materialize(pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces"), capacity)
