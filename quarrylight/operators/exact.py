"""Exact literal search: all overlapping occurrences, explicit gaps, and counts that the limit never touches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.errors import EngineError
from quarrylight.functions import expressions as E
from quarrylight.schemas import EXCERPT_BEFORE, EXCERPT_BYTES, MAX_ITEMS, MAX_QUERY_BYTES


def check(literal: str | bytes, limit: int = 1) -> bytes:
    data = literal.encode() if isinstance(literal, str) else literal
    if not 1 <= len(data) <= MAX_QUERY_BYTES:
        raise EngineError("EXACT_LITERAL_INVALID")
    if not 1 <= limit <= MAX_ITEMS:
        raise EngineError("EXACT_LIMIT_INVALID")
    return data


def select(sources: DataFrame, ids: list | None = None, prefix: str | None = None, source_class: str | None = None) -> DataFrame:
    """Sources by id, path prefix and class together. An explicit empty list, repeated or unknown ids, a bad
    prefix and an empty outcome are refused."""
    out = sources
    if ids is not None:
        if not ids:
            raise EngineError("EXACT_EMPTY_SELECTION")
        if len(set(ids)) != len(ids):
            raise EngineError("EXACT_SOURCE_REPEATED")
        out = out.filter(F.col("source_id").isin(ids))
        if out.count() != len(ids):
            raise EngineError("EXACT_SOURCE_NOT_PUBLISHED")
    if prefix is not None:
        if not prefix.startswith("/") or len(prefix.encode()) > 4096 or "\0" in prefix or ".." in prefix.split("/"):
            raise EngineError("EXACT_PREFIX_INVALID")
        out = out.filter(E.below(F.col("path"), prefix))
    if source_class is not None:
        out = out.filter(F.col("source_class") == source_class)
    if (prefix is not None or source_class is not None) and out.isEmpty():
        raise EngineError("EXACT_SELECTION_EMPTY")
    return out


def summary(sources: DataFrame, literal: str | bytes, limit: int = MAX_ITEMS, *also) -> DataFrame:
    """One row of facts over all sources, and of other aggregates of the same pass. content is null for a source whose
    bytes or text are missing."""
    return facts(counted(sources, check(literal, limit)), limit, *also)


def counted(sources: DataFrame, data: bytes) -> DataFrame:
    """sources with there, size and hits in place of content."""
    there = F.col("content").isNotNull()
    # Only sources that hold the literal at all pay for counting it.
    hits = F.when(there & F.contains("content", F.lit(data)), E.occurrences(E.latin1(F.col("content")), data.decode("latin-1"))).otherwise(0)
    return sources.withColumns({"there": there, "size": F.octet_length("content").cast("long"), "hits": hits}).drop("content")


def facts(counted: DataFrame, limit: int, *also) -> DataFrame:
    there = F.col("there")
    facts = counted.agg(
        F.count("*").alias("selected_sources"),
        F.count_if(there).alias("scanned_sources"),
        F.coalesce(F.sum(F.when(there, F.col("size"))), F.lit(0)).cast("long").alias("scanned_bytes"),
        F.coalesce(F.sum(F.when(there, F.col("hits"))), F.lit(0)).cast("long").alias("matches"),
        *also,
    )
    facts = facts.withColumn("missing_sources", F.col("selected_sources") - F.col("scanned_sources"))
    facts = facts.withColumn("items", F.least(F.lit(limit), F.col("matches") + F.col("missing_sources")).cast("long"))
    facts = facts.withColumn("scan_complete", F.col("missing_sources") == 0)
    facts = facts.withColumn("complete_negative", F.col("scan_complete") & (F.col("matches") == 0) & (F.col("selected_sources") != 0))
    return facts.withColumn("stop", F.when(F.col("items") < F.col("matches") + F.col("missing_sources"), "output_limit").otherwise("complete"))


def floor_char(data: bytes, at: int) -> int:
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return min(at, len(data))


def ceil_char(data: bytes, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def line_excerpt(data: bytes, line_start: int, match: int) -> tuple[int, int]:
    """From at most 128 bytes before the match on its line, to the line's LF or 512 bytes."""
    start = ceil_char(data, max(match - EXCERPT_BEFORE, line_start))
    bound = min(len(data), start + EXCERPT_BYTES)
    lf = data.find(b"\n", match, bound)
    return start, lf + 1 if lf >= 0 else floor_char(data, bound)


def positions(data: bytes, literal: bytes):
    at = data.find(literal)
    while at >= 0:
        yield at
        at = data.find(literal, at + 1)


def _found(literal: bytes, limit: int):
    def run(batches):
        for batch in batches:
            rows = []
            ids = batch.column("source_id").to_pylist()
            for i, content in enumerate(batch.column("content")):
                if not content.is_valid:
                    rows.append((ids[i], "gap", None, None, None, None, None, None))
                    continue
                data, line, seen = content.as_buffer().to_pybytes(), 1, 0
                for k, at in enumerate(positions(data, literal)):
                    if k >= limit:
                        break
                    line += data.count(b"\n", seen, at)
                    seen = at
                    a, b = line_excerpt(data, data.rfind(b"\n", 0, at) + 1, at)
                    rows.append((ids[i], "match", at, at + len(literal), line, a, b, data[a:b]))
            kinds = [batch.schema.field("source_id").type, pa.string(), *[pa.int64()] * 5, pa.binary()]
            columns = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["source_id", "kind", "start", "end", "line", "excerpt_start", "excerpt_end", "excerpt"])

    return run


def items(sources: DataFrame, literal: str | bytes, limit: int) -> DataFrame:
    """The first items by (source_id, start): matches, and one gap for each missing source. A source can
    contribute no more than `limit`, so each keeps its first ones only; counting is summary()'s."""
    data = check(literal, limit)
    held = sources.select("source_id", "content").filter(F.col("content").isNull() | F.contains("content", F.lit(data)))
    kind = held.schema["source_id"].dataType.simpleString()
    found = held.mapInArrow(_found(data, limit), f"source_id {kind}, kind string, start long, end long, line long, excerpt_start long, excerpt_end long, excerpt binary")
    out = found.orderBy("source_id", F.asc_nulls_first("start")).limit(limit)
    shown = F.when(F.col("kind") == "match", F.lit(data))
    return out.withColumn("hex", E.hex_lower(shown)).withColumn("ascii", E.printable(shown)).withColumn("excerpt", F.decode("excerpt", "UTF-8") if isinstance(literal, str) else E.printable(F.col("excerpt")))


def count_all(sources: DataFrame, literals: DataFrame, block: int = 10_000) -> DataFrame:
    """count_each() for a table of literals (literal_id, text) of any size, a block of about `block` of them at a time."""
    blocks, out = max(1, -(-literals.count() // block)), None
    for b in range(blocks):
        part = literals.filter(F.pmod(F.xxhash64("literal_id"), F.lit(blocks)) == b).select("literal_id", "text")
        found = count_each(sources, [(r["literal_id"], r["text"]) for r in part.collect()])  # a block: MAX_QUERY_BYTES a literal at most
        out = found if out is None else out.union(found)
    return out


def count_each(sources: DataFrame, literals: list[tuple[int, str]]) -> DataFrame:
    """literal_id, sources, matches for a set of literals in one pass: an automaton over all of them."""
    by_text: dict[str, list[int]] = {}
    for i, s in literals:
        check(s)
        by_text.setdefault(s, []).append(i)

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for k, s in enumerate(by_text):
            automaton.add_word(s, k)
        automaton.make_automaton()
        held, hits = [0] * len(by_text), [0] * len(by_text)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen = set()
                for _, k in automaton.iter(text or ""):
                    hits[k] += 1
                    seen.add(k)
                for k in seen:
                    held[k] += 1
        rows = [(i, held[k], hits[k]) for k, ids in enumerate(by_text.values()) for i in ids]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["literal_id", "sources", "matches"])

    if not by_text:
        return sources.sparkSession.createDataFrame([], "literal_id long, sources long, matches long")
    found = sources.select("text").mapInArrow(run, "literal_id long, sources long, matches long")
    return found.groupBy("literal_id").agg(F.sum("sources").alias("sources"), F.sum("matches").alias("matches"))
