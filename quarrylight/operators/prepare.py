"""From bytes to verified text, lines and line-preferred units."""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.functions import expressions as E
from quarrylight.schemas import MAX_LINES, MAX_SOURCE_BYTES, MAX_UNIT_BYTES, MAX_UNITS, PREFERRED_UNIT_BYTES

UNIT_STRUCT = "struct<start:long,end:long,line_start:long,line_end:long,starts_at_line_boundary:boolean,ends_at_line_boundary:boolean>"


def line_spans(texts: DataFrame) -> DataFrame:
    """source_id, line_index, start, end, content_end (bytes, zero-based) of every line."""
    found = texts.select("source_id", E.lines(F.col("text")).alias("lines"))
    rows = found.select("source_id", F.posexplode("lines").alias("line_index", "line"))
    upto = F.sum(F.octet_length("line")).over(Window.partitionBy("source_id").orderBy("line_index"))
    rows = rows.withColumn("end", upto.cast("long")).withColumn("start", F.col("end") - F.octet_length("line"))
    bare = F.octet_length(F.regexp_replace("line", r"(\r\n|\n|\r)$", ""))
    return rows.select("source_id", F.col("line_index").cast("long").alias("line_index"), "start", "end", (F.col("start") + bare).alias("content_end"))


def line_ends(data: bytes) -> list[int]:
    """Byte offsets just behind each line."""
    out, at, n = [], 0, len(data)
    lf, cr = data.find(b"\n"), data.find(b"\r")
    while at < n:
        if lf < 0 and cr < 0:
            out.append(n)
            break
        if cr >= 0 and (lf < 0 or cr < lf):
            at = cr + (2 if data[cr + 1 : cr + 2] == b"\n" else 1)
        else:
            at = lf + 1
        out.append(at)
        if 0 <= lf < at:
            lf = data.find(b"\n", at)
        if 0 <= cr < at:
            cr = data.find(b"\r", at)
    return out


class UnitTooLarge(ValueError):
    pass


def _line_facts(ends: list[int], s: int, e: int) -> tuple[int, int, bool, bool]:
    """First line, line after, and whether a unit starts and ends at a line, from the offsets behind each line."""
    first, last = bisect.bisect_right(ends, s), bisect.bisect_left(ends, e)
    return first, last + 1, s == 0 or first > 0 and ends[first - 1] == s, ends[last] == e


def units(data: bytes, preferred: int, hard: int) -> list[tuple]:
    """Contiguous units covering data: (start, end, first line, line after, starts at a line, ends at a line)."""
    ends, out, s, n = line_ends(data), [], 0, len(data)
    inside = lambda p: 0 < p < n and data[p] & 0xC0 == 0x80
    while s < n:
        want, most = min(s + preferred, n), min(s + hard, n)
        k = bisect.bisect_right(ends, want) - 1
        if n - s <= preferred:
            e = n
        elif k >= 0 and ends[k] > s:
            e = ends[k]
        elif ends[k + 1] <= most:
            e = ends[k + 1]
        else:
            e = want
            while inside(e):
                e -= 1
            if e <= s:
                e = s + 1
                while inside(e):
                    e += 1
            if e > most:
                raise UnitTooLarge
        out.append((s, e, *_line_facts(ends, s, e)))
        s = e
    return out


def prepare(sources: DataFrame, preferred: int = PREFERRED_UNIT_BYTES, hard: int = MAX_UNIT_BYTES, max_lines: int = MAX_LINES, max_units: int = MAX_UNITS, max_input: int = MAX_SOURCE_BYTES) -> DataFrame:
    """sources with gap (null if ready) and units: an array of spans, null for a gap. Content checks come first
    and run in the JVM; the greedy layout is one Arrow pass over the texts that passed them."""
    names = sources.columns
    checked = sources.withColumn("gap", E.gap(F.col("content"), max_input))
    keys = ("start", "end", "line_start", "line_end", "starts_at_line_boundary", "ends_at_line_boundary")

    def layout(batches):
        for batch in batches:
            gaps, spans = batch.column("gap").to_pylist(), []
            for i, content in enumerate(batch.column("content")):
                if gaps[i] is not None or not content.is_valid:
                    spans.append(None)
                    continue
                data = content.as_buffer().to_pybytes()
                try:
                    found = units(data, preferred, hard)
                    if len(line_ends(data)) > max_lines:
                        gaps[i], found = "too_many_lines", None
                    elif len(found) > max_units:
                        gaps[i], found = "too_many_units", None
                except UnitTooLarge:
                    gaps[i], found = ("too_many_lines" if len(line_ends(data)) > max_lines else "unit_too_large"), None
                spans.append(found and [dict(zip(keys, u)) for u in found] if found is not None else None)
            kind = pa.list_(pa.struct([(k, pa.int64() if i < 4 else pa.bool_()) for i, k in enumerate(keys)]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(gaps, pa.string()), pa.array(spans, kind)], names=[*names, "gap", "units"])

    schema = T.StructType([*checked.schema.fields, *T.StructType.fromDDL(f"units array<{UNIT_STRUCT}>").fields])
    return checked.mapInArrow(layout, schema)


def unit_rows(prepared: DataFrame, *keep: str) -> DataFrame:
    """One row a unit: source_id, unit, its span, and its text as `content` bytes."""
    rows = prepared.filter("gap is null").select("source_id", *keep, "content", F.posexplode("units").alias("unit", "u"))
    body = F.expr("substring(content, cast(u.start as int) + 1, cast(u.end - u.start as int))")
    return rows.select("source_id", *keep, F.col("unit").cast("long").alias("unit"), "u.*", body.alias("body"))


def layout_fault(data: bytes, spans: list[dict], hard: int) -> str | None:
    """What is wrong with saved units of data, their coverage first; the preferred layout is not asked for."""
    at = 0
    for u in spans:
        if u["start"] != at or not at < u["end"] <= len(data):
            return "coverage"
        at = u["end"]
    if at != len(data):
        return "coverage"
    ends = line_ends(data)
    for u in spans:
        s, e = u["start"], u["end"]
        if e - s > hard:
            return "unit_size"
        if e < len(data) and data[e] & 0xC0 == 0x80:
            return "character"
        facts = _line_facts(ends, s, e)
        if (u["line_start"], u["line_end"]) != facts[:2]:
            return "line_range"
        if (u["starts_at_line_boundary"], u["ends_at_line_boundary"]) != facts[2:]:
            return "flags"
    return None


def inspected(artifacts: DataFrame, hard: int) -> DataFrame:
    """artifacts (with digest, bytes, content and units) with fault: null where bytes and saved units hold together."""
    bound = F.when(F.col("content").isNull(), "missing").when(F.octet_length("content") != F.col("bytes"), "size").when(E.digest(F.col("content")) != F.col("digest"), "digest")
    checked = artifacts.withColumn("fault", bound)

    def run(batches):
        for batch in batches:
            faults = batch.column("fault").to_pylist()
            contents, spans = batch.column("content"), batch.column("units")
            for i, found in enumerate(faults):
                if found is None:
                    faults[i] = layout_fault(contents[i].as_buffer().to_pybytes(), spans[i].as_py() or [], hard)
            yield batch.set_column(batch.schema.get_field_index("fault"), "fault", pa.array(faults, pa.string()))

    return checked.mapInArrow(run, checked.schema)


def accepted(artifacts: DataFrame, expected: DataFrame, hard: int) -> DataFrame:
    """inspected(), and bound to what is expected of them: source_id, digest, bytes."""
    wanted = expected.select("source_id", F.col("digest").alias("wanted_digest"), F.col("bytes").alias("wanted_bytes"))
    other = F.col("wanted_digest").isNull() | (F.col("wanted_digest") != F.col("digest")) | (F.col("wanted_bytes") != F.col("bytes"))
    held = inspected(artifacts, hard).join(wanted, "source_id", "left")
    return held.withColumn("fault", F.when(other, "binding").otherwise(F.col("fault"))).drop("wanted_digest", "wanted_bytes")
