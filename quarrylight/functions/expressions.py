"""Column expressions shared by the operators; all run in the JVM."""

from __future__ import annotations

import re

import regex
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of letters, digits and underscores; then a lower-case letter before an upper-case one, and the last
#: capital of an acronym before a capitalised word.
RUN, CAMEL, ACRONYM = r"[\p{L}\p{N}_]+", r"(\p{Ll})(\p{Lu})", r"(\p{Lu})(\p{Lu}\p{Ll})"
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def ascii_lower(column):
    return F.translate(column, UPPER, LOWER)


def hex_lower(binary):
    return F.lower(F.hex(binary))


def latin1(binary):
    """One character for each byte, whatever the bytes."""
    return F.decode(binary, "ISO-8859-1")


def printable(binary):
    return F.regexp_replace(latin1(binary), r"[^ -~]", ".")


def digest(binary):
    return F.sha2(binary, 256)


def object_name(kind, hexdigest):
    return F.concat_ws("-", F.lit("v1"), kind, hexdigest)


def is_uuid(column):
    return column.rlike(UUID)


def point_id(generation: int, ordinal):
    """16 bytes as 32 hex digits: the generation, then the ordinal, both big-endian."""
    return F.lower(F.concat(F.lit(f"{generation:016x}"), F.lpad(F.hex(ordinal), 16, "0")))


def source_class(path):
    """vendor below a directory of that name, documentation by extension, else primary."""
    parent = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(parent.rlike(r"(?i)(^|/)vendor(/|$)"), "vendor").when(name.rlike(r"(?i).[.](md|markdown|rst|adoc)$"), "documentation").otherwise("primary")


def below(path, prefix: str):
    """The prefix itself or a path under it, by whole components."""
    root = prefix.rstrip("/")
    return (path == (root or "/")) | path.startswith(root + "/")


def literal_pattern(literal: str) -> str:
    return "".join(c if c.isalnum() or ord(c) > 127 else f"\\x{ord(c):02x}" for c in literal)


def occurrences(text, literal: str):
    """Number of overlapping occurrences."""
    return F.regexp_count(text, F.lit(f"(?={literal_pattern(literal)})"))


def is_binary(content):
    """Any NUL; or control characters other than TAB, LF, FF and CR, at least 4 and at least one in a hundred bytes."""
    controls = F.regexp_count(latin1(content), F.lit(r"[\x01-\x08\x0B\x0E-\x1F]"))
    return F.contains(content, F.lit(b"\0")) | (controls >= F.greatest(F.lit(4), F.ceil(F.length(content) / 100)))


def gap(content, max_bytes: int):
    """The first reason that content can't be prepared, null if there is none yet."""
    return F.when(F.length(content) > max_bytes, "input_too_large").when(is_binary(content), "binary_content").when(~F.is_valid_utf8(content.cast("string")), "invalid_utf8")


def lines(text):
    """Lines with their terminators; CRLF, LF and a lone CR each end one."""
    return F.regexp_extract_all(text, F.lit(r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+"), F.lit(0))


def tokens(text):
    """Lower-cased parts of identifiers, and after the parts of a compound one the identifier itself.

    The places where an identifier splits are marked in the whole text first, so that single words, nearly
    all of them, need no work of their own."""
    marked = F.regexp_replace(F.replace(text, F.lit("\x01"), F.lit(" ")), CAMEL, "$1\x01$2")
    marked = F.lower(F.regexp_replace(marked, ACRONYM, "$1\x01$2"))

    def compound(run):
        parts = F.filter(F.split(run, r"[_\x01]"), lambda p: p != "")
        return bound(parts, lambda p: F.when(F.size(p) > 1, F.concat(p, F.array(F.translate(run, "\x01", "")))).otherwise(p))

    simple = lambda r: ~(F.contains(r, F.lit("_")) | F.contains(r, F.lit("\x01")))
    runs = lambda m: F.regexp_extract_all(m, F.lit(r"([\p{L}\p{N}_\x01]+)"), F.lit(1))
    split = lambda m: F.flatten(F.transform(runs(m), lambda r: F.when(simple(r), F.array(r)).otherwise(compound(r))))
    return bound(marked, lambda m: F.when(simple(m), runs(m)).otherwise(split(m)))


def bound(value, use):
    """use(value) with the value computed once: inside higher-order functions nothing else shares work."""
    return F.element_at(F.transform(F.array(value), use), 1)


def line_of(content, start):
    """One-based line of a byte offset; LF alone counts."""
    before = latin1(F.substring(content, F.lit(1), start))
    return F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query, by the rules of tokens()."""
    out = []
    for run in regex.findall(RUN, query):
        split = regex.sub(ACRONYM, r"\1 \2", regex.sub(CAMEL, r"\1 \2", run))
        parts = [p for p in split.lower().replace("_", " ").split(" ") if p]
        out += parts + ([run.lower()] if len(parts) > 1 else [])
    return list(dict.fromkeys(out))


def excerpt_terms(query: str) -> list[str]:
    """At most 8 terms of 3 to 512 bytes, ASCII lower-cased, the longest first."""
    low = query.translate(str.maketrans(UPPER, LOWER))
    terms = {t for t in re.split(r"[^\w]+", low) if 3 <= len(t.encode()) <= 512}
    return sorted(terms, key=lambda t: (-len(t.encode()), t))[:8]
