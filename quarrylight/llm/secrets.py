"""Secret scan with structural confirmation.

Three base rules give spans that always stay. Beyond them, long base64, base64url and hexadecimal runs are
candidates: each is decoded and reported only if its bytes have the structure of a credential, which a
random run has with negligible probability:
- `jwt`: three dot-separated base64url parts, the first a JSON object with `alg`, the second a JSON object;
- `key`: DER of a private or public key whose nested lengths fill the bytes exactly, parsed to the last level:
  PKCS#1 (RSA) and the older DSA form by their integers, SEC1 by its version, scalar, curve and point, PKCS#8
  and public keys by their algorithm, whose key inside must be one of its kind, and encrypted PKCS#8;
- `ssh`: an openssh-key-v1 container parsed to its private section, which must end the bytes (and, where it is not
  encrypted, start with two equal check numbers and a key type), or a public key blob with the fields of its type;
- `pem`: an armoured private key block whose body decodes to one of these (or is encrypted); line breaks,
  slashes and characters of the body may be escaped as in JSON.

A run may stand directly after `=` or another sign. It is tried from its start and from behind each of its
`/`, `-` and `_`, and runs that a line break (or an escaped one) and indentation alone separate are joined: the
lengths inside a key tell at which line's end it ends. The first bytes are decoded first, so that other starts
cost nothing more.

Nulls: a null text is taken as empty. Whole texts are scanned, in linear time. Repeated rows are returned as
often as they came; extra columns are not read; an empty table gives an empty result. Spans are code points.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import bounded

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "jwt", "key", "ssh", "pem")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_BREAK = r"[\x20\t]*+(?:\r\n?|\n|(?:\\+r)?\\+n|\\+r)[\x20\t]*+"
_GROUP = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{32,}}+(?:{_BREAK}[A-Za-z0-9+/_-]++)*+={{0,2}}")
_FIRST = re.compile(rf"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{{2,31}}){_BREAK}\Z")
_PIECE = re.compile(rf"([A-Za-z0-9+/_-]++)(={{0,2}})(?:{_BREAK})?+")
_STARTS = re.compile(r"(?:\A|(?<=[/_-]))(?=M[A-P]|AAAA|b3Bl|30|0000|6[fF]70)")
_HEX_ONLY = re.compile(r"[0-9a-fA-F]*\Z")
_HEXRUN = re.compile(r"(?:[0-9a-fA-F]{2}){24,}\Z")
_PART = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{12,}+)(?=(\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+))")
_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----")
_BODY = re.compile(r"(?:[A-Za-z0-9+/=\s:,-]|\\+(?:[nrt/]|u00[0-9a-fA-F]{2}))*+\Z")
_ESCAPED = re.compile(r"\\+(?:u00([0-9a-fA-F]{2})|([nrt/]))")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    small = text.lower()
    if any(w in small for w in _WORDS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def _element(data: bytes, at: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the DER element at `at`; None if its length isn't well formed."""
    if at + 2 > len(data):
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > len(data):
            return None
        n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= len(data) else None


def _elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while at < end:
        e = _element(data, at)
        if e is None or e[2] > end:
            return None
        out.append(e)
        at = e[2]
    return out


#: Object identifiers of algorithms by the kind of key inside.
_OIDS = {
    "1.2.840.113549.1.1.1": "rsa", "1.2.840.113549.1.1.10": "rsa", "1.2.840.10045.2.1": "ec", "1.2.840.10040.4.1": "integer", "1.2.840.113549.1.3.1": "integer",
    "1.3.101.110": "edwards", "1.3.101.111": "edwards", "1.3.101.112": "edwards", "1.3.101.113": "edwards",
}
_ENCRYPTIONS = ("1.2.840.113549.1.5.", "1.2.840.113549.1.12.1.")


def _oid(data: bytes) -> str | None:
    """The dotted form of an object identifier's bytes; None if they aren't well formed."""
    if not data or data[-1] & 0x80:
        return None
    numbers, n, fresh = [], 0, True
    for b in data:
        if fresh and b == 0x80:
            return None
        n, fresh = n << 7 | b & 0x7F, not b & 0x80
        if fresh:
            numbers.append(n)
            n = 0
    first = min(numbers[0] // 40, 2)
    return ".".join(map(str, [first, numbers[0] - 40 * first, *numbers[1:]]))


def _sequence(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of the elements of a DER sequence that fills data exactly."""
    top = _element(data, 0)
    if not top or top[0] != 0x30 or top[2] != len(data):
        return None
    parts = _elements(data, top[1], top[2])
    return None if parts is None else [(t, data[a:b]) for t, a, b in parts]


def _positive(part: tuple[int, bytes], least: int = 1) -> bool:
    """A minimal positive integer of at least so many bytes."""
    tag, x = part
    return tag == 2 and len(x) >= least and x[0] < 0x80 and (len(x) == 1 or x[0] > 0 or x[1] >= 0x80) and any(x)


def _version(part: tuple[int, bytes], *values: int) -> bool:
    return part[0] == 2 and len(part[1]) == 1 and part[1][0] in values


def _algorithm(part: tuple[int, bytes]) -> tuple[str, tuple[int, bytes] | None] | None:
    """Identifier and parameters of an algorithm."""
    if part[0] != 0x30 or (inner := _elements(part[1], 0, len(part[1]))) is None or not 1 <= len(inner) <= 2 or inner[0][0] != 6:
        return None
    name = _oid(part[1][inner[0][1] : inner[0][2]])
    return None if name is None else (name, (inner[1][0], part[1][inner[1][1] : inner[1][2]]) if len(inner) == 2 else None)


def _is_point(x: bytes) -> bool:
    """A point on a curve: compressed, or both coordinates."""
    return len(x) >= 21 and (x[0] in (2, 3) or x[0] == 4 and len(x) % 2 == 1)


def _is_rsa(data: bytes) -> bool:
    parts = _sequence(data) or []
    return len(parts) >= 9 and _version(parts[0], 0, 1) and _positive(parts[1], 64) and all(map(_positive, parts[2:9])) and (len(parts) == 9 or len(parts) == 10 and parts[9][0] == 0x30)


def _is_rsa_public(data: bytes) -> bool:
    parts = _sequence(data) or []
    return len(parts) == 2 and _positive(parts[0], 64) and _positive(parts[1]) and len(parts[1][1]) <= len(parts[0][1])


def _is_sec1(data: bytes) -> bool:
    parts = _sequence(data) or []
    if len(parts) < 2 or not _version(parts[0], 1) or parts[1][0] != 4 or not 16 <= len(parts[1][1]) <= 72:
        return False
    for tag, x in parts[2:]:
        inner = _element(x, 0)
        if not inner or inner[2] != len(x):
            return False
        body = x[inner[1] :]
        if not (tag == 0xA0 and (inner[0] == 6 and _oid(body) or inner[0] == 0x30) or tag == 0xA1 and inner[0] == 3 and body[:1] == b"\0" and _is_point(body[1:])):
            return False
    return [t for t, _ in parts[2:]] in ([], [0xA0], [0xA1], [0xA0, 0xA1])


def _is_pkcs8(data: bytes) -> bool:
    parts = _sequence(data) or []
    if len(parts) < 3 or not _version(parts[0], 0, 1) or parts[2][0] != 4 or any(t not in (0xA0, 0x81, 0xA1) for t, _ in parts[3:]):
        return False
    name, key = _algorithm(parts[1]), parts[2][1]
    if name is None:
        return False
    kind, whole = _OIDS.get(name[0]), _element(key, 0)
    if not whole or whole[2] != len(key):
        return False
    if kind == "rsa":
        return _is_rsa(key)
    if kind == "ec":
        return _is_sec1(key) and name[1] is not None and (name[1][0] == 6 and _oid(name[1][1]) is not None or name[1][0] == 0x30)
    if kind == "edwards":
        return whole[0] == 4 and whole[2] - whole[1] in (32, 56, 57)
    if kind == "integer":
        return _positive((whole[0], key[whole[1] :]), 16)
    return whole[0] in (2, 4) or _sequence(key) is not None  # another algorithm: a well-formed element that fills the key


def _is_encrypted(data: bytes) -> bool:
    parts = _sequence(data) or []
    name = _algorithm(parts[0]) if len(parts) == 2 and parts[1][0] == 4 else None
    return name is not None and name[0].startswith(_ENCRYPTIONS) and name[1] is not None and name[1][0] == 0x30 and len(parts[1][1]) >= 16


def _is_public(data: bytes) -> bool:
    parts = _sequence(data) or []
    if len(parts) != 2 or parts[1][0] != 3 or parts[1][1][:1] != b"\0":
        return False
    name, key = _algorithm(parts[0]), parts[1][1][1:]
    kind = name and _OIDS.get(name[0])
    if kind == "rsa":
        return _is_rsa_public(key)
    if kind == "ec":
        return _is_point(key)
    if kind == "edwards":
        return len(key) in (32, 56, 57)
    return bool(kind) and (e := _element(key, 0)) is not None and e[2] == len(key) and _positive((e[0], key[e[1] :]), 16)


def _is_dsa(data: bytes) -> bool:
    parts = _sequence(data) or []
    return len(parts) == 6 and _version(parts[0], 0) and _positive(parts[1], 64) and all(map(_positive, parts[2:]))


def is_der_key(data: bytes) -> bool:
    return any(f(data) for f in (_is_rsa, _is_pkcs8, _is_sec1, _is_public, _is_rsa_public, _is_encrypted, _is_dsa))


def _fields(data: bytes, at: int = 0, count: int | None = None) -> tuple[list[bytes], int] | None:
    """Length-prefixed fields from `at` on, all or `count` of them, and the place behind the last."""
    out = []
    while len(out) != count and at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data) or at + 4 > len(data):
            return None
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return None if count is not None and len(out) < count else (out, at)


#: Types of public key blobs and the number of their fields, the type included.
_SSH_FIELDS = {
    b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2, b"ssh-ed448": 2, b"ecdsa-sha2-nistp256": 3, b"ecdsa-sha2-nistp384": 3, b"ecdsa-sha2-nistp521": 3,
    b"sk-ssh-ed25519@openssh.com": 3, b"sk-ecdsa-sha2-nistp256@openssh.com": 4,
}


def _is_ssh_public(data: bytes) -> bool:
    found = _fields(data)
    if not found or not found[0] or _SSH_FIELDS.get(found[0][0]) != len(found[0]):
        return False
    kind, *rest = found[0]
    number = lambda x: _positive((2, x))
    if kind == b"ssh-rsa":
        return number(rest[0]) and _positive((2, rest[1]), 64)
    if kind == b"ssh-dss":
        return all(map(number, rest))
    if b"ed25519" in kind or b"ed448" in kind:
        return len(rest[0]) == (57 if b"ed448" in kind else 32)
    return kind.split(b"@")[0].endswith(b"ecdsa-sha2-" + rest[0]) and _is_point(rest[1])


def is_ssh_key(data: bytes) -> bool:
    if not data.startswith(b"openssh-key-v1\0"):
        return _is_ssh_public(data)
    head = _fields(data, 15, 3)  # cipher, key derivation and its options
    if not head or head[1] + 4 > len(data):
        return False
    (cipher, derivation, _), at = head
    rest = _fields(data, at + 4, 2) if data[at : at + 4] == b"\0\0\0\1" and cipher and derivation else None  # containers hold one key
    if not rest or rest[1] != len(data) or not _is_ssh_public(rest[0][0]):
        return False
    private = rest[0][1]
    if cipher != b"none":
        return len(private) >= 16
    kind = _fields(private, 8, 1)
    return private[:4] == private[4:8] and kind is not None and kind[0][0] in _SSH_FIELDS


def _decoded(run: str) -> bytes | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _json(part: str) -> dict | None:
    data = _decoded(part)
    try:
        value = json.loads(data) if data else None
    except (ValueError, UnicodeDecodeError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _der_size(head: bytes) -> int:
    """Bytes of the DER sequence that starts so; 0 if none does."""
    if len(head) < 6 or head[0] != 0x30:
        return 0
    if head[1] < 0x80:
        return 2 + head[1]
    k = head[1] & 0x7F
    return 2 + k + int.from_bytes(head[2 : 2 + k], "big") if 1 <= k <= 4 else 0


def _ssh_size(read) -> int:
    """Bytes of the container or public key blob that starts at byte 0 of read(offset, length); 0 if none does."""
    number = lambda o: int.from_bytes(x, "big") if len(x := read(o, 4)) == 4 else -1
    if read(0, 15) == b"openssh-key-v1\0":
        at, fields = 15, (0, 0, 0, None, 0, 0)
    else:
        n = number(0)
        count = _SSH_FIELDS.get(read(4, n)) if 0 < n <= 64 else None
        if not count:
            return 0
        at, fields = 0, (0,) * count
    for f in fields:
        if f is None:  # the number of keys
            at += 4
            continue
        if (n := number(at)) < 0:
            return 0
        at += 4 + n
    return at


def _key_at(body: str, at: int, ends: list[int]) -> tuple[int, str] | None:
    """End and kind of the key that starts at `at` of the joined runs and ends at one of the runs' ends. Its size follows
    from a few lengths inside, so that it is decoded once, and only if a run ends there."""

    def of_base64(o: int, n: int) -> bytes:
        chars = body[at + 4 * (o // 3) : at + 4 * -(-(o + n) // 3)]
        return (_decoded(chars[: len(chars) - (len(chars) % 4 == 1)]) or b"")[o % 3 : o % 3 + n]

    def of_hex(o: int, n: int) -> bytes:
        chars = body[at + 2 * o : at + 2 * (o + n)]
        return bytes.fromhex(chars) if len(chars) % 2 == 0 and _HEX_ONLY.match(chars) else b""

    ways = [(of_base64, lambda n: -(-4 * n // 3), _decoded)]
    if _HEXRUN.match(body[at : at + 48]):
        ways.append((of_hex, lambda n: 2 * n, lambda x: bytes.fromhex(x) if _HEXRUN.match(x) else None))
    for read, chars, decode in ways:
        for size, fits, kind in ((_der_size(read(0, 18)), is_der_key, "key"), (_ssh_size(read), is_ssh_key, "ssh")):
            end = at + chars(size)
            k = bisect.bisect_left(ends, end)
            if end - at >= 32 and k < len(ends) and ends[k] == end and (data := decode(body[at:end])) and fits(data):
                return end, kind
    return None


def _key_spans(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """Keys in text[start:end], runs with nothing but line breaks between them."""
    out, starts, ends, places, pads, size = [], [], [], [], [], 0
    for m in _PIECE.finditer(text, start, end):
        a, run = m.start(1), m[1]
        starts += [size + x.start() for x in _STARTS.finditer(run)]
        if not places and a and text[a - 1] == "\\" and run[0] in "nrt":  # the letter belongs to an escape
            starts += [size + 1] * bool(_STARTS.match(run[1:]))
        places.append((size, a, run))
        size += len(run)
        ends.append(size)
        pads.append(m.end(2) - m.end(1))
    if not starts:
        return out
    body, free, firsts = "".join(p[2] for p in places), 0, [p[0] for p in places]
    for at in sorted(set(starts)):
        if at < free or not (found := _key_at(body, at, ends)):
            continue
        free, kind = found
        k, e = bisect.bisect_right(firsts, at) - 1, bisect.bisect_left(ends, free)
        out.append((places[k][1] + at - places[k][0], places[e][1] + len(places[e][2]) + pads[e], kind))
    return out


def _token_spans(text: str) -> list[tuple[int, int, str]]:
    """Signed tokens, decided by their decoded header; the header may follow a leading `-` or `_`."""
    out, free = [], 0
    for m in _PART.finditer(text):
        claims = None
        for k in (0, *(x.end() for x in re.finditer("[-_]", m[1]))):
            if m.start() + k < free or (_decoded(m[1][k : k + 16]) or b" ").lstrip(b" \t\r\n")[:1] not in (b"{", b""):
                continue
            if "alg" not in (_json(m[1][k:]) or {}):
                continue
            claims = _json(m[2].split(".")[1]) if claims is None else claims
            if claims is not None:
                free = m.end(2)
                out.append((m.start() + k, free, "jwt"))
            break
    return out


def _blocks(text: str):
    """Armoured private keys: label, start, end and body without escapes and white space."""
    for m in _BEGIN.finditer(text):
        stop, tail = text.find("-----", m.end()), f"-----END {m[1]}-----"
        if stop >= 0 and text.startswith(tail, stop) and _BODY.match(raw := text[m.end() : stop]):
            body = _ESCAPED.sub(lambda x: chr(int(x[1], 16)) if x[1] else x[2] if x[2] == "/" else "\n", raw)
            yield m[1], m.start(), stop + len(tail), re.sub(r"\s", "", body)


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    out, blocks = [], []
    if "PRIVATE KEY-----" in text:
        for label, a, b, body in _blocks(text):
            data = _decoded(body)
            if "ENCRYPTED" in label or "ENCRYPTED" in body or data and (is_der_key(data) or is_ssh_key(data)):
                out.append((a, b, "pem"))
                blocks.append((a, b))
    out += _token_spans(text)
    for m in _GROUP.finditer(text):
        start = m.start()
        if first := _FIRST.search(text, max(0, start - 80), start):
            start = first.start(1)
        out += [s for s in _key_spans(text, start, m.end()) if not any(a <= s[0] < b for a, b in blocks)]
    return out


def joined(spans, kinds=KINDS) -> str:
    order = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], order[s[2]], s[1])))


def _scanned(batches):
    for batch in batches:
        counts, digests, spans = [], [], []
        for t in batch.column("text").to_pylist():
            base = base_spans(t or "")
            counts.append([sum(k == kind for _, _, k in base) for kind in BASE])
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined([*base, *confirmed_spans(t or "")]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(3)), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, base_sha256 and all spans of every row of docs (doc_id, text)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bounded(source).mapInArrow(_scanned, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
