"""Personal data by a semi-Markov conditional random field over candidate islands.

Four base rules give spans that always stay. The model adds to them. An island is a stretch of chunks (runs
without white space) that hold a digit or an `@`, each next to the other, however many; everything else is
outside by construction. A segment is one to SPAN chunks of an island, trimmed of punctuation at its ends, and
may be of a type only if the whole span has its structure: an email has an `@`, an address parses, a card has 12
to 19 digits with a good Luhn sum, a phone number 7 to 15 digits and no letters. Features look at the whole
segment, however long: digits, group lengths, separators, leading digits, dates and thousands it could be, the
word before it. The bounded-entity dynamic programme chooses boundaries and types of all segments of an island at
once: alpha[j] over segments of at most SPAN chunks ending at j, with scores of neighbouring types. Weights
maximise the conditional likelihood (forward-backward over segmentations) of a labelled set that make_examples()
writes by rule from a seed; its size, EXAMPLES, is the bound of the training sample. They are a few thousand
numbers and travel with the task. Segments are scored as the programme reaches them, so a text costs one linear
scan.

A model span is added if it is an entity and does not overlap a base span; of segmentations that score alike the
one whose last segment is the longest stands. Nulls: a null text is empty. Repeated rows are returned as often as
they came; extra columns are not read by scan() and kept by redact(); an empty table gives an empty result. Spans
are code points, end exclusive.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import ipaddress
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import bounded

KINDS = ("email", "ip", "card", "phone")
TYPES = ("O", *KINDS)
SPAN, EXAMPLES, EPOCHS, SEED = 5, 700, 60, 17
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]\S*")
_TRIM = "\"'`.,;:!?*#$%&|<>=[]{}/\\"
#: An @ between a name and a domain with a dot, of any letters; what a phone number may hold.
_MAIL = re.compile(r"[\w.%+'-]+@[\w-]+(?:\.[\w-]+)+\Z")
_DIAL = re.compile(r"[0-9+(][0-9\s()./+-]+\Z")
#: What an address may hold; a port, a prefix length or a zone may follow.
_ADDRESS = re.compile(r"([0-9]+(?:\.[0-9]+){3}|[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*)(?:[:/%][A-Za-z0-9]+)?\Z")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int, str]]:
    """Leftmost matches: before each @ the whole run of local characters, after it a domain."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))
    return out


def _ips(text: str) -> list[tuple[int, int, str]]:
    """Leftmost matches of four dotted numbers; those with a part over 255 are passed over, not retried."""
    out = []
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            end = at + sum(map(len, parts[k : k + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[k : k + 4]):
                out.append((at, end, "ip"))
            at = end + 1
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = _emails(text) if "@" in text else []
    out += _ips(text)
    for m in _CARD.finditer(text):
        d = _digits(m[0]) if m.end() - m.start() <= 37 else ""
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def joined(spans) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], order[s[2]], s[1])))


def islands(text: str) -> list[list[tuple[int, int]]]:
    """Neighbouring chunks with a digit or an @, as (start, end); at most one character between two of them."""
    out: list[list[tuple[int, int]]] = []
    free = 0
    for m in _MARK.finditer(text):
        start = m.start()
        while start > free and not text[start - 1].isspace():  # the chunk's part before its first mark
            start -= 1
        free = m.end()
        if out and start - out[-1][-1][1] <= 1:
            out[-1].append((start, free))
        else:
            out.append([(start, free)])
    return out


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in _TRIM:
        start += 1
    while end > start and text[end - 1] in _TRIM:
        end -= 1
    return start, end


def is_address(s: str) -> bool:
    m = _ADDRESS.match(s) if len(s) <= 64 else None  # the longest has 45 characters, a zone or port behind it fewer than the rest
    try:
        return bool(m) and bool(ipaddress.ip_address(m[1]))
    except ValueError:
        return False


class Segments:
    """The candidate segments of one island of a text."""

    def __init__(self, text: str, island: list[tuple[int, int]]):
        self.text, self.island = text, island
        self._before: dict[int, str] = {}
        self._known = [island[0][0]] if island else []
        self.digits, self.letters = [0], [0]
        for a, b in island:
            chunk = text[a:b]
            self.digits.append(self.digits[-1] + sum("0" <= c <= "9" for c in chunk))
            self.letters.append(self.letters[-1] + sum(c.isalpha() for c in chunk))

    def kinds(self, i: int, j: int) -> tuple[int, ...]:
        """The types that the chunks i to j may be as a whole, but for O."""
        digits, letters = self.digits[j] - self.digits[i], self.letters[j] - self.letters[i]
        single = j - i == 1
        if not single and (letters or not 7 <= digits <= 19):
            return ()
        start, end = self.span(i, j)
        s, out = self.text[start:end], []
        if "@" in s:
            return (1,) if single and _MAIL.match(s) else ()
        if single and is_address(s):
            out.append(2)
        if not letters and 12 <= digits <= 19 and luhn(_digits(s)):
            out.append(3)
        if not letters and 7 <= digits <= 15 and _DIAL.match(s):
            out.append(4)
        return tuple(out)

    def span(self, i: int, j: int) -> tuple[int, int]:
        return trimmed(self.text, self.island[i][0], self.island[j - 1][1])

    def before(self, start: int) -> str:
        """The last word before a place, lower-cased, wherever it ends; looks no further back than the last place asked for."""
        if start in self._before:
            return self._before[start]
        k = bisect.bisect_left(self._known, start)
        near = self._known[k - 1] if k and self._known[k - 1] in self._before else -1
        at, text = start, self.text
        while at > max(near, 0) and not (text[at - 1].isalnum() or text[at - 1] == "_"):
            at -= 1
        if at == near:
            word = self._before[near]
        else:
            end = at
            while at > 0 and end - at < 32 and (text[at - 1].isalnum() or text[at - 1] == "_"):
                at -= 1
            word = text[at:end].lower() if end - at < 32 else "very long"
        bisect.insort(self._known, start)
        self._before[start] = word
        return word

    def features(self, i: int, j: int) -> list[str]:
        start, end = self.span(i, j)
        s = self.text[start:end]
        d, letters = self.digits[j] - self.digits[i], self.letters[j] - self.letters[i]
        groups = re.findall(r"[0-9]+", s)
        lens = "-".join(str(len(g)) for g in groups)
        out = ["bias", f"n={j - i}", f"digits={min(d, 20)}", f"groups={min(len(groups), 8)}", f"before={self.before(start)}"]
        if letters:
            out.append("letters" if letters < len(s) - 1 else "words")
        else:
            seps = re.findall(r"[^0-9]+", s)
            kinds = "".join(sorted(set("".join(seps))))
            out += [f"lens={lens[:24]}", f"separators={kinds[:8]}", f"lens={lens[:24]} {kinds[:8]}", "mixed" if len(kinds) > 1 else "uniform"]
            out.append("plus" if s[:1] == "+" else "area code" if s[:1] == "(" and ")" in s else f"lead={'00' if s[:2] == '00' else '0' if s[:1] == '0' else '1' if s[:1] == '1' else 'other'}")
            out.append(f"lead and digits={s[:1] == '0'}{d}")
            if any(len(g) == 4 and "1900" <= g < "2100" for g in groups) and len(groups) <= 3:
                out.append("year")
            if len(groups) > 1 and len(groups[0]) <= 3 and all(len(g) == 3 for g in groups[1:]) and s[:1] != "0":
                out.append("thousands")
            if len(groups) > 2 and all(len(g) <= 2 for g in groups):
                out.append("pairs" if s[:1] == "0" and all(len(g) == 2 for g in groups) else "small numbers")
            if d == 13 and s[:3] in ("978", "979"):
                out.append("book number")
            if 12 <= d <= 19:
                out.append("card groups" if lens in (str(d), "-".join(["4"] * (d // 4)), "4-6-5") else "other groups")
        if "@" in s:
            out.append("plain domain" if _DOMAIN.fullmatch(s.rpartition("@")[2]) else "other domain")
        if len(groups) == 4 and s.count(".") == 3 and not letters:
            out.append("four dotted")
        if s.count(":") > 1:
            out.append("colons")
        return out


class SemiMarkov:
    """Weights of (feature, type) and of neighbouring types."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.w = np.zeros((0, len(TYPES)))
        self.next = np.zeros((len(TYPES), len(TYPES)))

    def _rows(self, fs: list[str]) -> list[int]:
        return [self.index[f] for f in fs if f in self.index]

    def score(self, segs: Segments, i: int, j: int, fs: list[str] | None = None) -> list[float] | None:
        """Of the chunks i to j by type; None if they can't be a segment. Outside goes chunk by chunk, and a chunk that
        can be nothing else has the score 0."""
        kinds = segs.kinds(i, j)
        if not kinds:
            return [0.0] + [-np.inf] * len(KINDS) if j - i == 1 else None
        s = self.w[self._rows(segs.features(i, j) if fs is None else fs)].sum(axis=0).tolist()
        return [x if (t in kinds if t else j - i == 1) else -np.inf for t, x in enumerate(s)]

    def scores(self, segs: Segments) -> dict[tuple[int, int], list[float]]:
        n = len(segs.island)
        every = {(i, j): self.score(segs, i, j) for i in range(n) for j in range(i + 1, min(n, i + SPAN) + 1)}
        return {k: v for k, v in every.items() if v is not None}

    def best(self, n: int, scores: dict) -> list[tuple[int, int, int]]:
        """The best segmentation as (first, end, type)."""
        return self.segmented(n, lambda i, j: scores.get((i, j)))

    def segmented(self, n: int, score) -> list[tuple[int, int, int]]:
        """best() by a function of (first, end); values of SPAN chunks are held, and two bytes a chunk and type."""
        k = len(TYPES)
        next_, none = self.next.tolist(), -np.inf
        enter: dict[int, tuple[list[float], list[int]]] = {0: ([0.0] * k, [0] * k)}
        lengths, before = bytearray((n + 1) * k), bytearray((n + 1) * k)
        value = [0.0] * k
        for j in range(1, n + 1):
            value = [none] * k
            for i in range(max(0, j - SPAN), j):
                if (s := score(i, j)) is None:
                    continue
                reach, came = enter[i]
                for t in range(k):
                    if s[t] > none and reach[t] + s[t] > value[t]:
                        value[t] = reach[t] + s[t]
                        lengths[j * k + t], before[j * k + t] = j - i, came[t]
            reach, came = [], []
            for t in range(k):
                u = max(range(k), key=lambda u: value[u] + next_[u][t])  # noqa: B023
                reach.append(value[u] + next_[u][t])
                came.append(u)
            enter[j] = reach, came
            enter.pop(j - SPAN, None)
        out, j, t = [], n, max(range(k), key=value.__getitem__)
        while j > 0:
            i = j - lengths[j * k + t]
            out.append((i, j, t))
            j, t = i, before[j * k + t]
        return out[::-1]

    def gradient(self, n: int, scores: dict, gold: list[tuple[int, int, int]]):
        """Expected minus observed uses: (segment, vector) pairs and the transition matrix; forward-backward."""
        k = len(TYPES)
        alpha = [np.full(k, -np.inf) for _ in range(n + 1)]
        beta = [np.full(k, -np.inf) for _ in range(n)] + [np.zeros(k)]
        scores = {key: np.array(s) for key, s in scores.items()}
        lse = lambda m, axis: np.logaddexp.reduce(m, axis=axis)
        enter = {0: np.zeros(k)}
        for j in range(1, n + 1):
            for i in range(max(0, j - SPAN), j):
                if (i, j) in scores:
                    alpha[j] = np.logaddexp(alpha[j], enter[i] + scores[i, j])
            enter[j] = lse(alpha[j][:, None] + self.next, 0)
        leave = {n: np.zeros(k)}
        for i in range(n - 1, -1, -1):
            for j in range(i + 1, min(n, i + SPAN) + 1):
                if (i, j) in scores:
                    beta[i] = np.logaddexp(beta[i], scores[i, j] + leave[j])
            leave[i] = lse(self.next + beta[i][None, :], 1)
        z = lse(alpha[n], 0)
        uses, moves = {}, np.zeros((k, k))
        for (i, j), s in scores.items():
            uses[i, j] = np.exp(enter[i] + s + leave[j] - z)
        for i in range(1, n):
            moves += np.exp(alpha[i][:, None] + self.next + beta[i][None, :] - z)
        for i, j, t in gold:
            uses[i, j][t] -= 1
        for (_, _, t), (_, _, u) in zip(gold, gold[1:]):
            moves[t, u] -= 1
        return uses, moves

    def fit(self, examples, epochs: int = EPOCHS, rate: float = 0.4, decay: float = 1e-3) -> "SemiMarkov":
        data = []
        for text, island, gold in examples:
            segs = Segments(text, island)
            fs = {}
            for i in range(len(island)):
                for j in range(i + 1, min(len(island), i + SPAN) + 1):
                    if segs.kinds(i, j):
                        fs[i, j] = segs.features(i, j)
                        for f in fs[i, j]:
                            self.index.setdefault(f, len(self.index))
            if fs:
                data.append((segs, fs, gold))
        self.w = np.zeros((len(self.index), len(TYPES)))
        square, square_next = np.full_like(self.w, 1e-6), np.full_like(self.next, 1e-6)
        for _ in range(epochs):
            g, g_next = decay * self.w * len(data), decay * self.next * len(data)
            for segs, fs, gold in data:
                n = len(segs.island)
                every = {(i, j): self.score(segs, i, j, fs.get((i, j))) for i in range(n) for j in range(i + 1, min(n, i + SPAN) + 1)}
                uses, moves = self.gradient(n, {k: v for k, v in every.items() if v is not None}, gold)
                for key, f in fs.items():
                    g[self._rows(f)] += uses[key]
                g_next += moves
            square += g * g
            square_next += g_next * g_next
            self.w -= rate * g / np.sqrt(square)
            self.next -= rate * g_next / np.sqrt(square_next)
        return self


def _card_number(r: random.Random) -> str:
    body = str(r.choice([4, 51, 55, 37, 60, 35])) + "".join(str(r.randrange(10)) for _ in range(20))
    body = body[: r.choice([15, 15, 15, 14])]
    return body + next(str(c) for c in range(10) if luhn(body + str(c)))


def make_examples(n: int = EXAMPLES, seed: int = SEED):
    """(text, island, gold segments) written by rule: personal data and other numbers between words."""
    r = random.Random(seed)
    some = lambda k: "".join(str(r.randrange(10)) for _ in range(k))
    lead = lambda k: str(r.randrange(1, 10)) + some(k - 1)
    word = lambda: "".join(r.choice("abcdefghilmnoprstuvw") for _ in range(r.randrange(2, 9)))
    cut = lambda s, *ns: [s[sum(ns[:i]) : sum(ns[: i + 1])] for i in range(len(ns))]

    def entity() -> tuple[str, str, str]:
        """Text, kind, and a word that may stand before it."""
        kind = r.choice(["email", "ip", "card", "phone", "phone", "phone"])
        if kind == "email":
            return r.choice([f"{word()}.{some(2)}@{word()}.com", f"{word()}{some(2)}@{word()}.{word()}.org", f"{word()}_{word()}@{word()}-{word()}.net", f"{word()}é.{word()}@{word()}.de", f"{word()}@{word()}ü.de"]), kind, r.choice(["mail", "email", "contact"])
        if kind == "ip":
            octets = ".".join(str(r.randrange(256)) for _ in range(4))
            six = ":".join(f"{r.randrange(1 << 16):x}" for _ in range(8))
            return r.choice([octets, octets, f"{octets}:{lead(4)}", six, f"{lead(4)}:{r.randrange(4096):x}::{lead(1)}"]), kind, r.choice(["from", "host", "address"])
        if kind == "card":
            c = _card_number(r)
            return r.choice(["", "", " ", "-", ".", "/"]).join(c[i : i + 4] for i in range(0, len(c), 4)), kind, r.choice(["card", "visa", "pay"])
        a, b, c = lead(3), lead(3), some(4)
        nine, ten = some(9), some(10)
        sep = r.choice([" ", " ", ".", "-"])
        national = ["0" + x for x in (sep.join(cut(nine, 1, 2, 2, 2, 2)), sep.join(cut(nine, 2, 3, 4)), sep.join(cut(ten, 2, 4, 4)), sep.join(cut(ten, 3, 3, 4)), sep.join(cut(ten, 3, 7)), sep.join(cut(nine, 3, 6)))]
        abroad = [f"00{lead(2)}{sep}{x}" for x in (sep.join(cut(nine, 2, 7)), sep.join(cut(nine, 1, 2, 2, 2, 2)), sep.join(cut(nine, 3, 3, 3)), sep.join(cut(ten, 3, 7)))]
        american = [f"({a}) {b}-{c}", f"({a}) {b} {c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"{a} {b} {c}"]
        other = [f"+1 ({a}) {b}-{c}", f"+{lead(2)} {a} {b} {c}", f"+1-{a}-{b}-{c}", f"(0{some(2)}) {lead(4)} {some(4)}", f"(0{some(3)}) {lead(6)}"]
        return r.choice(r.choice([national, abroad, american, other])), kind, r.choice(["call", "tel", "phone", "fax", "mobile", "ring"])

    def other() -> tuple[str, str]:
        day, month, year = r.randrange(1, 29), r.randrange(1, 13), r.randrange(1900, 2100)
        bad = next(x for x in iter(lambda: lead(16), None) if not luhn(x))
        plain = [some(r.randrange(1, 9)), f"{some(1)}.{some(1)}.{some(2)}", f"{some(2)}:{some(2)}", f"{some(1)},{some(3)}", f"{some(3)}.{some(2)}", f"{word()}{some(2)}", f"v{some(1)}.{some(1)}", f"{some(2)}%", f"#{some(4)}", f"{some(1)}/{some(1)}", f"@{word()}", f"{word()}@", f"{some(12)}-{word()}"]
        dates = [f"{year}-{month:02}-{day:02}", f"{day}.{month}.{year}", f"{day:02}/{month:02}/{year}", f"{day:02}.{month:02}.{year}", f"{year}{month:02}{day:02}", f"{year}-{lead(4)}", f"{day:02}-{month:02}-{year}", f"{year}-{month:02}-{day:02} {some(2)}:{some(2)}"]
        numbers = [f"{lead(1)} {some(3)} {some(3)}", f"{lead(2)} {some(3)} {some(3)}", f"{lead(3)},{some(3)},{some(3)}", f"{lead(1)}.{some(3)}.{some(3)}", " ".join(lead(r.choice([1, 1, 2, 2])) for _ in range(r.randrange(4, 9))), f"{lead(4)} {lead(4)}", f"{lead(5)}-{lead(5)}", f"{lead(7)}", f"{lead(9)}", lead(r.choice([8, 10, 11, 20, 24])), f"{lead(4)}.{some(6)}", f"{some(1)}.{some(r.randrange(5, 12))}", f"0.{some(r.randrange(6, 12))}", " ".join(lead(3) for _ in range(r.randrange(3, 6)))]
        ids = [f"{some(3)}-{some(2)}-{some(4)}", f"978-{lead(1)}-{some(2)}-{some(6)}-{some(1)}", f"978{some(10)}", bad, " ".join(cut(bad, 4, 4, 4, 4)), "-".join(cut(bad, 4, 4, 4, 4)), f"{some(3)}.{some(3)}.{some(3)}.{300 + r.randrange(600)}", f"{lead(3)}.{lead(r.choice([2, 3]))}.{some(1)}.{300 + r.randrange(600)}", f"{lead(1)}.{lead(1)}.{lead(1)}.{lead(1)}.{lead(1)}.{lead(1)}.{lead(1)}", f"{some(5)}-{some(4)}", f"{lead(2)}-{some(7)}", "".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 64])))]
        return r.choice(r.choice([plain, dates, numbers, ids])), r.choice(["on", "no", "about", "order", "isbn", "id", "page", "of", "in"])

    out = []
    for _ in range(n):
        parts = [entity() if r.random() < 0.5 else (o := other())[:1] + ("O", o[1]) for _ in range(r.choice([1, 1, 1, 2, 3]))]
        text, marks = " ".join(word() for _ in range(r.randrange(3))), []
        text += " " * bool(text)
        for i, (s, kind, cue) in enumerate(parts):
            text += " " * bool(i) + (f"{cue} " if r.random() < (0.3 if i == 0 else 0.5) else "") + r.choice(["", "", "", '"', ">"])
            marks.append((len(text), len(text) + len(s), kind))
            text += s + r.choice(["", "", ",", ".", "***", '"'])
        text += " " + word()
        for island in islands(text):
            segs, gold, i = Segments(text, island), [], 0
            while i < len(island):
                for j in range(min(len(island), i + SPAN), i, -1):
                    span = segs.span(i, j)
                    kind = next((k for a, b, k in marks if (a, b) == span and k != "O"), None)
                    if kind and TYPES.index(kind) in segs.kinds(i, j):
                        break
                    kind = None
                gold.append((i, j if kind else i + 1, TYPES.index(kind or "O")))
                i = gold[-1][1]
            out.append((text, island, gold))
    return out


@functools.cache
def trained(n: int = EXAMPLES, epochs: int = EPOCHS, seed: int = SEED) -> SemiMarkov:
    return SemiMarkov().fit(make_examples(n, seed), epochs)


def model_spans(text: str, model: SemiMarkov) -> list[tuple[int, int, str]]:
    out = []
    for island in islands(text):
        segs = Segments(text, island)
        if len(island) == 1 and not segs.kinds(0, 1):
            continue
        for i, j, t in model.segmented(len(island), functools.partial(model.score, segs)):
            if t:
                out.append((*segs.span(i, j), TYPES[t]))
    return out


def all_spans(text: str, model: SemiMarkov) -> tuple[list, list]:
    """Base spans, and these with the model's spans that overlap none of them."""
    base = base_spans(text)
    starts, ends = [], []  # of the stretches that base spans cover
    for a, b, _ in sorted(base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    free = lambda a, b: (k := bisect.bisect_right(ends, a)) == len(ends) or b <= starts[k]
    return base, base + [s for s in model_spans(text, model) if free(s[0], s[1])]


def masked(text: str, spans) -> str:
    """Each stretch of overlapping spans replaced by its first span's kind in capitals, in square brackets."""
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _scanned(model: SemiMarkov):
    def run(batches):
        for batch in batches:
            counts, digests, spans = [], [], []
            for t in batch.column("text").to_pylist():
                base, every = all_spans(t or "", model)
                counts.append([sum(k == kind for _, _, k in base) for kind in KINDS])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(4)), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return run


def scan(docs: DataFrame, model: SemiMarkov | None = None) -> DataFrame:
    """doc_id, base counts, base_sha256 and all spans of every row of docs (doc_id, text)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bounded(source).mapInArrow(_scanned(model or trained()), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, model: SemiMarkov | None = None, column: str = "text") -> DataFrame:
    """docs with all spans of the column masked; null texts stay null and other columns as they are."""
    model, at = model or trained(), docs.columns.index(column)

    def run(batches):
        for batch in batches:
            texts = [t if t is None else masked(t, all_spans(t, model)[1]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return bounded(docs).mapInArrow(run, docs.schema)
