"""64-bit fingerprints of words, word windows and lines over raw UTF-8 bytes.

A word's fingerprint is the XXH3 hash of its bytes; a window's is a mix of its words' fingerprints in order.
Two given words or windows share one with a probability of 2**-64. What must hold over a whole corpus, such as
which texts are equal, is decided by digests of 128 bits instead.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash

U = np.uint64
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Words are hashed in pieces of so many bytes, so that no text needs lists many times its own size.
PIECE = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with full avalanche."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pieces(data: bytes):
    """data in pieces of about PIECE bytes, cut at white space only; a giant word stays whole."""
    at = 0
    while len(data) - at > PIECE and (cut := _SPACE.search(data, at + PIECE)):
        yield data[at : cut.start()]
        at = cut.start()
    yield data[at:] if at else data


def words(data: bytes) -> np.ndarray:
    """Fingerprints of the words of `data`; a word is a maximal run without ASCII white space."""
    found = [np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, piece.split())), dtype=U) for piece in pieces(data)]
    return found[0] if len(found) == 1 else np.concatenate(found)


def text_digest(data: bytes) -> bytes:
    """128 bits of the word sequence: equal for texts that differ in white space alone."""
    h = hashlib.blake2b(digest_size=16)
    first = True
    for piece in pieces(data):
        if part := b" ".join(piece.split()):
            h.update(part if first else b" " + part)
            first = False
    return h.digest()


_ORDER = [U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3), U(0x1D8E4E27C47D124F)]


def windows(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Fingerprints of all windows of `width` words, in order; none if there are fewer words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=U)
    total = np.zeros(n, dtype=U)
    for k in range(width):
        total = mix(total + hashes[k : k + n] * _ORDER[k % len(_ORDER)])
    return total


def sequence(hashes: np.ndarray) -> int:
    """Fingerprint of a whole short word sequence; its length takes part."""
    total = mix(np.array([len(hashes)], dtype=U) * U(0xC2B2AE3D27D4EB4F))
    for k in range(len(hashes)):
        total = mix(total + hashes[k : k + 1] * _ORDER[1])
    return int(total[0])
