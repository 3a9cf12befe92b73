"""Word n-gram hashes of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: The constants of the hash functions come from one seeded generator; all workers get the same.
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(int(_rng.integers(0, 2**62)) * 2 + 1)
_STEP = _rng.integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_power = np.cumprod(np.full(64, _BASE, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ascii_words(text: str | None) -> list[bytes]:
    """A-Z in lower case, then the runs of bytes other than ASCII white space."""
    return text.encode().lower().split() if text else []


def word_hashes(texts: Iterable[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' words, and where each text's begin (one more at the end)."""
    global _power
    texts = list(texts)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    if not starts[-1]:
        return np.zeros(0, np.uint64), starts
    words = [w for t in texts for w in t]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8)
    if (longest := int(lengths.max())) > len(_power):
        _power = np.cumprod(np.full(2 * longest, _BASE, np.uint64))
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(data)) - np.repeat(first, lengths)
    return mix(np.add.reduceat(_BYTE[data] * _power[place], first)), starts


def grams(words: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all n-grams of each text's words, and where each text's begin."""
    counts = np.maximum(np.diff(starts) - (n - 1), 0)
    out = np.concatenate([[0], np.cumsum(counts)])
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    at = np.arange(out[-1]) + np.repeat(starts[:-1] - out[:-1], counts)
    total = np.full(len(at), n, np.uint64)
    for k in range(n):
        total += words[at + k] * _STEP[k]
    return mix(total), out


def shingles(texts: list[list[bytes]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram hashes of each text; a text of fewer words, if any, has its whole sequence as one."""
    words, starts = word_hashes(texts)
    count = np.diff(starts)
    if not len(words) or not np.any(short := (count < n) & (count > 0)):
        return grams(words, starts, n)
    each = [grams(words, starts, n)] + [grams(words, starts, k) for k in range(1, n)]
    parts = [each[c if 0 < c < n else 0] for c in count]
    pieces = [h[s[k] : s[k + 1]] for k, (h, s) in enumerate(parts)]
    return np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
