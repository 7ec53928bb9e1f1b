"""Word shingles of a text as 64-bit hashes, computed on its UTF-8 bytes with numpy.

Hashes are the same in every process and on every machine.
"""

from __future__ import annotations

import numpy as np

from closebook.llm.common import worker_cache

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
CHUNK = 1 << 20

def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    held = worker_cache("powers")
    if len(held.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            held[name] = np.multiply.accumulate(steps)
    return held["up"][:n], held["down"][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _chunk_words(b: np.ndarray) -> np.ndarray:
    """Hashes of the words of a piece that begins and ends between words."""
    b = b + ((b >= 65) & (b <= 90)).astype(np.uint8) * np.uint8(32)
    inside = np.empty(len(b) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:len(b)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` of a text, A-Z as a-z."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    parts, at = [], 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        while end < len(data) and not (data[end] == 32 or 9 <= data[end] <= 13):
            end += 1
        parts.append(_chunk_words(data[at:end]))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the `size`-word shingles; of all words if there are fewer."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    k = min(size, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = mix64(out * np.uint64(_BASE) + words[j:j + n])
    return np.unique(out)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))
