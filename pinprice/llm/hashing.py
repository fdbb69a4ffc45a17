"""Vectorised word hashes over the UTF-8 bytes of many texts at once.

A word's hash is a polynomial in a fixed odd multiplier over a random value per
byte, modulo 2**64, taken from one running sum over the bytes, so that a batch
costs a handful of numpy passes. The same word has the same hash in every
process. Texts are joined with line feeds; words are runs of bytes outside
space and \\x09-\\x0D, and ASCII letters are lower-cased without changing any
offset.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_RNG = np.random.default_rng(20240229)
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MUL = np.uint64(0x9E3779B97F4A7C15)
PART = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _inverse(x: int) -> int:
    return pow(x, -1, 2**64)


class _Powers:
    """Powers of an odd multiplier and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.n = base, 0
        self.up = self.down = np.empty(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 16)
            for name, x in (("up", self.base), ("down", _inverse(self.base))):
                p = np.full(self.n, x, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_BYTES, _A, _B = _Powers(0x9E3779B97F4A7C15), _Powers(0xC2B2AE3D27D4EB4F), _Powers(0xD6E8FEB86659FD93)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of a batch of texts, in order. ``first[i]:first[i + 1]`` are those of text i."""

    buf: np.ndarray      # bytes of all texts, ASCII lower-cased, each followed by a line feed
    text_at: np.ndarray  # where each text begins in buf, and the end
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def words_of(texts: list[str | None], gap: np.ndarray = SPACE) -> Words:
    """Words are runs of bytes outside ``gap`` (which must hold the line feed); ASCII letters are lower-cased."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n".join([*raw, b""])
    buf = np.frombuffer(joined.lower(), np.uint8)
    text_at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=text_at[1:])
    word = ~gap[buf]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]  # the last byte is a line feed, so every word ends
    h = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):  # running sums over a part of the bytes at a time; a word's hash doesn't depend on its place
        at = start[lo]
        hi = max(lo + 1, int(np.searchsorted(end, at + PART, side="right")))
        part = buf[at:end[hi - 1]]
        up, down = _BYTES.get(len(part) + 1)
        first, last = start[lo:hi] - at, end[lo:hi] - at
        with np.errstate(over="ignore"):
            run = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(BYTE[part] * up[:len(part)], out=run[1:])
            h[lo:hi] = mix((run[last] - run[first]) * down[first] + (last - first).astype(np.uint64))
        lo = hi
    return Words(buf, text_at, start, end, h, np.searchsorted(start, text_at))


def spans_digest(h: np.ndarray, a: np.ndarray, b: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each word run h[a:b]."""
    out = []
    with np.errstate(over="ignore"):
        for k, powers in enumerate((_A, _B)):
            up, down = powers.get(len(h) + 1)
            run = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(mix(h, 2 * salt + k) * up[:len(h)], out=run[1:])
            out.append(mix((run[b] - run[a]) * down[a] + (b - a).astype(np.uint64), salt))
    return out[0], out[1]


def batches_of(texts: list[str | None], size: int = 1 << 18):
    """Index ranges of texts of about ``size`` characters together; a longer text stands alone."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "") + 1
        if i > at and total + n > size:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(texts):
        yield at, len(texts)


__all__ = ["Words", "batches_of", "mix", "spans_digest", "words_of"]
