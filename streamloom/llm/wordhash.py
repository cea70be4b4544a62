"""Words and their 64-bit hashes for batches of texts, vectorised over bytes.

A byte table says which bytes part words (0) and what the others count as (for
example lower case). A word's hash is a polynomial of random byte values over
the integers modulo 2**64, finished by a mixing step; equal words hash alike
on every machine.
"""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: bytes worked on at once; a longer run ends at the next byte that parts words
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finisher)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def blank_table(lower_ascii: bool) -> np.ndarray:
    """Words are runs of anything but ASCII white space (blank and \\x09 to \\x0D)."""
    t = np.arange(256, dtype=np.uint8)
    if lower_ascii:
        t[65:91] = np.arange(97, 123, dtype=np.uint8)
    t[[0x20, *range(0x09, 0x0E)]] = 0
    # a NUL byte is an ordinary character of a word; 0xFF never occurs in UTF-8
    t[0] = 0xFF
    return t


def letter_table() -> np.ndarray:
    """Words are runs of ASCII letters (lower-cased), digits and bytes of other scripts."""
    t = np.zeros(256, dtype=np.uint8)
    t[48:58] = np.arange(48, 58)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


class WordHasher:
    def __init__(self, table: np.ndarray):
        self.table = table
        values = _BYTE_VALUES.copy()
        self.values = np.where(table == 0, np.uint64(0), values[table])
        self._powers = np.ones(1, dtype=np.uint64)
        self._inverses = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._powers) < n:
            size = max(n, CHUNK + 1)
            for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
                p = np.full(size, base, dtype=np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def _words(self, buf: np.ndarray, prefixes: tuple[int, ...] = ()):
        inside = self.table[buf] != 0
        edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
        starts, ends = edge[0::2], edge[1::2]
        if not len(starts):
            return (starts, ends, np.zeros(0, dtype=np.uint64), *[np.zeros(0, dtype=np.uint64) for _ in prefixes])
        self._grow(len(buf) + 1)
        sums = np.empty(len(buf) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(self.values[buf] * self._powers[: len(buf)], out=sums[1:])
        inverse = self._inverses[starts]
        cut = [mix((sums[np.minimum(starts + k, ends)] - sums[starts]) * inverse + np.uint64(k)) for k in prefixes]
        return (starts, ends, mix((sums[ends] - sums[starts]) * inverse), *cut)

    def words(self, buf: np.ndarray, prefixes: tuple[int, ...] = ()):
        """(starts, ends, hashes) of the words of a byte array; then, for each length, the hashes of the words' first bytes."""
        if len(buf) <= CHUNK:
            return self._words(buf, prefixes)
        parts, at = [], 0
        while at < len(buf):
            end = min(len(buf), at + CHUNK)
            while end < len(buf):  # move on to a byte that parts words
                gap = np.flatnonzero(self.table[buf[end : end + CHUNK]] == 0)
                if len(gap):
                    end += int(gap[0])
                    break
                end = min(len(buf), end + CHUNK)
            s, e, *h = self._words(buf[at:end], prefixes)
            parts.append((s + at, e + at, *h))
            at = end
        return tuple(np.concatenate(x) for x in zip(*parts))


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts with a line feed after each, and where each text starts (one more at the end)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=offsets[1:])
    return np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8) if raw else np.zeros(0, np.uint8), offsets


def batches_of(texts: list, limit: int = CHUNK):
    """(from, to) ranges of texts of about ``limit`` characters together; a longer text is alone."""
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > limit:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)
