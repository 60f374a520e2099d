"""Words of a text and hashes of word shingles, on UTF-8 bytes.

A word is a run of digits, a-z and characters from U+0080 on after A-Z is
lower-cased; every byte of such a character is at least 0x80, so bytes decide.
"""

from __future__ import annotations

import numpy as np

_TABLE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_SEGMENT = 1 << 20


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


def normalized(text: str | None) -> bytes:
    """The words with single spaces between them."""
    return b" ".join(split_words(text))


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int):
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 12)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_POWERS = _Powers()


def word_spans(norm: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends in bytes of the words of a normalized text."""
    if not norm:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 0x20)
    return np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(norm)]))


def shingle_hashes(norm: bytes, k: int, spans=None) -> np.ndarray:
    """Hashes of the runs of k words, by the word they start at; with fewer words none.

    A polynomial over the bytes, taken relative to the run's start. Texts are
    taken in segments of about a megabyte, so memory follows the words only.
    """
    starts, ends = spans or word_spans(norm)
    n = len(starts) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    data, out, i = np.frombuffer(norm, np.uint8), np.empty(n, np.uint64), 0
    while i < n:
        j = max(i + 1, min(n, int(np.searchsorted(starts, starts[i] + _SEGMENT))))
        lo, hi = int(starts[i]), int(ends[j + k - 2])
        up, down = _POWERS.upto(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(data[lo:hi].astype(np.uint64) * up[: hi - lo], out=sums[1:])
        s = starts[i:j] - lo
        out[i:j] = (sums[ends[i + k - 1 : j + k - 1] - lo] - sums[s]) * down[s]
        i = j
    return mix(out)
