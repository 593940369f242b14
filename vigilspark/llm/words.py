"""Words and rolling hashes of many texts at once, in NumPy.

A word is a run of bytes other than space and ``\\x09-\\x0D``; the words of a text are unchanged UTF-8.
The hash of consecutive words is that of their bytes joined by single spaces: a polynomial over a table of
random byte values, modulo 2**64, taken from prefix sums, so any window costs the same. It depends on the
words alone, never on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_BASE = 0xD6E8FEB86659FD95  # 5 modulo 8: its powers repeat only after 2**62 bytes
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240607).integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}

#: Texts are handled in groups of about this many bytes; one longer text is a group of its own.
GROUP_BYTES = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, GROUP_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of a 64-bit hash (the public murmur3 finaliser)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words:
    """The words of a group of texts. ``first[d]:first[d + 1]`` are the words of text ``d``."""

    def __init__(self, texts: Sequence[str | None], lower: bool = False):
        joined, counts = [], []
        for text in texts:
            raw = text.encode("utf-8", "surrogatepass") if text else b""
            words = (raw.lower() if lower else raw).split()  # bytes: ASCII white space and A-Z only
            counts.append(len(words))
            if words:
                joined.append(b" ".join(words))
        self.counts = np.array(counts, dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.buffer = np.frombuffer(b" ".join(joined), dtype=np.uint8)
        gaps = np.flatnonzero(self.buffer == 32)
        n = len(self.buffer)
        self.starts = np.concatenate([[0], gaps + 1]) if n else np.zeros(0, dtype=np.int64)
        self.ends = np.concatenate([gaps, [n]]) if n else np.zeros(0, dtype=np.int64)
        self.text_of = np.repeat(np.arange(len(counts)), self.counts)
        terms = _VALUES[self.buffer] * _powers(_BASE, n)
        self._sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(terms, dtype=np.uint64)])

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of words ``begin`` to ``end``, both inclusive, numbered over the group."""
        a, b = self.starts[begin], self.ends[end]
        return mix((self._sums[b] - self._sums[a]) * _powers(_INVERSE, len(self.buffer) + 1)[a])

    def windows(self, k: int) -> np.ndarray:
        """Hash of the ``k`` words from every word on; the last of a text run over its end."""
        n = len(self.starts) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        begin = np.arange(n)
        return self.hashes(begin, begin + k - 1)


def grouped(texts: Sequence[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Cut texts into groups of about GROUP_BYTES; yields the number of the first and the texts."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text) if text else 0
        if size >= GROUP_BYTES:
            yield begin, list(texts[begin : i + 1])
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, list(texts[begin:])


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    least, span = a, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    n = len(a) - width + 1
    return np.minimum(least[:n], least[width - span : width - span + n])
