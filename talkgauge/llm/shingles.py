"""Sets of word shingles as sorted 64-bit hashes, computed on whole batches of texts with numpy.

Texts are taken as UTF-8 bytes: A-Z are lower-cased, words are runs of anything but blank, tab, LF, VT, FF
and CR. A word's hash is a polynomial in its bytes, mixed with its length; a shingle's hash mixes those of
its words. A text with fewer words than a shingle has is one shingle; without words its set is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text looked at together (one longer text is taken alone).
RUN_BYTES = 1 << 18

_NO_WORD = 255  # no byte of UTF-8 text
_BASE = 0x9E3779B97F4A7C15


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


class Shingler:
    def __init__(self, k: int):
        self.k = k
        table = np.arange(256, dtype=np.uint8)
        table[65:91] += 32
        table[[9, 10, 11, 12, 13, 32]] = _NO_WORD
        self.table = table
        self.powers = self.inverses = np.ones(1, np.uint64)
        self.factors = mixed(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)

    def _reach(self, n: int) -> None:
        if len(self.powers) <= n:
            size = max(n + 1, RUN_BYTES + 1)
            steps = np.full(size, _BASE, np.uint64)
            back = np.full(size, _inverse(_BASE), np.uint64)
            steps[0] = back[0] = 1
            with np.errstate(over="ignore"):
                self.powers, self.inverses = np.multiply.accumulate(steps), np.multiply.accumulate(back)

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """A sorted array of distinct hashes for each text, in order; empty for nulls."""
        if texts.null_count:
            texts = texts.fill_null("")
        texts = texts.cast(pa.large_string())
        if not len(texts):
            return
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + RUN_BYTES, "right")) - 1)
            hi = min(hi, len(texts))
            yield from self._run(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            lo = hi

    def _run(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        n = len(offsets) - 1
        self._reach(len(data))
        x = self.table[data]
        word = np.zeros(len(x) + 2, bool)
        word[1:-1] = x != _NO_WORD
        begins, ends = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
        inner = offsets[1:-1]
        at = inner[inner < len(x)]
        begins[at] = word[1:-1][at]  # a text begins: so does a word
        before = inner[inner > 0] - 1
        ends[before] = word[1:-1][before]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        with np.errstate(over="ignore"):
            sums = np.zeros(len(x) + 1, np.uint64)
            np.cumsum((x.astype(np.uint64) + np.uint64(1)) * self.powers[: len(x)], out=sums[1:])
            words = mixed((sums[e] - sums[s]) * self.inverses[s] ^ (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            first = np.searchsorted(s, offsets)
            m, k = len(words), self.k
            whole = np.zeros(max(0, m - k + 1), np.uint64)
            for j in range(k):
                whole += words[j : m - k + 1 + j] * self.factors[j] if m >= k else whole
            whole = mixed(whole)
            for d in range(n):
                a, b = int(first[d]), int(first[d + 1])
                if b - a >= k:
                    yield np.unique(whole[a : b - k + 1])
                elif b > a:
                    short = (words[a:b] * self.factors[: b - a]).sum(dtype=np.uint64)
                    yield mixed(np.array([short ^ np.uint64(b - a)], np.uint64))
                else:
                    yield np.zeros(0, np.uint64)
