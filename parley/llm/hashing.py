"""Word and word-window hashes of whole Arrow batches, in numpy."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multipliers of the polynomial hashes modulo 2**64, and their inverses.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
CHUNK_BYTES = 1 << 20
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64, kept per worker."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 4096), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of consecutive texts: 64-bit hashes, byte bounds, and each text's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = False):
        word = ~_SPACE[data]
        before, after = np.empty(len(data), bool), np.empty(len(data), bool)
        before[1:], after[:-1] = ~word[:-1], ~word[1:]
        inner = offsets[offsets < len(data)]
        before[inner] = True
        if len(data):
            before[0] = after[-1] = True
        after[inner[inner > 0] - 1] = True
        self.starts, self.ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
        table = _TABLE.copy()
        if fold:
            table[65:91] = table[97:123]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * powers(BYTE_BASE, len(data)), out=sums[1:])
        raw = (sums[self.ends] - sums[self.starts]) * powers(inverse(BYTE_BASE), len(data) + 1)[self.starts]
        self.hashes = mix64(raw + (self.ends - self.starts).astype(np.uint64))
        self.first = np.searchsorted(self.starts, offsets)
        self.data = data
        self._sums = None

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Rabin-Karp hashes of the word runs [start, stop), from prefix sums."""
        n = len(self.hashes)
        if self._sums is None:
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.hashes * powers(WORD_BASE, n), out=self._sums[1:])
        raw = (self._sums[stop] - self._sums[start]) * powers(inverse(WORD_BASE), n + 1)[start]
        return mix64(raw + (stop - start).astype(np.uint64))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows of ``size`` words inside one text, and the number of the text."""
        counts = np.maximum(np.diff(self.first) - size + 1, 0)
        text = np.repeat(np.arange(len(counts)), counts)
        skipped = np.cumsum(counts) - counts
        return np.arange(counts.sum()) - skipped[text] + self.first[:-1][text], text


def chunks(texts: pa.Array, fold: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) of slices of a string column of about ``CHUNK_BYTES``; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        end = min(end, len(texts))
        part = offsets[at:end + 1]
        yield at, end, Words(data[part[0]:part[-1]], part - part[0], fold)
        at = end
