"""Words of many texts at once, as 64-bit hashes: numpy over one buffer of bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: All of ASCII but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Lower case of A to Z, for bytes.translate.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over the whole word (a bijection)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table, dtype=np.uint64)
    return _powers


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes; equal bytes give equal hashes wherever they stand."""
    power, inverse = _power_tables(len(buffer) + 1)
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_LETTERS[buffer] * power[: len(buffer)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def word_spans(buffer: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(separators[buffer], prepend=True, append=True))
    return edges[::2], edges[1::2]


class TextWords:
    """The words of several texts: hash of each word, text it is from. By default ``[^\\x20\\x09-\\x0D]+``."""

    def __init__(self, texts: list[bytes], separators: np.ndarray = SPACES):
        self.buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.starts, self.ends = word_spans(self.buffer, separators)
        self.text = np.searchsorted(np.cumsum(lengths), self.starts, side="right")
        self.hashes = span_hashes(self.buffer, self.starts, self.ends)
        #: Words of text i are those from bounds[i] to bounds[i + 1].
        self.bounds = np.searchsorted(self.text, np.arange(len(texts) + 1))


def in_chunks(texts: Iterable[bytes], size: int = 1 << 19) -> Iterator[list[bytes]]:
    """Consecutive texts of about ``size`` bytes together; a longer text comes alone."""
    chunk, total = [], 0
    for text in texts:
        if chunk and total + len(text) > size:
            yield chunk
            chunk, total = [], 0
        chunk.append(text)
        total += len(text)
    if chunk:
        yield chunk
