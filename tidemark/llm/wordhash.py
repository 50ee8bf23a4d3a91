"""Words of a batch of texts and their hashes, on arrays, for the operators that run in Python."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Words whose hashes a worker keeps.
KEPT = 150_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class Split:
    """A batch of texts as words: `codes` numbers the words of all texts one after the other, text i has those from ends[i] to ends[i + 1],
    and `distinct` is the Arrow array of the words that the numbers stand for."""

    def __init__(self, column: pa.Array, lower: bool = False):
        text = column.cast(pa.binary()).fill_null(b"").view(pa.string())  # bytes are taken as they are
        if lower:
            text = pc.ascii_lower(text)
        lists = pc.ascii_split_whitespace(text)
        ends, values = lists.offsets.to_numpy().astype(np.int64), lists.values.dictionary_encode()
        codes, self.distinct = values.indices.to_numpy(zero_copy_only=False), values.dictionary
        # blanks at an end of a text give an empty part
        blank = pc.index(self.distinct, pa.scalar("")).as_py()
        if blank >= 0:
            word = codes != blank
            ends = np.r_[0, np.cumsum(word)][ends]
            codes = codes[word]
        self.codes, self.ends = codes, ends

    def __len__(self) -> int:
        return len(self.ends) - 1

    def sizes(self) -> np.ndarray:
        return np.diff(self.ends)

    def rows(self) -> np.ndarray:
        """The text each word is of."""
        return np.repeat(np.arange(len(self)), self.sizes())

    def words(self) -> list[bytes]:
        return self.distinct.view(pa.binary()).to_pylist()


class WordHashes(dict):
    """bytes -> 64-bit hash; the first KEPT words stay."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < KEPT:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))

    def split(self, column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the words of all texts, ends): text i has the hashes from ends[i] to ends[i + 1]."""
        s = Split(column, lower)
        return self.of(s.words())[s.codes] if len(s.codes) else np.zeros(0, np.uint64), s.ends


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    if n <= 16:
        for k in range(n):
            out = (out ^ h[k : k + m]) * MIX
            out ^= out >> np.uint64(29)
        return mixed(out)
    # long windows: differences of prefix sums of h[i] * B^i, brought to the same power by the inverse of B
    powers = np.cumprod(np.full(len(h), MIX, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h) * powers, dtype=np.uint64)])
    inverse = np.uint64(pow(int(MIX), -1, 1 << 64))
    back = np.cumprod(np.full(m, inverse, np.uint64))
    return mixed((sums[n:] - sums[:m]) * back)
