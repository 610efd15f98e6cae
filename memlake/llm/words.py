"""Words and word shingles of many texts at once, as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Odd multipliers and shifts of a 64-bit mixing function.
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def step(k: int) -> np.uint64:
    """What the k-th value of a sequence is moved by before it is mixed."""
    return np.uint64(k * int(MIX[2]) % 2**64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, and where each text's begin: words i are [starts[i], starts[i + 1]).

    A word is a run without space, tab, line feed, vertical tab, form feed and carriage return.
    """
    lists = pc.ascii_split_whitespace(texts)
    words, ends = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    ends = ends - ends[0]
    filled = pc.greater(pc.binary_length(words), 0)
    kept = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
    return words.filter(filled), kept[ends]


def word_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every word; each different word is hashed once."""
    coded = words.dictionary_encode()
    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w or "") for w in coded.dictionary.to_pylist()), dtype=">u8").astype(np.uint64).reshape(-1, 2)
    at = coded.indices.to_numpy()
    return digests[at, 0], digests[at, 1]


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words, lower-cased, and where each text's begin.

    A text of fewer words, but at least one, has one shingle of all its words.
    """
    words, starts = split_words(pc.utf8_lower(texts))
    if len(words) == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(starts), dtype=np.int64)
    base = word_hashes(words)[0]
    n = np.diff(starts)
    counts = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    first = np.repeat(starts[:-1] - bounds[:-1], counts) + np.arange(bounds[-1])
    left = np.repeat(starts[1:], counts)  # where the words of the shingle's text end
    total = np.zeros(bounds[-1], dtype=np.uint64)
    for k in range(width):
        at = first + k
        total = mixed(total + step(k + 1)) + np.where(at < left, base[np.minimum(at, len(base) - 1)], np.uint64(0))
    return mixed(total), bounds


def distinct_by_text(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's different values in ascending order, how often each occurs, and where each text's begin."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(values)))
    return values[at], counts, np.concatenate([[0], np.cumsum(np.bincount(text[at], minlength=len(bounds) - 1))])
