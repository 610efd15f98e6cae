"""Quality rules: counts of words and lines, and bands of zstandard ratios over whole texts and fixed chunks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.bpe import slices
from memlake.llm.common import WORD, table, text_or_empty
from memlake.llm.words import split_words

#: (bytes from, least ratio, most ratio) of compressed to plain bytes. Prose of such a length lies between: what is below repeats
#: itself, what is above is close to random. Longer pieces of the same text compress better, so the limits fall with the length.
BANDS = ((1, 0.50, 0.90), (400, 0.48, 0.80), (700, 0.46, 0.74), (1200, 0.44, 0.68), (2500, 0.42, 0.64), (5000, 0.40, 0.62), (10_000, 0.39, 0.60), (20_000, 0.37, 0.58), (100_000, 0.30, 0.58))
#: Bytes of a chunk; a rest of fewer than LEAST_CHUNK bytes isn't judged on its own.
CHUNK, LEAST_CHUNK = 4096, 1024
#: Texts, and bytes of text, that are looked at together.
ROWS, BYTES = 512, 8 << 20
SYMBOLS = r"[#*$%&|<>]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def by_text(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of what belongs to each text: places starts[i] up to starts[i + 1]."""
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[starts])


def repeated_words(ids: np.ndarray, starts: np.ndarray, width: int = 3) -> np.ndarray:
    """How many words of each text are in a window of `width` words that its text has twice or more.

    Windows are compared by exact numbers: the number of a window of k + 1 words is that of its first k words with the last word's.
    """
    if len(ids) < width:
        return np.zeros(len(starts) - 1, dtype=np.int64)
    window, distinct = ids.astype(np.int64), int(ids.max()) + 1
    for k in range(1, width):
        window = window[:-1] * distinct + ids[k:]
        window = np.unique(window, return_inverse=True)[1]
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    whole = text[: len(window)] == text[width - 1 :]  # the window's words are of one text
    at = np.flatnonzero(whole)
    order = at[np.lexsort((window[at], text[at]))]
    same = np.zeros(len(order) + 1, dtype=bool)
    same[1:-1] = (window[order][1:] == window[order][:-1]) & (text[order][1:] == text[order][:-1])
    again = np.zeros(len(ids), dtype=bool)
    begins = order[same[1:] | same[:-1]]
    for k in range(width):
        again[begins + k] = True
    return by_text(again, starts)


def repeated_lines(texts: pa.Array) -> np.ndarray:
    """How many lines (between line feeds) with a word equal an earlier line of their text."""
    lists = pc.split_pattern(texts, "\n")
    starts = np.asarray(lists.offsets, dtype=np.int64) - lists.offsets[0].as_py()
    lines = lists.flatten()
    at = np.flatnonzero(pc.match_substring_regex(lines, WORD).to_numpy(zero_copy_only=False))
    if not len(at):
        return np.zeros(len(texts), dtype=np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(starts))[at]
    ids = lines.take(pa.array(at)).dictionary_encode().indices.to_numpy().astype(np.int64)
    first = np.unique(text * (int(ids.max()) + 1) + ids, return_index=True)[1]
    return np.bincount(text, minlength=len(texts)) - np.bincount(text[first], minlength=len(texts))


def counted(texts: pa.Array) -> list[np.ndarray]:
    """The COUNTS of each text."""
    words, starts = split_words(texts)
    ids = words.dictionary_encode().indices.to_numpy()
    symbols = pc.count_substring_regex(texts, SYMBOLS).to_numpy()
    return [np.diff(starts), by_text(pc.utf8_length(words).to_numpy(), starts), symbols, repeated_lines(texts), repeated_words(ids, starts)]


def outside(ratio: float, size: int, bands: Sequence[tuple[int, float, float]]) -> bool:
    """Whether a piece of this many bytes lies outside the band of its length."""
    low, high = next(((low, high) for least, low, high in reversed(bands) if size >= least), (0.0, float("inf")))
    return not low <= ratio <= high


def compressed(compressor: zstandard.ZstdCompressor, raw: memoryview, bands: Sequence[tuple[int, float, float]]) -> tuple[float, float]:
    """The ratio of a whole text, and the share of its judged chunks' bytes in chunks that are outside their bands."""
    if not len(raw):
        return 1.0, 0.0
    whole = len(compressor.compress(raw)) / len(raw)
    judged = bad = 0
    for start in range(0, len(raw), CHUNK):
        size = min(CHUNK, len(raw) - start)
        if size >= LEAST_CHUNK or len(raw) <= CHUNK:
            ratio = whole if size == len(raw) else len(compressor.compress(raw[start : start + size])) / size
            judged += size
            bad += size * outside(ratio, size, bands)
    return whole, bad / judged


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Sequence[tuple[int, float, float]] = BANDS, level: int = 3) -> DataFrame:
    """The figures of every whole text: (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ratio, chunks_outside, whole_outside).

    ratio is that of the UTF-8 bytes of the text, compressed by zstandard at this level, to those bytes; whole_outside is whether the band
    of the text's length has it; chunks_outside is the share of its chunks (by bytes) that are outside the bands of their lengths.
    A null text counts as empty: no words, ratio 1, nothing outside. Rows are independent: repeated rows give repeated results, and an empty
    table an empty one; columns besides the two are not read. A very long text is worked on alone.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", *COUNTS, "ratio", "chunks_outside", "whole_outside"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=level)
        for whole in batches:
            for batch in slices(whole, ROWS, BYTES):
                texts = batch.column(1)
                found = [compressed(compressor, memoryview(x), bands) for x in texts.cast(pa.binary()).to_pylist()]
                sizes = pc.binary_length(texts).to_pylist()
                wrong = [n > 0 and outside(ratio, n, bands) for (ratio, _), n in zip(found, sizes, strict=True)]
                columns = [pa.array(c.astype(np.int64)) for c in counted(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array([r for r, _ in found]), pa.array([float(s) for _, s in found]), pa.array(wrong)], names)

    read = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return read.mapInArrow(run, f"id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, ratio double, chunks_outside double, whole_outside boolean").withColumnRenamed("id", id_col)


def failed_base() -> Column:
    """Fewer than 50 words, or more than half of them in repeated windows of three."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Sequence[tuple[int, float, float]] = BANDS, chunk_share: float = 0.25, level: int = 3) -> DataFrame:
    """Which documents the rules keep: `measure`'s figures, base_failed and kept.

    A text goes if it has fewer than 50 words, if more than half of its words are in repeated windows of three, if its ratio lies outside
    the band of its length, or if more than `chunk_share` of it lies in chunks whose ratios are outside theirs. So a repeated or
    random part of a long text counts by its share, and one chunk alone rejects no long text. Nulls, empty and repeated rows: see `measure`.
    """
    known = measure(docs, id_col, text_col, bands, level).withColumn("base_failed", failed_base())
    return known.withColumn("kept", ~F.col("base_failed") & ~F.col("whole_outside") & (F.col("chunks_outside") <= chunk_share))


def op11_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents: see `judge` for the rules, nulls and long texts."""
    return judge(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept", "ratio", "chunks_outside")
