"""Substring deduplication: a count-min prefilter, then exact grouping of what it can't rule out."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import checkpoint, shuffle_partitions, table, text_or_empty
from memlake.llm.words import mixed, split_words, word_hashes

#: Least bytes of text whose windows are sketched together, and least cells of the sketch that are merged in one task.
CHUNK_BYTES, SHARD_BITS = 8 << 20, 24
#: Cells that a message between chunks and ranges of the sketch has on the average, where memory allows it.
MESSAGE_CELLS = 512
#: What a byte of a chunk's text and a cell of a range take in a task's memory, at most.
CHUNK_MEMORY, CELL_MEMORY = 24, 4
#: Cells of each of the two rows of the sketch for one window.
CELLS_PER_WINDOW = 4
#: Most bytes of window hashes that are grouped in one task, on the average, if all windows are suspects.
OWNER_BYTES = 64 << 20
#: Odd bases of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _rolling(hashes: np.ndarray, at: np.ndarray, window: int, base: int) -> np.ndarray:
    """Hashes of the windows that begin at these words: a polynomial in the base, modulo 2^64."""
    powers = np.full(len(hashes) + 1, base, dtype=np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    back = np.full(len(hashes) + 1, pow(base, -1, 2**64), dtype=np.uint64)
    back[0] = 1
    back = np.cumprod(back, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes * powers[:-1], dtype=np.uint64)])
    return mixed((sums[at + window] - sums[at]) * back[at])


def windows(texts: pa.Array, window: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, where each text's begin, where each window begins, and two hashes of each window."""
    words, starts = split_words(texts)
    ends = np.repeat(starts[1:], np.diff(starts))
    at = np.flatnonzero(np.arange(len(words)) + window <= ends)
    if not len(at):
        none = np.zeros(0, dtype=np.uint64)
        return words, starts, at, none, none
    one, two = word_hashes(words)
    return words, starts, at, _rolling(one, at, window, BASES[0]), _rolling(two, at, window, BASES[1])


def pack_cells(cells: np.ndarray) -> bytes:
    """Ascending numbers below 2^32 as gaps, byte by byte, compressed."""
    gaps = np.diff(cells, prepend=0).astype("<u4")
    return zstandard.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpack_cells(code: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(code), dtype=np.uint8)
    gaps = np.ascontiguousarray(planes.reshape(4, -1).T).reshape(-1).view("<u4")
    return np.cumsum(gaps, dtype=np.int64)


def _bits(code: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(code, dtype=np.uint8))[:n].astype(bool)


def _sketch_rows(hashes: tuple[np.ndarray, np.ndarray], bits: int, shard_bits: int):
    """For both rows of the sketch: the cells of all windows, ascending and different, and how many windows each has."""
    for row, h in enumerate(hashes):
        cells, counts = np.unique((h >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
        edges = np.flatnonzero(np.diff(cells >> shard_bits, prepend=-1)) if len(cells) else np.zeros(0, dtype=np.int64)
        yield row, cells, counts, edges, np.append(edges[1:], len(cells))


def _answers(table: pa.Table, stage: int) -> dict[tuple[int, int], bytes]:
    """(row, part) -> bitmap, of what one stage sent back to a chunk."""
    kept = table.filter(pc.equal(table["stage"], stage))
    return dict(zip(zip(kept["row"].to_pylist(), kept["part"].to_pylist(), strict=True), kept["again"].to_pylist(), strict=True))


def _suspects(one: np.ndarray, two: np.ndarray, said: dict[tuple[int, int], bytes], bits: int, shard_bits: int):
    """Which windows have cells that count two or more in both rows, and their different hash pairs, ascending, with counts."""
    left = np.arange(len(one))
    for row, cells, _, begins, ends in _sketch_rows((one, two), bits, shard_bits):
        parts = [_bits(said[row, int(cells[a] >> shard_bits)], b - a) for a, b in zip(begins, ends, strict=True)]
        repeated = cells[np.concatenate(parts)] if parts else cells
        own = ((one, two)[row][left] >> np.uint64(64 - bits)).astype(np.int64)
        at = np.searchsorted(repeated, own)
        left = left[(at < len(repeated)) & (repeated[np.minimum(at, len(repeated) - 1)] == own)] if len(repeated) else left[:0]
    return left, *_count_pairs(one[left], two[left])


def _by_owner(pairs: tuple[np.ndarray, np.ndarray], owner_bits: int):
    """Ranges of ascending pairs that have the same owner: (owner, from, to)."""
    owners = (pairs[0] >> np.uint64(64 - owner_bits)).astype(np.int64) if owner_bits else np.zeros(len(pairs[0]), dtype=np.int64)
    if not len(owners):
        return []
    edges = np.flatnonzero(np.diff(owners, prepend=-1))
    return [(int(owners[a]), int(a), int(b)) for a, b in zip(edges, np.append(edges[1:], len(owners)), strict=True)]


def repeated_windows(chunks: DataFrame, window: int, bits: int, shard_bits: int, owner_bits: int) -> DataFrame:
    """What chunks (chunk, text) must know to tell repeated windows: rows (chunk, stage, row, part, again), all bitmaps.

    First pass: each chunk makes a count-min sketch of two rows and sends every range of cells, compressed, to the
    task that merges this range; counts stop at two. Back comes a bit for each cell that was sent: whether
    it counts two or more (stage 1). The sketch grows with the input, and no task holds more than one range of it.
    Second pass: windows whose cells count two in both rows (an estimate which is never too low) go, each different
    one of a chunk once, as 128-bit hashes to the task that owns their range, which groups them exactly. Back comes a
    bit for each (stage 2). All other windows occur once and are never shuffled.
    """
    grouped = chunks.groupBy("chunk")
    sent = pa.schema([("chunk", pa.int32()), ("row", pa.int32()), ("part", pa.int32()), ("n", pa.int32()), ("data", pa.binary()), ("twice", pa.binary())])
    packed = "chunk int, row int, part int, n int, data binary, twice binary"
    answered = "chunk int, stage int, row int, part int, again binary"

    def sketch(rows: pa.Table) -> pa.Table:
        *_, one, two = windows(rows["text"].combine_chunks(), window)
        chunk, out = rows["chunk"][0].as_py(), []
        for row, cells, counts, begins, ends in _sketch_rows((one, two), bits, shard_bits):
            for a, b in zip(begins, ends, strict=True):
                part = int(cells[a] >> shard_bits)
                out.append({"chunk": chunk, "row": row, "part": part, "n": int(b - a), "data": pack_cells(cells[a:b] - (part << shard_bits)), "twice": np.packbits(counts[a:b] > 1).tobytes()})
        return pa.Table.from_pylist(out, sent)

    def told(parts: pa.Table, stage: int, again: list[bytes]) -> pa.Table:
        return pa.table({"chunk": parts["chunk"], "stage": pa.array(np.full(len(again), stage, dtype=np.int32)), "row": parts["row"], "part": parts["part"], "again": pa.array(again, pa.binary())})

    def merge(parts: pa.Table) -> pa.Table:
        counts = np.zeros(1 << min(bits, shard_bits), dtype=np.uint8)
        codes, twice, sizes = parts["data"], parts["twice"], parts["n"].to_pylist()
        for k, n in enumerate(sizes):
            cells = unpack_cells(codes[k].as_py())
            counts[cells] = np.minimum(counts[cells] + 1 + _bits(twice[k].as_py(), n), 2)
        return told(parts, 1, [np.packbits(counts[unpack_cells(codes[k].as_py())] > 1).tobytes() for k in range(len(sizes))])

    def suspect(rows: pa.Table, answers: pa.Table) -> pa.Table:
        *_, one, two = windows(rows["text"].combine_chunks(), window)
        _, pairs, counts = _suspects(one, two, _answers(answers, 1), bits, shard_bits)
        chunk = rows["chunk"][0].as_py()
        out = [{"chunk": chunk, "row": 0, "part": owner, "n": b - a, "data": pairs[0][a:b].tobytes() + pairs[1][a:b].tobytes(), "twice": np.packbits(counts[a:b] > 1).tobytes()} for owner, a, b in _by_owner(pairs, owner_bits)]
        return pa.Table.from_pylist(out, sent)

    def group(parts: pa.Table) -> pa.Table:
        sizes = parts["n"].to_numpy()
        both = [np.frombuffer(data, dtype=np.uint64).reshape(2, -1) for data in parts["data"].to_pylist()]
        one, two = np.concatenate([x[0] for x in both]), np.concatenate([x[1] for x in both])
        times = 1 + np.concatenate([_bits(bits_, n) for bits_, n in zip(parts["twice"].to_pylist(), sizes, strict=True)])
        order = np.lexsort((two, one))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        which = np.cumsum(new) - 1
        again = np.zeros(len(order), dtype=bool)
        again[order] = (np.bincount(which, weights=times[order]) > 1)[which]
        return told(parts, 2, [np.packbits(x).tobytes() for x in np.split(again, np.cumsum(sizes)[:-1])])

    merged = grouped.applyInArrow(sketch, packed).groupBy("row", "part").applyInArrow(merge, answered)
    suspects = grouped.cogroup(merged.groupBy("chunk")).applyInArrow(suspect, packed)
    return merged.union(suspects.groupBy("part").applyInArrow(group, answered))


def _count_pairs(one: np.ndarray, two: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The different pairs of two arrays, and how often each occurs."""
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    new = np.ones(len(one), dtype=bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    at = np.flatnonzero(new)
    return (one[at], two[at]), np.diff(np.append(at, len(one)))


def plan(n_bytes: int, task_bytes: int) -> tuple[int, int]:
    """Bytes of a chunk and bits of a range's cells for so many bytes of text, in tasks of so much memory.

    Chunks times ranges is the number of messages, and both grow with the input: so do chunks and ranges, until a message has
    MESSAGE_CELLS cells on the average or a task's memory is full; with less memory messages get smaller, and nothing is lost.
    With tasks of 12 GB, 1 TB of text has 0.8 * 10^9 messages, and 100 TB 10^11 of 300 cells.
    """
    chunk, bits = CHUNK_BYTES, SHARD_BITS
    while chunk << bits < MESSAGE_CELLS * CELLS_PER_WINDOW * n_bytes:
        if CELL_MEMORY << bits + 1 <= task_bytes and (1 << bits) * CELL_MEMORY <= chunk * CHUNK_MEMORY:
            bits += 1
        elif 2 * chunk * CHUNK_MEMORY <= task_bytes:
            chunk *= 2
        elif CELL_MEMORY << bits + 1 <= task_bytes:
            bits += 1
        else:
            break
    return chunk, bits


def task_memory(spark: SparkSession) -> int:
    """Bytes that the Python side of one task may take: a quarter of an executor's memory, shared by its cores."""
    sizes = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    setting = spark.conf.get("spark.executor.memory", "1g").lower().rstrip("b")
    size = int(setting[:-1]) * sizes[setting[-1]] if setting[-1] in sizes else int(setting)
    return size // 4 // max(1, int(spark.conf.get("spark.executor.cores", "1")))


def dealt(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int | None, shard_bits: int | None) -> tuple[DataFrame, int, int]:
    """Rows (id, text, chunk), the bytes of all texts, and the bits of a range.

    Rows go to chunks by the hash of id and text. If copies of one row alone would fill a chunk, rows are numbered first
    (and written, so that the numbers hold when tasks are run again), and go by their number.
    """
    read = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    rows = read.groupBy(F.xxhash64("id", "text").alias("h")).agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n"))
    sums = rows.agg(F.sum("b").alias("b"), F.max(F.when(F.col("n") > 1, F.col("b") + 64 * F.col("n"))).alias("most")).first()
    n_bytes = int(sums["b"] or 0)
    chunk, bits = plan(n_bytes, task_memory(docs.sparkSession))
    chunk, bits = chunk_bytes or chunk, shard_bits or bits
    count = max(4 * shuffle_partitions(docs.sparkSession), math.ceil(n_bytes / chunk))
    key = F.xxhash64("id", "text")
    if int(sums["most"] or 0) > chunk:
        read = checkpoint(read.withColumn("number", F.monotonically_increasing_id()))
        key = F.xxhash64("number")
    return read.select("id", "text", F.pmod(key, F.lit(count)).cast("int").alias("chunk")), n_bytes, bits


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, chunk_bytes: int | None = None, shard_bits: int | None = None) -> DataFrame:
    """Remove every word that a repeated window covers: one row (id, n_words, n_removed, text) for each document.

    A window is `window` consecutive words of one document; it is repeated if its words also start anywhere else,
    the same document included. Windows are judged on the input, all copies go. The text left has the kept words,
    joined by one space. Words are runs without ASCII white space, unchanged. A null text has no word and
    leaves an empty text, as does an empty one; a text of fewer words than a window is kept. Rows are told
    apart even if they repeat id and text, which then repeats all windows. An empty table gives an empty
    result; other columns are not read.

    See `repeated_windows` for the method. Texts are dealt once, to chunks, and all passes read that exchange again; see
    `plan` for the sizes of chunks and of the sketch's ranges, which come from the input and the executors' memory
    unless they are given. Two windows are the same words if two 64-bit hashes agree, of 128 bits together.
    """
    chunks, n_bytes, shard_bits = dealt(docs, id_col, text_col, chunk_bytes, shard_bits)
    bits = min(60, max(16, math.ceil(math.log2(CELLS_PER_WINDOW * max(1, n_bytes / 5)))))
    owner_bits = max(0, math.ceil(math.log2(max(1, n_bytes * 16 / 5 / OWNER_BYTES))))
    kind = docs.schema[id_col].dataType.simpleString()

    def remove(rows: pa.Table, answers: pa.Table) -> pa.Table:
        words, starts, at, one, two = windows(rows["text"].combine_chunks(), window)
        left, pairs, _ = _suspects(one, two, _answers(answers, 1), bits, shard_bits)
        said = _answers(answers, 2)
        parts = [_bits(said[0, owner], b - a) for owner, a, b in _by_owner(pairs, owner_bits)]
        again = np.concatenate(parts) if parts else np.zeros(0, dtype=bool)
        order = np.lexsort((two[left], one[left]))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (one[left][order][1:] != one[left][order][:-1]) | (two[left][order][1:] != two[left][order][:-1])
        hit = at[left[order][again[np.cumsum(new) - 1]]]
        edges = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(edges, hit, 1)
        np.add.at(edges, hit + window, -1)
        kept = np.cumsum(edges)[:-1] == 0
        before = np.concatenate([[0], np.cumsum(kept)])[starts]
        lists = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), words.filter(pa.array(kept)))
        n_words = np.diff(starts)
        return pa.table({"id": rows["id"], "n_words": pa.array(n_words), "n_removed": pa.array(n_words - np.diff(before)), "text": pc.binary_join(lists, " ")})

    answers = repeated_windows(chunks, window, bits, shard_bits, owner_bits)
    out = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(remove, f"id {kind}, n_words long, n_removed long, text string")
    return out.withColumnsRenamed({"id": id_col, "text": text_col})


def op1_count_min_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of repeated windows of 35 words: see `remove_repeats` for nulls, copies and long texts."""
    left = remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
