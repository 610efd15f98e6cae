"""Byte-level BPE over whole texts as a tree reduction of a monoid."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import table, text_or_empty

#: Characters that one leaf of the tree encodes at once, and ids that one leaf decodes.
LEAF = 16_384
#: Characters of a boundary window at first, on each side; it doubles until a safe cut is in it.
WINDOW = 64
#: Rows for which results are built at a time, and bytes of their texts: an Arrow array holds less than 2 GB.
ROWS, BYTES = 256, 1 << 27
#: Where any text splits whatever stands around it: after a letter or digit and before a space or line feed.
#: No alternative of the pattern has a character that is not white space followed by white space.
SAFE = re.compile(r"(?<=[^\W_])(?=[ \n])")


@functools.cache
def encoding(path: str | None = None, pattern: str | None = None):
    """The tokenizer of a rank file, once a worker process; by default the public 50k vocabulary."""
    import tiktoken

    if path is None or pattern is None:
        import public_tokenizers

        path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def last_cut(text: str, window: int = WINDOW) -> int:
    """The last safe cut inside the text, found in a growing tail; 0 if there is none."""
    while True:
        start = max(0, len(text) - window)
        cuts = [m.start() for m in SAFE.finditer(text, start)]
        if cuts:
            return cuts[-1]
        if start == 0:
            return 0
        window *= 2


def first_cut(text: str) -> int:
    """The first safe cut inside the text; its length if there is none."""
    found = SAFE.search(text)
    return found.start() if found else len(text)


def join(encode: Callable[[str], list[int]], left: str, left_ids: Sequence[int], right: str, right_ids: Sequence[int]) -> list[int]:
    """The ids of left + right from the ids of both.

    The window reaches from the last safe cut of the left to the first one of the right. A safe cut
    splits the text in any surroundings, so the ids before and after the window stay what they were; those
    inside are encoded anew.
    """
    p, q = last_cut(left), first_cut(right)
    tail, head = left[p:], right[:q]
    kept = len(left_ids) - len(encode(tail))
    return [*left_ids[:kept], *encode(tail + head), *right_ids[len(encode(head)) :]]


def encode_tree(encode: Callable[[str], list[int]], text: str, leaf: int = LEAF) -> list[int]:
    """Encode halves and join them; a text of a leaf's length is encoded at once."""
    if len(text) <= leaf:
        return encode(text)
    half = len(text) // 2
    left, right = text[:half], text[half:]
    return join(encode, left, encode_tree(encode, left, leaf), right, encode_tree(encode, right, leaf))


def decode_tree(decode: Callable[[Sequence[int]], bytes], ids: Sequence[int], leaf: int = LEAF) -> bytes:
    """Bytes of the ids: those of both halves, concatenated."""
    if len(ids) <= leaf:
        return decode(ids)
    half = len(ids) // 2
    return decode_tree(decode, ids[:half], leaf) + decode_tree(decode, ids[half:], leaf)


def slices(whole: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch (id, text) of at most so many rows, and so many bytes of text unless one text alone has more."""
    lengths = pc.binary_length(whole.column(1)).to_pylist()
    start = total = 0
    for k, n in enumerate(lengths):
        if k > start and (k - start == rows or total + n > size):
            yield whole.slice(start, k - start)
            start, total = k, 0
        total += n
    if start < len(lengths):
        yield whole.slice(start)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None, leaf: int = LEAF) -> DataFrame:
    """Ids of every whole text, and the bytes that they decode to: (id, ids array<int>, decoded binary).

    Each match of the pattern is encoded on its own, without special tokens. A null text counts as empty
    and has no ids. Rows are independent: repeated rows give repeated results, an empty table an empty one,
    and columns besides the two are not read. ranks_path must be readable on every node.
    """
    key = docs.schema[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoding(ranks_path, pattern)
        for whole in batches:
            for batch in slices(whole, ROWS, BYTES):
                ids = [encode_tree(tokens.encode_ordinary, text, leaf) for text in batch.column(1).to_pylist()]
                decoded = [decode_tree(tokens.decode_bytes, x, leaf) for x in ids]
                flat = np.concatenate([np.asarray(x, dtype=np.int32) for x in ids])
                offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(decoded, pa.binary())], ["id", "ids", "decoded"])

    read = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return read.mapInArrow(run, f"id {key.dataType.simpleString()}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all documents and of what they decode to: see `encode_documents` for nulls and long texts."""
    encoded = encode_documents(table(spark, sf_dir, "documents"))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
