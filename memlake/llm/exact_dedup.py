"""Exact duplicates by an exchange of Golomb-coded fingerprints."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import checkpoint, shuffle_partitions, table, text_or_empty

#: Rows whose fingerprints one sender codes together, and that one owner counts.
SENDER_ROWS, OWNER_ROWS = 1 << 22, 1 << 24
#: Bits of a fingerprint beyond those that number the rows: of texts that nobody else has, about one in 2^SPARE is a suspect.
SPARE = 10
#: Most bytes of suspect fingerprints that are broadcast to the texts; more are joined by a shuffle.
BROADCAST_BYTES = 8 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text_col: str) -> Column:
    """The text with A-Z in lower case, a null as empty."""
    return F.translate(text_or_empty(text_col), UPPER, LOWER)


def golomb_encode(sorted_values: np.ndarray, shift: int) -> bytes:
    """Golomb-Rice code of ascending numbers: each gap's quotient by 2^shift in unary, the rest in `shift` bits."""
    gaps = np.diff(sorted_values, prepend=np.uint64(0)).astype(np.uint64)
    quotients = (gaps >> np.uint64(shift)).astype(np.int64)
    stops = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(stops[-1]) + 1 if len(stops) else 0, dtype=np.uint8)
    unary[stops] = 1
    rests = (gaps[:, None] >> np.arange(shift, dtype=np.uint64)[None, :]).astype(np.uint8) & 1
    return np.packbits(np.concatenate([unary, rests.reshape(-1)])).tobytes()


def golomb_decode(code: bytes, count: int, shift: int) -> np.ndarray:
    """The numbers that golomb_encode was given."""
    bits = np.unpackbits(np.frombuffer(code, dtype=np.uint8))
    stops = np.flatnonzero(bits)[:count]
    quotients = np.diff(stops, prepend=-1) - 1
    begin = int(stops[-1]) + 1 if count else 0
    rests = bits[begin : begin + count * shift].reshape(count, shift).astype(np.uint64) << np.arange(shift, dtype=np.uint64)[None, :]
    return np.cumsum((quotients.astype(np.uint64) << np.uint64(shift)) + rests.sum(axis=1, dtype=np.uint64))


def suspects(known: DataFrame, bits: int, senders: int, owners: int, n_rows: int) -> DataFrame:
    """The fingerprints (of this many bits), of rows with a column fingerprint, that at least two rows have.

    Senders are the partitions of the table as it lies. Each sorts its different fingerprints and sends every
    owner the Golomb code of those in the owner's range, with a bitmap of those it has twice itself. An owner counts
    how many senders have each, and answers every code with a bitmap: whether others have it too. What a
    code and its bitmap say together is a suspect. Fingerprints never leave a task but coded: log2(gap) + 2 bits
    each, and one bit back.
    """
    width = -(-(1 << bits) // owners)
    shift = max(0, round(math.log2(max(1.0, 0.69 * (1 << bits) / max(1, n_rows / senders)))))
    code = "sender long, owner int, n int, code binary, twice binary"

    def coded(sender: int, rows: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(rows), return_counts=True)
        to = (values // np.uint64(width)).astype(np.int64)
        begins = np.flatnonzero(np.diff(to, prepend=-1))
        ranges = list(zip(to[begins].tolist(), begins.tolist(), np.append(begins[1:], len(to)).tolist(), strict=True))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([sender] * len(ranges), pa.int64()),
                pa.array([owner for owner, _, _ in ranges], pa.int32()),
                pa.array([b - a for _, a, b in ranges], pa.int32()),
                pa.array([golomb_encode(values[a:b] - np.uint64(owner * width), shift) for owner, a, b in ranges], pa.binary()),
                pa.array([np.packbits(counts[a:b] > 1).tobytes() for _, a, b in ranges], pa.binary()),
            ],
            ["sender", "owner", "n", "code", "twice"],
        )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, sender = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            sender = batch.column(1)[0].as_py() if sender is None else sender
            held.append(batch.column(0).to_numpy().astype(np.uint64))
            n += batch.num_rows
            if n >= SENDER_ROWS:
                yield coded(sender, held)
                held, n, sender = [], 0, None
        if held:
            yield coded(sender, held)

    def own(group: pa.Table) -> pa.Table:
        sizes = group["n"].to_numpy()
        values = [golomb_decode(c.as_py(), int(n), shift) for c, n in zip(group["code"], sizes, strict=True)]
        twice = [np.unpackbits(np.frombuffer(b.as_py(), dtype=np.uint8))[:n] for b, n in zip(group["twice"], sizes, strict=True)]
        found, at = np.unique(np.concatenate(values), return_inverse=True)
        times = np.bincount(at, weights=np.concatenate(twice) + 1.0, minlength=len(found))
        again = np.split(times[at] > 1, np.cumsum(sizes)[:-1])
        return pa.table({"from": group["sender"], "by": group["owner"], "again": pa.array([np.packbits(x).tobytes() for x in again], pa.binary())})

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, n, code, again in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                held = np.unpackbits(np.frombuffer(again, dtype=np.uint8))[:n].astype(bool)
                if held.any():
                    yield pa.RecordBatch.from_arrays([pa.array((golomb_decode(code, n, shift)[held] + np.uint64(owner * width)).astype(np.int64))], ["fingerprint"])

    sent = checkpoint(known.select("fingerprint", F.monotonically_increasing_id().alias("sender")).mapInArrow(send, code))
    answers = sent.groupBy("owner").applyInArrow(own, "from long, by int, again binary")
    told = sent.join(answers, (F.col("sender") == F.col("from")) & (F.col("owner") == F.col("by")))
    return told.select("owner", "n", "code", "again").mapInArrow(receive, "fingerprint long").distinct()


def repeated_texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, text_sha256, row) of each document, and (text_sha256, keep_id, group_size) of each text that at least two have.

    Fingerprints that only one row has are settled by the exchange (see `suspects`). The texts of the others are
    grouped by their bytes; a fingerprint that different texts share splits there.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("text"))
    whole = F.xxhash64("text")
    known = checkpoint(read.select("id", F.sha2("text", 256).alias("text_sha256"), whole.alias("hash"), F.monotonically_increasing_id().alias("row")))
    n_rows = known.count()
    bits = min(62, max(16, math.ceil(math.log2(max(2, n_rows)))) + SPARE)
    fingerprint = F.shiftrightunsigned(F.col("hash"), 64 - bits)
    senders = max(shuffle_partitions(spark), math.ceil(n_rows / SENDER_ROWS))
    owners = max(1, math.ceil(n_rows / OWNER_ROWS), min(shuffle_partitions(spark), n_rows >> 14))
    # neighbouring splits are one sender, so that messages don't get small; rows stay where they are
    found = checkpoint(suspects(known.select(fingerprint.alias("fingerprint")).coalesce(senders), bits, senders, owners, n_rows))
    fingerprint = F.shiftrightunsigned(whole, 64 - bits)
    few = found.count() * 16 <= BROADCAST_BYTES
    again = found.select(F.col("fingerprint").alias("suspect"))
    met = read.join(F.broadcast(again) if few else again, fingerprint == F.col("suspect"), "left_semi")
    groups = met.groupBy("text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.where("group_size > 1").select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    return known.select("id", "text_sha256", "row"), checkpoint(groups)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Equal texts: one row (id, keep_id, group_size, kept, text_sha256) for each document.

    Texts are equal if they are the same bytes once A-Z are lower case; null counts as empty. Of a group, the row
    with the largest id stays. Null ids come last: keep_id is null only if all ids of the group are. Of
    rows that repeat that id too, one stays. An empty table gives an empty result; other columns are not read.
    """
    known, groups = repeated_texts(docs, id_col, text_col)
    joined = checkpoint(known.join(groups, "text_sha256", "left"))
    is_keeper = F.col("group_size").isNotNull() & F.col("id").eqNullSafe(F.col("keep_id"))
    stays = joined.where(is_keeper).groupBy("text_sha256").agg(F.min("row").alias("stays"))
    alone = F.col("group_size").isNull()
    return joined.join(stays, "text_sha256", "left").select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("stays"))).alias("kept"),
        "text_sha256",
    )


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that `exact_duplicates` keeps, with all their columns and no others.

    Where rows repeat the id and the text that stay, the one whose columns have the least hash stays, in every run.
    """
    _, groups = repeated_texts(docs, id_col, text_col)
    small = groups.count() * 96 <= BROADCAST_BYTES
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), F.sha2(normalised(text_col), 256).alias("_sha"))
    marked = whole.join(F.broadcast(groups) if small else groups, whole["_sha"] == groups["text_sha256"], "left")
    single = marked.where("text_sha256 is null").select("_row")
    stays = marked.where(F.col("text_sha256").isNotNull() & F.col("_id").eqNullSafe(F.col("keep_id")))
    one = stays.groupBy("_sha").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row")).select("_row")
    return single.union(one).select("_row.*")


def op3_golomb_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all documents: see `exact_duplicates` for nulls, ties and empty tables."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE = {
    "op3_golomb_exchange": """
WITH known AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
grouped AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM known GROUP BY norm)
SELECT k.doc_id, g.keep_id, g.group_size, k.doc_id = g.keep_id AS kept, sha256(k.norm) AS text_sha256 FROM known k JOIN grouped g ON k.norm = g.norm
""",
}
