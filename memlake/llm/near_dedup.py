"""Near-duplicate texts: ProbMinHash sketches, banding, and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import checkpoint, table, text_or_empty
from memlake.llm.components import components
from memlake.llm.words import MIX, distinct_by_text, mixed, shingles, step

#: Counters of shingle frequencies that order the shingles of a text; their number bounds what is broadcast.
COUNTERS, BLOCK = 1 << 20, 1 << 12
#: Texts that are sketched together, and sets whose shingles are ordered together.
ROWS = 512
#: Most bytes of row keys that are broadcast, and what one takes in memory; more are joined by a shuffle.
BROADCAST_BYTES, ROW_BYTES = 8 << 20, 192


def prob_minhash(values: np.ndarray, weights: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """ProbMinHash signatures (texts x size) of weighted sets; texts without values have all zeros.

    The copies of an element arrive as a Poisson process whose rate is its weight, each at a register that
    is uniform; all comes from the element's hash. A register keeps its first arrival. An element
    stops as soon as its next arrival is later than the last of its text's registers, since then no later one
    can matter. Two registers agree with a probability that is the probability Jaccard similarity.
    """
    texts = len(bounds) - 1
    owner = np.repeat(np.arange(texts), np.diff(bounds))
    first = np.full(texts * size, np.inf)
    holder = np.zeros(texts * size, dtype=np.uint64)
    now, going, turn = np.zeros(len(values)), np.arange(len(values)), 0
    while len(going):
        turn += 1
        draw = mixed(values[going] + step(turn))
        gap = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / weights[going]
        now[going] += gap
        at, who = now[going], owner[going]
        register = who * size + (mixed(draw) % np.uint64(size)).astype(np.int64)
        np.minimum.at(first, register, at)
        won = first[register] == at
        holder[register[won]] = values[going[won]]
        last = first.reshape(texts, size).max(axis=1)
        going = going[at < last[who]]
    return holder.reshape(texts, size)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of `rows` registers; the band's number is part of it."""
    texts, size = signature.shape
    parts = signature.reshape(texts, size // rows, rows)
    key = np.broadcast_to(np.arange(size // rows, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(rows):
        key = mixed(key * MIX[2] + parts[:, :, r])
    return key


def text_keys(values: np.ndarray, counts: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The band keys of each text, and where each text's begin: those of weight 1, and those of weight 1 + ln(count) that differ.

    Bands of weight 1 agree as the plain Jaccard similarity says, however often shingles repeat. Both kinds come from the same
    arrivals and share their keys, so a text in which no shingle repeats has one kind only.
    """
    size, texts = bands * rows, len(bounds) - 1
    plain = band_keys(prob_minhash(values, np.ones(len(values)), bounds, size), rows)
    keys, wanted = np.concatenate([plain, plain], axis=1), np.zeros((texts, 2 * bands), dtype=bool)
    wanted[:, :bands] = True
    text = np.repeat(np.arange(texts), np.diff(bounds))
    again = np.unique(text[counts > 1])
    if len(again):
        at = np.isin(text, again)
        ends = np.concatenate([[0], np.cumsum(np.diff(bounds)[again])])
        keys[again, bands:] = band_keys(prob_minhash(values[at], 1.0 + np.log(counts[at]), ends, size), rows)
        wanted[:, bands:] = keys[:, bands:] != plain
    return keys[wanted], np.concatenate([[0], np.cumsum(wanted.sum(axis=1))])


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """(id, text_hash, set_id, keys) of each document: set_id is a digest of its set of shingles (null if it has no word)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                found, bounds = shingles(batch.column(2), width)
                values, counts, bounds = distinct_by_text(found, bounds)
                keys, ends = text_keys(values, counts, bounds, bands, rows)
                ids = [xxhash.xxh3_128_digest(values[a:b].tobytes()) if b > a else None for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys.view(np.int64)))], ["id", "text_hash", "set_id", "keys"])

    read = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("text_hash"), text_or_empty(text_col).alias("text"))
    return read.mapInArrow(run, f"id {kind}, text_hash long, set_id binary, keys array<long>")


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(set_id, shingles) of rows (set_id, text): the different shingles, ascending as signed numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                values, _, bounds = distinct_by_text(*shingles(batch.column(1), width))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))], ["set_id", "shingles"])

    return texts.mapInArrow(run, "set_id binary, shingles array<long>")


def frequencies(sets: DataFrame) -> np.ndarray:
    """How many sets have a shingle with this hash, for COUNTERS hashes: packed in blocks before they come to the driver."""
    counted = sets.select(F.explode("shingles").alias("s")).groupBy(F.col("s").bitwiseAND(COUNTERS - 1).alias("at")).agg(F.count(F.lit(1)).alias("n"))

    def pack(rows: pa.Table) -> pa.Table:
        at = rows["at"].to_numpy()
        counts = np.zeros(BLOCK, dtype=np.int32)
        counts[at % BLOCK] = np.minimum(rows["n"].to_numpy(), 2**31 - 1)
        return pa.table({"block": [int(at[0]) // BLOCK], "counts": [counts.tobytes()]})

    counters = np.zeros((COUNTERS // BLOCK, BLOCK), dtype=np.int32)
    for row in counted.groupBy(F.shiftright("at", BLOCK.bit_length() - 1)).applyInArrow(pack, "block long, counts binary").collect():
        counters[row["block"]] = np.frombuffer(row["counts"], dtype=np.int32)
    return counters.reshape(-1)


def prefixes(sets: DataFrame, counters: np.ndarray, similarity: float) -> DataFrame:
    """(shingle, id, pos, n): the rarest shingles of each set, as many as a partner at this similarity can't all lack.

    Rare is what counts least in a table of hashed frequencies. Any order that all sets share makes this
    exact; a good one makes it cheap, as shingles which many texts share come last.
    """
    frequency = sets.sparkSession.sparkContext.broadcast(counters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                lists = batch.column(1)
                values = lists.flatten().to_numpy()
                bounds = np.asarray(lists.offsets, dtype=np.int64)
                bounds = bounds - bounds[0]
                n = np.diff(bounds)
                owner = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((values, frequency.value[values & (COUNTERS - 1)], owner))
                pos = np.arange(len(values)) - bounds[owner]
                short = pos < (n - np.ceil(similarity * n - 1e-9) + 1)[owner]
                who = owner[short]
                yield pa.RecordBatch.from_arrays([pa.array(values[order][short]), batch.column(0).take(pa.array(who)), pa.array(pos[short].astype(np.int32)), pa.array(n[who].astype(np.int32))], ["shingle", "id", "pos", "n"])

    return sets.select("id", "shingles").mapInArrow(run, "shingle long, id long, pos int, n int")


def _may_link(a: str, b: str, similarity: float) -> Column:
    """Whether sizes and places leave room for the similarity of two sets with this shingle in both prefixes."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    shared = 1 + F.least(n_a - F.col(f"{a}.pos"), n_b - F.col(f"{b}.pos")) - 1
    return (F.least(n_a, n_b) >= similarity * F.greatest(n_a, n_b) - 1e-6) & (shared >= similarity / (1 + similarity) * (n_a + n_b) - 1e-6)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are that similar: the exact Jaccard similarity."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("in_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("in_b"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("in_a", "in_b"))
    return both.where(shared >= F.lit(similarity) * (F.size("in_a") + F.size("in_b") - shared) - 1e-9).select("a", "b")


def links(sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Verified links that hold together all sets (id, shingles) which any links of this similarity do.

    Of the sets with a shingle in common in their prefixes, one is the hub: the one in which it comes first, so
    the one with the fewest rare shingles. Each set is verified against the hubs of its shingles; among
    thousands of copies of a text that joins nearly all of them without their pairs. A link that is still
    missing has an end outside its hub's component, and the other outside its own: only those
    pairs are made and verified then, if sizes and places leave room for the similarity.
    """
    rows = checkpoint(prefixes(sets, frequencies(sets), similarity))
    hubs = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("pos", "n", "id")).alias("h")).where("members > 1")
    hubs = checkpoint(hubs.select("shingle", "members", "h.pos", "h.n", "h.id"))
    near = rows.alias("m").join(hubs.alias("h"), "shingle").where((F.col("m.id") != F.col("h.id")) & _may_link("m", "h", similarity))
    pairs = near.select(F.least("m.id", "h.id").alias("a"), F.greatest("m.id", "h.id").alias("b")).distinct()
    found = checkpoint(verified(pairs, sets, similarity))
    roots = checkpoint(components(found))
    if hubs.where("members > 2").isEmpty():
        return found, roots
    of = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    named = rows.join(hubs.where("members > 2").select("shingle", F.col("id").alias("hub")), "shingle")
    named = named.join(of("id"), "id", "left").join(of("hub"), "hub", "left")
    named = checkpoint(named.select("shingle", "id", "pos", "n", F.coalesce("id_root", "id").alias("root"), F.coalesce("hub_root", "hub").alias("hub_root")))
    out, member = named.where("root <> hub_root").alias("o"), named.alias("m")
    open_pairs = out.join(member, (F.col("o.shingle") == F.col("m.shingle")) & (F.col("o.root") != F.col("m.root")) & _may_link("o", "m", similarity))
    more = open_pairs.select(F.least("o.id", "m.id").alias("a"), F.greatest("o.id", "m.id").alias("b")).distinct()
    more = checkpoint(verified(more, sets, similarity))
    if more.isEmpty():
        return found, roots
    found = checkpoint(found.union(more))
    return found, checkpoint(components(found))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, bands: int = 32, rows: int = 4) -> DataFrame:
    """The class of each document: one row (id, text_hash, class_id, class_size, kept).

    Texts are near-duplicates if the Jaccard similarity of their sets of `width`-word shingles (words
    are runs without white space, lower-cased) is `similarity` or more; classes are what such links connect, with equal
    sets in one class. class_id is the smallest id of a class, and its row is kept (of several texts with that id, one). ProbMinHash
    sketches fall into bands twice: a shingle weighs 1, and 1 + ln(its count). A text that shares a band with no
    other is alone. Bands of weight 1 agree by the similarity that is verified, so at 0.8 a link is missed at most
    once in 20 million for 32 bands of 4, whatever repeats; the others only add candidates. Texts that do share
    a band are verified exactly: see `links`.

    Null texts count as empty; a text without words is alone in its class. A text of fewer than `width`
    words is one shingle. Null ids come last: they name a class only if all its ids are null. Rows that repeat id
    and text are one document and are kept or dropped together. An empty table gives an empty result; other
    columns are not read.
    """
    known = checkpoint(sketches(docs, id_col, text_col, width, bands, rows).withColumn("row", F.monotonically_increasing_id()))
    filled = known.where("set_id is not null")
    one_each = filled.groupBy("set_id").agg(F.min("row").alias("row"))
    banded = filled.join(one_each, ["set_id", "row"]).select("set_id", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    partnered = banded.join(shared, "key").select("set_id").distinct()
    wanted = filled.join(one_each, ["set_id", "row"]).join(partnered, "set_id").select("set_id", F.col("id").alias("want_id"), F.col("text_hash").alias("want_hash"))
    wanted = checkpoint(wanted)
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    small = wanted.count() * ROW_BYTES <= BROADCAST_BYTES
    met = texts.join(F.broadcast(wanted) if small else wanted, texts["text_hash"].eqNullSafe(wanted["want_hash"]) & texts["id"].eqNullSafe(wanted["want_id"]))
    sets = shingle_sets(met.select("set_id", "text"), width).dropDuplicates(["set_id"])
    sets = checkpoint(sets.withColumn("id", F.monotonically_increasing_id()))
    _, roots = links(sets, similarity)
    rooted = sets.select("set_id", "id").join(roots, F.col("id") == F.col("node")).select("set_id", "root")
    classed = known.join(rooted, "set_id", "left").select(
        "id",
        "text_hash",
        F.when(F.col("root").isNotNull(), F.concat(F.lit("r"), F.col("root").cast("string"))).when(F.col("set_id").isNotNull(), F.hex("set_id")).otherwise(F.concat(F.lit("e"), F.col("row").cast("string"))).alias("class"),
    )
    classed = checkpoint(classed)
    first = F.min(F.struct(F.col("id").isNull(), F.col("id").alias("id"), F.col("text_hash").alias("text_hash")))
    # only classes of several rows are joined; written first, so that Spark can split a large one's rows among tasks
    classes = checkpoint(classed.groupBy("class").agg(first.alias("first"), F.count(F.lit(1)).alias("class_size")).where("class_size > 1"))
    alone = F.col("class_size").isNull()
    is_first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.text_hash"))
    return classed.join(classes, "class", "left").select(
        F.col("id").alias(id_col),
        "text_hash",
        F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        (alone | is_first).alias("kept"),
    )


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that `near_duplicates` keeps, with all their columns and no others."""
    gone = checkpoint(near_duplicates(docs, id_col, text_col, **options).where("not kept").select(F.col(id_col).alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct())
    small = gone.count() * ROW_BYTES <= BROADCAST_BYTES
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text_or_empty(text_col)).alias("_hash"))
    same = (F.col("_hash") == F.col("gone_hash")) & F.col("_id").eqNullSafe(F.col("gone_id"))
    return whole.join(F.broadcast(gone) if small else gone, same, "left_anti").select("_row.*")


def op5_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: see `near_duplicates` for nulls, short texts and repeated rows."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")
