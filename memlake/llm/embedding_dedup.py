"""Near-duplicate embeddings: randomised-rotation binary codes, and exact recomputation of what they leave open."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import checkpoint, table
from memlake.llm.components import components

#: Vectors of a bucket, at least, as planned; vectors of a bucket that are compared in one task, beyond which it is split
#: in blocks; vectors of small buckets that share a task; and rows of a matrix product.
BUCKET, BLOCK, TASK, TILE = 1024, 1 << 14, 1 << 14, 2048
#: Width of the confidence bounds, in standard deviations of the estimate.
EPSILON = 4.0
#: Most bytes of row keys that are broadcast, and what one takes in memory; more are joined by a shuffle.
BROADCAST_BYTES, ROW_BYTES = 8 << 20, 192


@functools.cache
def rotations(dim: int, count: int, seed: int) -> np.ndarray:
    """Random rotations of this many dimensions, one below the other."""
    draw = np.random.default_rng([seed, dim])
    return np.concatenate([np.linalg.qr(draw.standard_normal((dim, dim)))[0] for _ in range(count)])


def unit(vectors: np.ndarray) -> np.ndarray:
    """The vectors at length 1, in double precision."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def encode(units: np.ndarray, rotation: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """What is exchanged of each vector: (codes, numbers).

    codes has, in bytes, the signs after the rotation, and the rotated vector in 4 bits a component, rounded up or
    down at random so that it is right on the average. numbers has the correction factor (the inner product of
    the sign code with its vector), and the least value and the step of the 4 bits.
    """
    turned = units @ rotation.T
    low = turned.min(axis=1)
    step = (turned.max(axis=1) - low) / 15.0
    scaled = (turned - low[:, None]) / np.where(step > 0, step, 1.0)[:, None]
    levels = np.minimum(np.floor(scaled + draw.random(scaled.shape)), 15).astype(np.uint8)
    if levels.shape[1] % 2:
        levels = np.concatenate([levels, np.zeros((len(levels), 1), dtype=np.uint8)], axis=1)
    codes = np.concatenate([np.packbits(turned > 0, axis=1), levels[:, ::2] << 4 | levels[:, 1::2]], axis=1)
    factors = np.abs(turned).sum(axis=1) / math.sqrt(units.shape[1])
    return codes, np.stack([factors, low, step], axis=1).astype(np.float32)


def decode(codes: np.ndarray, numbers: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The sign codes as vectors of length 1, and the rotated vectors as far as 4 bits tell."""
    split = -(-dim // 8)
    signs = (np.unpackbits(codes[:, :split], axis=1)[:, :dim].astype(np.float32) * 2 - 1) / np.float32(math.sqrt(dim))
    nibbles = codes[:, split:]
    levels = np.stack([nibbles >> 4, nibbles & 15], axis=2).reshape(len(codes), -1)[:, :dim]
    return signs, numbers[:, 1:2] + numbers[:, 2:3] * levels.astype(np.float32)


def may_link(turned: np.ndarray, steps: np.ndarray, signs: np.ndarray, factors: np.ndarray, cosine: float) -> np.ndarray:
    """For each query (turned, in 4 bits) and code: whether the confidence bound leaves room for the cosine.

    The code's inner product with the query over its factor is an unbiased estimate of the cosine. Its spread, for a pair
    at the limit, comes from what the code lacks of its vector and from the rounding of the query.
    """
    dim = turned.shape[1]
    f = np.clip(factors, 1e-6, 1.0)
    lacking = np.sqrt((1 - cosine * cosine) * (1 - f * f) / max(1, dim - 1)) / f
    rounding = steps[:, None] / 2 / f[None, :]
    return (turned @ signs.T) / f[None, :] + np.float32(EPSILON) * (lacking[None, :] + rounding) >= cosine - 1e-5


def plan(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """Bits of a bucket's key and number of tables, so that a pair at the limit shares a bucket with this probability.

    Buckets grow with the root of the number of vectors, which codes can afford: 11 tables at 50,000 vectors, about 60 at 10^9.
    """
    bits = max(1, round(math.log2(max(2.0, n / max(BUCKET, math.sqrt(n) / 2)))))
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, 1 if together >= recall else math.ceil(math.log(1 - recall) / math.log(1 - together))


def usable(vector: Column) -> Column:
    """Vectors that have a direction: finite components, one of them not zero."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(whole, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _coded(classes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """(id, dim, code, packed, keys): code and its numbers in one, and the bucket key in each table, packed and as numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            lengths = np.diff(np.asarray(lists.offsets))
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                part = batch.take(pa.array(at))
                x = unit(part.column(1).flatten().to_numpy().reshape(len(at), dim))
                turns = rotations(int(dim), 1 + -(-bits * tables // int(dim)), seed)
                codes, numbers = encode(x, turns[:dim], np.random.default_rng([seed, int(dim), len(at)]))
                whole = np.concatenate([codes, numbers.view(np.uint8).reshape(len(at), 12)], axis=1)
                signs = (x @ turns[dim : dim + bits * tables].T > 0).reshape(len(at), tables, bits)
                keys = (signs.astype(np.int64) << np.arange(bits)).sum(axis=2)
                packed = np.packbits(signs.reshape(len(at), -1), axis=1)
                offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * tables)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.full(len(at), dim, dtype=np.int32)), pa.array([c.tobytes() for c in whole], pa.binary()), pa.array([c.tobytes() for c in packed], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)))],
                    ["id", "dim", "code", "packed", "keys"],
                )

    return classes.select("id", "embedding").mapInArrow(run, "id long, dim int, code binary, packed binary, keys array<long>")


def _keys(packed: pa.ChunkedArray, bits: int, tables: int) -> np.ndarray:
    """The bucket key of each row in each table."""
    rows = packed.to_pylist()
    signs = np.unpackbits(np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), -1), axis=1)[:, : bits * tables].reshape(len(rows), tables, bits)
    return (signs.astype(np.int64) << np.arange(bits)).sum(axis=2)


def _tiles(key: np.ndarray, first: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Tiles (rows, columns, whether they are the same) of all pairs with the same key, of different blocks if `first` tells which."""
    order = np.argsort(key, kind="stable")
    edges = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
    for start, end in zip(edges, np.append(edges[1:], len(order)), strict=True):
        own = order[start:end]
        one, two = (own, own) if first is None else (own[first[own]], own[~first[own]])
        for i in range(0, len(one), TILE):
            for j in range(i if first is None else 0, len(two), TILE):
                yield one[i : i + TILE], two[j : j + TILE], first is None and i == j


def _new_here(keys: np.ndarray, turn: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs share a bucket in no table before this one."""
    new = np.ones(len(a), dtype=bool)
    for start in range(0, len(a) if turn else 0, 1 << 16):
        part = slice(start, start + (1 << 16))
        new[part] = ~(keys[a[part], :turn] == keys[b[part], :turn]).any(axis=1)
    return new


def buckets(coded: DataFrame) -> DataFrame:
    """A row for each vector and table: the task that compares it (dim, turn, cell, low, high), whether it is of the task's first block, and its code."""
    cells = max(1, coded.count() // TASK)
    rows = coded.select("id", "dim", "code", "packed", F.posexplode("keys").alias("turn", "key"))
    crowded = rows.groupBy("dim", "turn", "key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK)
    crowded = checkpoint(crowded.select("dim", "turn", "key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))
    n = crowded.count()
    if n:
        rows = rows.join(F.broadcast(crowded) if n * ROW_BYTES <= BROADCAST_BYTES else crowded, ["dim", "turn", "key"], "left")
    else:
        rows = rows.withColumn("blocks", F.lit(None).cast("int"))
    rows = rows.withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("cell", F.when(F.col("blocks") > 1, F.col("key") + cells).otherwise(F.pmod(F.xxhash64("key"), F.lit(cells))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return rows.select("dim", "turn", "cell", low.alias("low"), high.alias("high"), (F.col("block") == low).alias("first"), "id", "code", "packed")


TASK_KEYS = ("dim", "turn", "cell", "low", "high")


def open_rows(rows: DataFrame, bits: int, tables: int, cosine: float) -> DataFrame:
    """The rows (of `buckets`, without codes) that have a partner in their bucket which the bounds leave open, and no bucket before has."""

    def screen(group: pa.Table) -> pa.Table:
        dim, turn = group["dim"][0].as_py(), group["turn"][0].as_py()
        keys, first = _keys(group["packed"], bits, tables), group["first"].to_numpy()
        raw = np.frombuffer(b"".join(group["code"].to_pylist()), dtype=np.uint8).reshape(len(keys), -1)
        numbers = np.ascontiguousarray(raw[:, -12:]).view(np.float32)
        flagged = np.zeros(len(keys), dtype=bool)
        apart = first if group["low"][0].as_py() != group["high"][0].as_py() else None
        for one, two, same in _tiles(keys[:, turn], apart):
            _, turned = decode(raw[one, :-12], numbers[one], dim)
            signs, _ = decode(raw[two, :-12], numbers[two], dim)
            a, b = np.nonzero(may_link(turned, numbers[one, 2], signs, numbers[two, 0], cosine))
            if same:
                a, b = a[a < b], b[a < b]
            a, b = one[a], two[b]
            for start in range(0, len(a), 1 << 16):
                x, y = a[start : start + (1 << 16)], b[start : start + (1 << 16)]
                some = ~(flagged[x] & flagged[y])  # what both ends have been told already needs no test
                x, y = x[some], y[some]
                new = _new_here(keys, turn, x, y)
                flagged[x[new]] = flagged[y[new]] = True
        return group.filter(pa.array(flagged)).select([*TASK_KEYS, "first", "id"])

    return rows.groupBy(*TASK_KEYS).applyInArrow(screen, "dim int, turn int, cell long, low int, high int, first boolean, id long")


def exact_links(rows: DataFrame, bits: int, tables: int, cosine: float) -> DataFrame:
    """What the open rows' vectors give in double precision: (id, to, n), either n more vectors linked to id, or a link to keep together.

    A pair that shares several buckets counts in the first table only. No pairs are emitted: a task returns a count
    for each row and the links of a spanning forest.
    """

    def compare(group: pa.Table) -> pa.Table:
        dim, turn = group["dim"][0].as_py(), group["turn"][0].as_py()
        ids, sizes, keys, first = group["id"].to_numpy(), group["size"].to_numpy(), _keys(group["packed"], bits, tables), group["first"].to_numpy()
        x = unit(group["embedding"].combine_chunks().flatten().to_numpy().reshape(len(ids), dim))
        counts, root = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
        apart = first if group["low"][0].as_py() != group["high"][0].as_py() else None
        for one, two, same in _tiles(keys[:, turn], apart):
            a, b = np.nonzero(x[one] @ x[two].T >= cosine)
            if same:
                a, b = a[a < b], b[a < b]
            a, b = one[a], two[b]
            new = _new_here(keys, turn, a, b)
            a, b = a[new], b[new]
            np.add.at(counts, a, sizes[b])
            np.add.at(counts, b, sizes[a])
            while len(a) and (root[a] != root[b]).any():
                least = np.minimum(root[a], root[b])
                np.minimum.at(root, root[a], least)
                np.minimum.at(root, root[b], least)
                root = root[root]
        some, joined = np.flatnonzero(counts), np.flatnonzero(root != np.arange(len(ids)))
        return pa.table({"id": np.concatenate([ids[some], ids[joined]]), "to": pa.array([None] * len(some) + ids[root[joined]].tolist(), pa.int64()), "n": np.concatenate([counts[some], np.zeros(len(joined), dtype=np.int64)])})

    return rows.groupBy(*TASK_KEYS).applyInArrow(compare, "id long, to long, n long")


def embedding_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, recall: float = 0.995, seed: int = 5) -> DataFrame:
    """Links of cosine `cosine` or more: one row (id, n_links, component_id, kept) for each vector.

    Equal vectors are compared once. The others fall, in each of several tables, into buckets by signs after random
    rotations; as many tables as it takes for a pair just at the limit to share a bucket with probability `recall`
    (for closer pairs it is higher still). Buckets exchange no vectors: a binary code with its correction factor and
    the rotated vector in 4 bits a component give an unbiased estimate of every cosine and a confidence bound.
    Vectors with a pair that may reach the limit then go to that bucket's task, once for the first table that has the pair,
    and are recomputed in double precision, so no link is below it. Buckets of many thousands are split in blocks.

    n_links counts rows, equal vectors included; component_id is the smallest id that links lead to; kept is whether
    that is the row's own. Null, empty and zero vectors and those with null or non-finite components link with
    nothing, and vectors of different lengths don't link. Null ids come last in a component, and a row without one
    that links with nothing has a null component_id. Rows that repeat an id each count. An empty table gives an
    empty result; other columns are not read.
    """
    rows = vectors.select(F.col(id_col).alias("vec"), F.col(vector_col).alias("embedding"))
    rows = rows.withColumn("embedding", F.when(usable(F.col("embedding")), F.col("embedding")))
    rows = checkpoint(rows.withColumns({"one": F.xxhash64("embedding"), "two": F.xxhash64(F.lit(seed), "embedding")}))
    same = rows.where("embedding is not null").groupBy("one", "two")
    classes = same.agg(F.first("embedding").alias("embedding"), F.min("vec").alias("least"), F.count(F.lit(1)).alias("size"))
    classes = checkpoint(classes.withColumn("id", F.monotonically_increasing_id()))
    bits, tables = plan(classes.count(), cosine, recall)
    coded = checkpoint(_coded(classes, bits, tables, seed))
    flagged = checkpoint(open_rows(buckets(coded), bits, tables, cosine))
    asked = checkpoint(flagged.select("id").distinct())
    few = asked.count() * ROW_BYTES <= BROADCAST_BYTES
    asked = F.broadcast(asked) if few else asked
    exact = classes.select("id", "embedding", "size").join(asked, "id", "left_semi").join(coded.select("id", "packed").join(asked, "id", "left_semi"), "id")
    found = checkpoint(exact_links(flagged.join(exact, "id"), bits, tables, cosine))
    counts = found.where("to is null").groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(found.where("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b")))
    named = classes.select("one", "two", "least", "size", "id").join(counts, "id", "left").join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    named = checkpoint(named.select("one", "two", "least", "root", (F.coalesce("n", F.lit(0).cast("long")) + F.col("size") - 1).alias("n_links")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = named.join(least, "root").select(F.col("one").alias("of"), F.col("two").alias("of_two"), "n_links", "component_id")
    small = named.count() * ROW_BYTES <= BROADCAST_BYTES
    told = rows.select("vec", "one", "two", F.col("embedding").isNull().alias("plain")).join(F.broadcast(known) if small else known, (F.col("one") == F.col("of")) & (F.col("two") == F.col("of_two")) & ~F.col("plain"), "left")
    component = F.when(F.col("of").isNull(), F.col("vec")).otherwise(F.col("component_id"))
    return told.select(F.col("vec").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec").eqNullSafe(component).alias("kept"))


def op9_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.9: see `embedding_duplicates` for vectors that link with nothing."""
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))
