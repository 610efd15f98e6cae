"""What several operators share: the shared folder, counted broadcasts, packed blocks, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Most rows of narrow tables, and most bytes of packed blocks, that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 40_000, 32 << 20
#: Sets, or items of them, that are scored at once, queries that meet them at once, and bytes of the queries that a cell of a grid has.
SETS, ITEMS, ASKED, CELL_BYTES = 4096, 1 << 20, 256, 192 << 20
#: Most results that a task holds (it takes some 300 bytes for one while it sorts them), and most bytes that a grid shuffles.
FOUND_ROWS, SHUFFLED_BYTES = 1 << 19, 1 << 30
SET, MATCH = ("id", "items", "weights", "scale"), "query_id string, id string, score double"

Scorer = Callable[["Sets", "Sets", np.ndarray, int], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def checkpoint(df: DataFrame) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it from there from now on.

    The folder is that of spark.checkpoint.dir. Only where it is unset and Spark runs in one process (as in
    tests) is a temporary folder taken; on a cluster that is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (context.master or "").startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="memlake-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write a table as Parquet to the shared checkpoint folder and read it from there: for loops, since unlike a checkpoint the
    table read has no part of its plan's constraints, which would grow with every round."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        checkpoint(df.limit(0))
    at = f"{context.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def small(written: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for a broadcast if it has few rows."""
    return F.broadcast(written) if written.count() <= most else written


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by keys to more tasks than there are cores: for what costs much for each row, since a table of few bytes comes in few tasks however many rows it has."""
    session = rows.sparkSession
    return rows.repartition(max(int(session.conf.get("spark.sql.shuffle.partitions")), 2 * session.sparkContext.defaultParallelism), *keys)


def follow(reached: DataFrame, move: DataFrame) -> DataFrame:
    """(node, root) after the roots have moved (node, to)."""
    return reached.join(move.select(F.col("node").alias("root"), F.col("to").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each end of a link (a, b): root is the least node that links lead to.

    Every round each node moves to its least neighbour, or stays if it is less itself, and links move along; loops and repeats go.
    The first round and every fourth take the order of the nodes, which ends a star at once; the others an order by hash, new
    each time, in which chains shrink by a constant factor. It goes on until no link is left; only numbers of rows come to the driver.
    """
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    moves, turn = [], 0
    while not edges.isEmpty():
        rank = (lambda c: F.lit(0).cast("long")) if turn % 4 == 0 else (lambda c, t=turn: F.xxhash64(F.col(c), F.lit(t)))
        near = edges.union(edges.select("b", "a")).groupBy("a").agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("to"))).alias("near"))
        move = near.select(F.col("a").alias("node"), F.least(F.struct(rank("a").alias("r"), F.col("a").alias("to")), F.col("near"))["to"].alias("to"))
        move = small(stored(move))
        for _ in range(2):  # a node that moves to one that moves goes on with it
            move = follow(move.withColumnRenamed("to", "root"), move).withColumnRenamed("root", "to")
        move = small(stored(move))
        moves.append(move)
        ends = edges.join(move.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(move.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = stored(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        turn += 1
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

    reached = stored(reduce(follow, moves[1:], moves[0].select("node", F.col("to").alias("root"))))
    least = reached.groupBy("root").agg(F.min("node").alias("least"))
    return reached.join(least, "root").select("node", F.col("least").alias("root"))


def containing(texts: DataFrame, words: DataFrame, n: int = 3) -> DataFrame:
    """(id, word): which texts (id, hay) contain which words (word), as runs of characters.

    The different runs of up to n characters of a text meet the beginnings of the words, and what meets is looked up in full.
    """
    heads = words.select("word").where("word <> ''").distinct().withColumn("head", F.substring("word", 1, n))
    runs = lambda k: F.when(F.length("hay") >= k, F.transform(F.sequence(F.lit(1), F.length("hay") - k + 1), lambda i: F.substring("hay", i, F.lit(k))))
    every = F.array_distinct(F.flatten(F.filter(F.array(*map(runs, range(1, n + 1))), lambda x: x.isNotNull())))
    met = texts.select("id", F.explode(every).alias("head")).join(heads, "head").select("id", "word")
    return met.join(texts.select("id", "hay"), "id").where(F.contains("hay", F.col("word"))).select("id", "word")


class Sets:
    """Arrow columns (id, items, weights, scale) as arrays; the items and weights of a set end at its `ends` and `w_ends`."""

    def __init__(self, table: pa.Table | pa.RecordBatch):
        whole = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        ids, items, weights, scales = (whole(table.column(n)) for n in SET)
        self.ids, self.scales = ids, scales.to_numpy(zero_copy_only=False)
        self.items, self.ends = items.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.diff(np.asarray(items.offsets, dtype=np.int64)))
        self.weights = weights.flatten().to_numpy(zero_copy_only=False) if weights.null_count < len(weights) else np.zeros(0)

    def __len__(self) -> int:
        return len(self.ids)

    def places(self) -> np.ndarray:
        """Where each id comes in Spark's order of text, nulls first."""
        places = np.empty(len(self), dtype=np.int64)
        places[pc.sort_indices(self.ids, null_placement="at_start").to_numpy()] = np.arange(len(self))
        return places


class _Best:
    """The best k of each of n queries among what a task has seen, by score, then id; `least` is what a further one must reach."""

    def __init__(self, n: int, k: int):
        self.k, self.least, self.parts, self.rows, self.kept = k, np.full(n, -(2**62), dtype=np.int64), [], 0, 0

    def add(self, who: np.ndarray, scores: np.ndarray, ids: pa.Array) -> None:
        self.parts.append(pa.table({"who": who, "score": scores, "id": ids}))
        self.rows += len(who)
        if self.rows > max(1 << 18, 2 * self.kept):
            self.settle()

    def settle(self) -> None:
        rows = pa.concat_tables(self.parts)
        rows = rows.take(pc.sort_indices(rows, [("who", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start"))
        who = rows["who"].to_numpy()
        place = np.arange(len(who)) - np.searchsorted(who, who, "left")
        last = place == self.k - 1
        self.least[who[last]] = rows["score"].to_numpy()[last]
        rows = rows.filter(pa.array(place < self.k))
        self.parts, self.rows, self.kept = [rows.combine_chunks()], len(rows), len(rows)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of SETS rows or so many items at most, or one row."""
    ends = np.cumsum(np.diff(np.asarray(batch.column("items").offsets, dtype=np.int64)))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = min(start + SETS, batch.num_rows, max(start + 1, int(np.searchsorted(ends, before + ITEMS, "right"))))
        yield batch.slice(start, stop - start)
        start = stop


def best_matches(asked: DataFrame, rows: DataFrame, k: int, score: Scorer, unit: float) -> DataFrame:
    """(query_id, id, score, rank): the best k rows of each query by score, then id. Both sides are (id, items, weights, scale).

    A stated set of queries against all rows. A task has some queries, takes the rows by as they come and keeps only the best k of each query, so it returns no pairs.
    `score` gives, for the queries and a slice of rows, (query, rows, whole scores of these) of rows that may be among the best; a score counts `unit`.
    A few queries are broadcast and the rows stay where they are. Many are dealt to the cells of a grid with parts of the rows on its other side. A cell's
    queries have CELL_BYTES and FOUND_ROWS results at most; of the grids that do, and use the cores, the one that shuffles least is taken, each side as often as its other side
    has parts. Where that is more than SHUFFLED_BYTES, nothing is shuffled but results: rows are written once, and read once for each broadcast of some of the queries.
    """
    asked, context = stored(asked), rows.sparkSession.sparkContext
    n_bytes = lambda name: F.coalesce(8 * F.size(name), F.lit(0))

    def measured(sets: DataFrame) -> tuple[int, int]:
        row = sets.agg(F.sum(n_bytes("items") + n_bytes("weights") + F.coalesce(F.octet_length("id"), F.lit(0)) + 24).alias("b"), F.count(F.lit(1)).alias("n")).first()
        return row["b"] or 0, row["n"]

    size, n_asked = measured(asked)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def task(held: pa.Table | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours, queries, best = [], None if held is None else Sets(held), None
        for batch in batches:
            if queries is None:  # of a cell, the queries come first
                n = int(np.searchsorted(batch.column("side").to_numpy(), 1))
                ours.append(batch.slice(0, n).select(SET))
                batch = batch.slice(n)
                if not batch.num_rows:
                    continue
                queries, ours = Sets(pa.Table.from_batches(ours)), []
            best = best or _Best(len(queries), k)
            for part in _slices(batch):
                sets = Sets(part)
                for who, at, scores in score(queries, sets, best.least, k):
                    best.add(who, scores, sets.ids.take(pa.array(at)))
        if best is not None and best.rows:
            best.settle()
            for part in best.parts[0].to_batches(max_chunksize=100_000):
                who = queries.ids.take(part.column("who"))
                yield pa.RecordBatch.from_arrays([who, part.column("id"), pa.array(part.column("score").to_numpy() * 1.0 / unit)], ["query_id", "id", "score"])

    def against(some: DataFrame, rows: DataFrame) -> tuple[Broadcast, DataFrame]:
        sent = context.broadcast(some.select(*SET).toArrow())
        return sent, rows.select(*SET).mapInArrow(lambda batches: task(sent.value, batches), MATCH)

    if size <= BROADCAST_BYTES and n_asked * k <= FOUND_ROWS:
        return best(against(asked, rows)[1])
    rows = stored(rows)
    theirs_size, cores = measured(rows)[0], context.defaultParallelism
    least = max(1, -(-size // CELL_BYTES), -(-n_asked * k // FOUND_ROWS))
    grids = [(d, max(1, -(-2 * cores // d))) for d in range(least, max(least, 2 * cores) + 1)]
    down, across = min(grids, key=lambda g: g[0] * theirs_size + g[1] * size)
    if down * theirs_size + across * size <= SHUFFLED_BYTES:
        dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        ours = asked.select(*SET, F.lit(0).alias("side"), dealt(down).alias("down"), every(across).alias("across"))
        theirs = rows.select(*SET, F.lit(1).alias("side"), every(down).alias("down"), dealt(across).alias("across"))
        both = ours.union(theirs).select(*SET, "side", (F.col("down") * across + F.col("across")).cast("int").alias("cell"))
        cells = both.repartitionById(down * across, F.col("cell")).sortWithinPartitions("side").drop("cell")
        return best(cells.mapInArrow(lambda batches: task(None, batches), MATCH))
    turns, found = max(1, -(-size // max(1, BROADCAST_BYTES)), -(-n_asked * k // FOUND_ROWS)), []
    for turn in range(turns):
        some = asked.where(F.pmod(F.xxhash64("id"), F.lit(turns)) == turn)
        sent, those = against(some, rows.coalesce(2 * cores))  # few tasks, since each returns results of every query
        found.append(stored(best(those)))
        sent.destroy()
    return reduce(DataFrame.unionByName, found)


def best_of(scores: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """The k rows of the highest scores, ties by place: one whole number says both."""
    most = min(k, len(scores))
    return np.argpartition(places - scores * (int(places.max()) + 1), most - 1)[:most]


def query_blocks(queries: Sets) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Queries in blocks of ASKED: (the first one, where the sets of the block end in its items, where its items lie among all)."""
    for first in range(0, len(queries), ASKED):
        ends = queries.ends[first : first + ASKED]
        start = queries.ends[first - 1] if first else 0
        yield first, ends - start, np.arange(start, ends[-1])


def sorted_items(sets: Sets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The items of sets in order, the sets that they are of, and where they were."""
    order = np.argsort(sets.items, kind="stable")
    return sets.items[order], np.repeat(np.arange(len(sets)), np.diff(sets.ends, prepend=0))[order], order


def meeting(q_ends: np.ndarray, q_items: np.ndarray, items: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query that has items in common with sorted ones: (query, their places there, the query items' places), a pair for each common item."""
    low, high = np.searchsorted(items, q_items, "left"), np.searchsorted(items, q_items, "right")
    begins = np.concatenate([[0], q_ends[:-1]])
    for q, (a, b) in enumerate(zip(begins, q_ends, strict=True)):
        n = high[a:b] - low[a:b]
        total = int(n.sum())
        if total:
            which = np.repeat(np.arange(a, b), n)
            at = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + low[which]
            yield q, at, which
