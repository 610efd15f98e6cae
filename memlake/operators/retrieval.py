"""Retrieval of records for a table of queries: text, vectors, recency, and their fusion."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlake.functions import columns as C
from memlake.operators.shared import ASKED, Sets, best_matches, best_of, meeting, query_blocks, small, sorted_items, stored

K1, B = 1.5, 0.75
RRF_K = 60
# Words that say little.
STOP_WORDS = (
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有", "看",
    "好", "自己", "这", "他", "她", "它", "们", "那", "吗", "吧", "呢", "啊", "呀", "哦", "嗯",
)


def postings(rows: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(token, id, length): a row for each different token of a text; length is how many it has."""
    t = rows.select(F.col(id_col).alias("id"), C.tokens(F.col(text_col)).alias("t"))
    return t.select(F.explode("t").alias("token"), "id", F.size("t").alias("length"))


def text_index(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings of the records that aren't retired, and how many of them have each token."""
    posts = postings(records.where("retired_reason is null"))
    return posts, posts.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def top(scored: DataFrame, k: int) -> DataFrame:
    """The best k of each query by score, then id; rank from 1. Spark limits rows by rank before they're shuffled."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25(queries: DataFrame, rows: DataFrame, k: int, id_col: str = "id", text_col: str = "content", stop_words: Sequence[str] = ()) -> DataFrame:
    """(query_id, id, score, rank): BM25 of distinct tokens for queries (query_id, query).

    Texts are tokenised once, into hashes, and written; lengths and the frequencies of the queries' tokens come from there. Queries that
    come to the same tokens once those that no text has are left out are one. A task sums scores in arrays, and only the best k of each query leave it, by
    rounded score and id. So tokens that nearly all texts have cost additions and no rows.
    """
    hashed = lambda t: F.transform(t, lambda x: F.xxhash64(x))
    indexed = stored(rows.select(F.col(id_col).cast("string").alias("id"), hashed(C.tokens(F.col(text_col))).alias("t")))
    indexed = indexed.where(F.size("t") > 0)  # of what is written: before that, the filter would tokenise once more
    wanted = hashed(F.array_except(C.tokens(F.col("query")), F.array(*map(F.lit, stop_words)).cast("array<string>")))
    asked = stored(queries.select(F.col("query_id").cast("string").alias("query_id"), F.explode(wanted).alias("token")))
    stats = indexed.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("mean")).first()
    tokens = small(stored(asked.select("token").distinct()))
    df = indexed.select(F.explode("t").alias("token")).join(tokens, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(stats["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(small(stored(df.select("token", idf.alias("idf")))), "token").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("token", "idf"))).alias("x"))
    key = F.sha2(F.array_join(F.col("x.token").cast("array<string>"), ","), 256)
    weighed = stored(weighed.select("query_id", key.alias("key"), F.col("x.token").alias("items"), F.col("x.idf").alias("weights")))
    of_query = weighed.groupBy(F.col("key").alias("id")).agg(F.first("items").alias("items"), F.first("weights").alias("weights")).withColumn("scale", F.lit(1.0))
    scale = (K1 + 1) / (1 + K1 * (1 - B + B * F.size("t") / F.lit(float(stats["mean"] or 1.0))))
    of_text = indexed.select("id", F.col("t").alias("items"), F.lit(None).cast("array<double>").alias("weights"), scale.alias("scale"))

    def score(q: Sets, sets: Sets, least: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        places, (items, owner, _) = sets.places(), sorted_items(sets)
        for first, ends, own in query_blocks(q):
            idfs = q.weights[own]
            for n, at, which in meeting(ends, q.items[own], items):
                rounded = np.floor(np.bincount(owner[at], weights=idfs[which], minlength=len(sets)) * sets.scales * 1e6 + 0.5).astype(np.int64)
                good = np.flatnonzero(rounded >= max(1, least[first + n]))
                if len(good):
                    good = good[best_of(rounded[good], places[good], k)] if len(good) > k else good
                    yield np.full(len(good), first + n), good, rounded[good]

    found = best_matches(of_query, of_text, k, score, 1e6)
    return found.withColumnRenamed("query_id", "key").join(weighed.select("query_id", "key"), "key").select("query_id", "id", "score", "rank")


def vector_search(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): exact nearest by cosine of queries (query_id, embedding) among (id, embedding).

    A stated set of queries against all rows: a matrix product gives a task's best k for each query by rounded score and id, and only
    those are shuffled. Vectors without a direction, and such with a null in them, are left out.
    """
    sets = lambda df, key: df.select(F.col(key).cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("items"), F.lit(None).cast("array<double>").alias("weights"), F.lit(0.0).alias("scale")).where("items is not null")

    def score(q: Sets, sets: Sets, least: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        places = sets.places()
        for dim, at, x in _units(sets):
            for own_dim, own, y in _units(q):
                for first in range(0, len(own) if dim == own_dim else 0, ASKED):
                    who = own[first : first + ASKED]
                    scores = y[first : first + ASKED] @ x.T
                    rounded = (np.sign(scores) * np.floor(np.abs(scores) * 1e6 + 0.5)).astype(np.int64)
                    for n, of in zip(who, rounded, strict=True):
                        good = np.flatnonzero(of >= least[n])
                        if len(good):
                            good = good[best_of(of[good], places[at[good]], k)] if len(good) > k else good
                            yield np.full(len(good), n), at[good], of[good]

    return best_matches(sets(queries, "query_id"), sets(vectors, "id"), k, score, 1e6)


def _units(sets: Sets) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, places, unit vectors) of the vectors with a direction, by dimension."""
    sizes = np.diff(sets.ends, prepend=0)
    for dim in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == dim)
        x = sets.items[np.repeat(sizes == dim, sizes)].astype(np.float64).reshape(-1, dim)
        norm = np.sqrt((x * x).sum(axis=1))
        good = np.isfinite(norm) & (norm > 0)
        yield int(dim), at[good], x[good] / norm[good, None]


def fuse(lanes: dict[str, DataFrame], k: int, wired: int | None = None) -> DataFrame:
    """Ranked lanes (query_id, id, rank from 1) in one: (query_id, id, score, lanes, rank) by reciprocal ranks.

    The score is 1 for what is first in all lanes that are wired up, whether or not they found anything.
    Ties go to the lane named first, then the rank there, then the id.
    """
    parts = [rows.select("query_id", "id", "rank", F.lit(n).alias("lane"), F.lit(name).alias("name")) for n, (name, rows) in enumerate(lanes.items())]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    total = F.round(F.sum(C.rrf_term(F.col("rank") - 1, RRF_K)) * (RRF_K + 1) / (wired or len(lanes)), 9)
    named = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("lane", "name"))), lambda x: x["name"]), ",")
    merged = every.groupBy("query_id", "id").agg(total.alias("score"), named.alias("lanes"), F.min(F.struct("lane", "rank")).alias("first"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "first.lane", "first.rank", "id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("first")


def recency_lane(lanes: Sequence[DataFrame], records: DataFrame, now: int, half_life_days: float, k: int) -> DataFrame:
    """What the lanes found, and nothing else, by age."""
    ids = lanes[0].select("query_id", "id")
    for lane in lanes[1:]:
        ids = ids.union(lane.select("query_id", "id"))
    aged = ids.distinct().join(records.select("id", "updated_ms"), "id")
    return top(aged.select("query_id", "id", F.round(C.decay_weight(F.col("updated_ms"), F.lit(now), half_life_days), 9).alias("score")), k)


def threshold(hits: DataFrame, least: float, small: int) -> DataFrame:
    """Drop what scores below a threshold; if that were all of a query's few hits, keep them."""
    own = W.partitionBy("query_id")
    rows = hits.withColumn("_any", F.max("score").over(own) >= least).withColumn("_n", F.count(F.lit(1)).over(own))
    return rows.where((F.col("score") >= least) | (~F.col("_any") & (F.col("_n") <= small))).drop("_any", "_n")


def first_lane_with_hits(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first lane's hits, and the second one's for queries of which the first has none."""
    return first.unionByName(second.join(first.select("query_id").distinct(), "query_id", "left_anti"))


def decayed(hits: DataFrame, records: DataFrame, now: int, half_life_days: float) -> DataFrame:
    """Hits in the order of score times age weight; the score stays."""
    aged = hits.join(records.select("id", "updated_ms"), "id", "left")
    key: Column = F.round(F.col("score") * C.decay_weight(F.col("updated_ms"), F.lit(now), half_life_days), 9)
    order = W.partitionBy("query_id").orderBy(key.desc(), "rank")
    return aged.withColumn("place", F.row_number().over(order)).drop("updated_ms")
