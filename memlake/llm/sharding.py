"""Sharding by weighted rendezvous hashing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memlake.llm.common import checkpoint, table, text_or_empty


def _bid(key: Column, shard: int, weight: float) -> Column:
    """What a shard bids for a key: the key goes to the lowest -ln(u) / weight, u in (0, 1) a hash of both."""
    bits = F.shiftrightunsigned(F.xxhash64(F.concat(key, F.lit(f"@{shard}"))), 11)
    return F.struct((-F.log((bits.cast("double") + 0.5) / F.lit(float(2**53))) / F.lit(float(weight))).alias("bid"), F.lit(shard).alias("shard"))


def rendezvous_shard(key: Column, weights: Sequence[float]) -> tuple[Column, Column]:
    """The shard of a key among len(weights) - 1 shards, and among all of them.

    A shard more takes keys only into itself, since the bids of the others stay as they are.
    """
    bids = [_bid(key, s, w) for s, w in enumerate(weights)]
    before = F.least(*bids[:-1]) if len(bids) > 2 else bids[0]
    return before["shard"], F.least(before, bids[-1])["shard"]


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, weights: Sequence[float] | None = None) -> DataFrame:
    """Each row's shard and its gapless place there: (id, size, text_crc32, shard, slot, grown_shard).

    weights has one number for each of `shards` + 1 shards, the last the one that may come; all alike if
    none are given. The id alone, with the number of shards, decides, so rows that repeat an id share a
    shard and texts don't matter; a null id is the key null. A null text has 8 bytes and the CRC of the
    empty text. Columns besides those two are not read; an empty table gives an empty result.

    The places need no shard in one task: rows are counted for each shard and input split, the counts are
    summed along the splits, and only the rows of one split are numbered together.
    """
    weights = [1.0] * (shards + 1) if weights is None else list(weights)
    if len(weights) != shards + 1 or min(weights) <= 0:
        raise ValueError("weights: one positive number for each shard and for the next one")
    shard, grown = rendezvous_shard(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), weights)
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shard.alias("shard"),
        grown.alias("grown_shard"),
        F.spark_partition_id().alias("split"),
        F.monotonically_increasing_id().alias("at"),
    )
    rows = checkpoint(rows)  # narrow rows; from here on split and at are data
    counts = rows.groupBy("shard", "split").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "split", before.alias("start"))
    place = F.row_number().over(W.partitionBy("shard", "split").orderBy("at")) - 1
    numbered = rows.withColumn("place", place).join(starts, ["shard", "split"])
    return numbered.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"), "grown_shard")


def op7_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents under the law `key`: see `assign_shards` for nulls and repeated rows."""
    placed = assign_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
