"""Helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators.shared import checkpoint

__all__ = ["WORD", "checkpoint", "shuffle_partitions", "table", "text_or_empty", "uniform"]

#: One word: everything but the space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table of that name in the input folder, by a path that any Spark file system opens."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str) -> Column:
    """The text column, a null read as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the given values alone: 52 bits of an MD5 digest."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    key = F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit("null")) for c in columns))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
