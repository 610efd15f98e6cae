"""Snapshots, text exports and archives in a folder that any Spark file system opens: staged, checked, and published whole or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators.merges import snapshot_manifest
from memlake.operators.redaction import redact

VERSION = 1
MANIFEST = "manifest"
#: Between the texts of an export.
RECORD_END = "\x1e"
DAY_MS = 86_400_000


def _folder(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop has them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, root: str) -> list[str]:
    """What is published in a folder, in order; what is staged, or was left by a run that died, isn't."""
    fs, at = _folder(spark, root)
    if not fs.exists(at):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    return sorted(n for n in found if n[0] not in "_.")


@contextmanager
def staged(spark: SparkSession, root: str, name: str) -> Iterator[str]:
    """A new folder to write to, which becomes `root/name` by one rename once the block has ended well. If it fails the folder stays as it is, unpublished."""
    if not name or name[0] in "_." or "/" in name:
        raise ValueError(f"no name to publish under: {name!r}")
    fs, to = _folder(spark, f"{root}/{name}")
    if fs.exists(to):
        raise ValueError(f"{name} is there already")
    folder = f"{root}/_staged-{name}-{uuid.uuid4().hex}"
    yield folder
    if fs.exists(to) or not fs.rename(_folder(spark, folder)[1], to):
        raise ValueError(f"{name} can't be published")


def sums(sections: dict[str, DataFrame]) -> dict[str, dict]:
    """Rows and digest of each section, whatever the order of rows."""
    out = {}
    for section, rows in sections.items():
        row = snapshot_manifest(section, rows.select(sorted(rows.columns))).first()
        out[section] = {"n": row["n"], "digest": row["digest"]}
    return out


def write_manifest(spark: SparkSession, folder: str, **content) -> None:
    line = json.dumps({"version": VERSION, **content}, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{folder}/{MANIFEST}")


def read_manifest(spark: SparkSession, folder: str) -> dict | None:
    """The manifest of a published folder; None if it has none or one of another version, an error if it can't be read."""
    fs, at = _folder(spark, f"{folder}/{MANIFEST}/_SUCCESS")
    if not fs.exists(at):
        return None
    try:
        content = json.loads("\n".join(r["value"] for r in spark.read.text(f"{folder}/{MANIFEST}").collect()))
        version = content["version"]
    except (ValueError, KeyError, TypeError) as fault:
        raise ValueError(f"the manifest of {folder} is damaged") from fault
    return content if version == VERSION else None


def check(expected: dict[str, dict], found: dict[str, dict], where: str) -> None:
    wrong = sorted(s for s in expected if found.get(s) != expected[s])
    if wrong:
        raise ValueError(f"{where}: {', '.join(wrong)} isn't what was to be written")


def write_snapshot(sections: dict[str, DataFrame], root: str, name: str, reason: str, created_ms: int) -> dict:
    """Write tables as a snapshot and publish it; its manifest (sections with rows and digests).

    Order: the tables, then what they hold read again and compared with what was given, then the manifest, then the rename. A run that dies before leaves the
    snapshots that were there, and a folder that no reader looks at.
    """
    spark = next(iter(sections.values())).sparkSession
    with staged(spark, root, name) as folder:
        for section, rows in sections.items():
            rows.write.parquet(f"{folder}/{section}")
        given = sums(sections)
        check(given, sums({s: spark.read.schema(rows.schema).parquet(f"{folder}/{s}") for s, rows in sections.items()}), "written snapshot")
        content = {"reason": reason, "created_ms": created_ms, "sections": given}
        write_manifest(spark, folder, **content)
    return {"version": VERSION, **content}


def latest(spark: SparkSession, root: str) -> str | None:
    """The last published name that has a manifest."""
    return next((n for n in reversed(names(spark, root)) if read_manifest(spark, f"{root}/{n}") is not None), None)


def read_snapshot(spark: SparkSession, root: str, name: str | None = None) -> dict[str, DataFrame]:
    """The tables of a snapshot (the last one, if none is named), once they are what its manifest says; an error otherwise."""
    name = latest(spark, root) if name is None else name
    manifest = None if name is None else read_manifest(spark, f"{root}/{name}")
    if manifest is None:
        raise ValueError("no such snapshot")
    sections = {s: spark.read.parquet(f"{root}/{name}/{s}") for s in manifest["sections"]}
    check(manifest["sections"], sums(sections), f"snapshot {name}")
    return sections


def write_texts(texts: DataFrame, root: str, name: str) -> dict:
    """Texts (type, text) as text files in a folder for each type, and published with a manifest of their numbers: {type: {n}}.

    Files of a type follow from the input's partitions, not from its rows, so a type with most rows is written by many tasks. A text ends with RECORD_END, which it must not hold;
    types are names, since Spark reads a folder named 007 as the number 7 (that is an error here, before anything is published).
    """
    spark = texts.sparkSession
    if not texts.where(F.contains("text", F.lit(RECORD_END)) | F.col("type").isNull()).isEmpty():
        raise ValueError("texts must have a type, and not hold the mark that ends them")
    counts = lambda rows: {r["type"]: {"n": r["n"]} for r in rows.groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()}
    with staged(spark, root, name) as folder:
        texts.select("type", "text").write.option("lineSep", RECORD_END).partitionBy("type").text(f"{folder}/texts")
        given = counts(texts)
        check(given, counts(_texts(spark, f"{folder}/texts")) if given else {}, "written texts")
        write_manifest(spark, folder, types=given)
    return given


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("lineSep", RECORD_END).text(folder).select(F.col("type").cast("string").alias("type"), F.col("value").alias("text"))


def read_texts(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(type, text) of an export."""
    manifest = read_manifest(spark, f"{root}/{name}")
    if manifest is None:
        raise ValueError("no such export")
    return _texts(spark, f"{root}/{name}/texts") if manifest["types"] else spark.createDataFrame([], "type string, text string")


def write_archive(rows: DataFrame, root: str, name: str, before_ms: int) -> dict:
    """The messages (id, text, ts_ms, ...) before a time, redacted, in a folder for each day, and published with rows, findings and digest of each day.

    Messages without a time stay where they are. Redacted texts are checked by the ids and digests of what each day holds.
    """
    spark = rows.sparkSession
    old = rows.where(F.col("ts_ms") < before_ms).withColumn("day", F.floor(F.col("ts_ms") / DAY_MS))
    clean = redact(old.select("id", "text")).select("id", F.col("text").alias("clean"), F.size("kinds").alias("findings"))

    def days(of: DataFrame) -> dict[str, dict]:
        told = of.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("findings").alias("findings"), F.bit_xor(F.xxhash64("id", "text", "ts_ms")).alias("digest"))
        return {str(r["day"]): {"n": r["n"], "findings": r["findings"], "digest": r["digest"]} for r in told.collect()}  # one row a day

    with staged(spark, root, name) as folder:
        done = old.join(clean, "id").drop("text").withColumnRenamed("clean", "text")
        done.write.partitionBy("day").parquet(f"{folder}/messages")
        written = days(spark.read.schema(done.schema).parquet(f"{folder}/messages"))
        given = {str(r["day"]): r["n"] for r in old.groupBy("day").agg(F.count(F.lit(1)).alias("n")).collect()}
        if given != {day: x["n"] for day, x in written.items()}:
            raise ValueError("the archive lacks messages, or has some twice")
        write_manifest(spark, folder, before_ms=before_ms, days=written)
    return written


def read_archive(spark: SparkSession, root: str, name: str) -> DataFrame:
    if read_manifest(spark, f"{root}/{name}") is None:
        raise ValueError("no such archive")
    return spark.read.parquet(f"{root}/{name}/messages")


def purge_archived(rows: DataFrame, root: str, name: str) -> DataFrame:
    """The messages without those that an archive holds, once its days are what its manifest says; an error if one isn't.

    Only what the archive has is left out: messages that came later stay, whatever their time.
    """
    spark = rows.sparkSession
    manifest = read_manifest(spark, f"{root}/{name}")
    if manifest is None:
        raise ValueError("no such archive")
    if not manifest["days"]:
        return rows
    held = read_archive(spark, root, name)
    told = held.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("findings").alias("findings"), F.bit_xor(F.xxhash64("id", "text", "ts_ms")).alias("digest"))
    found = {str(r["day"]): {"n": r["n"], "findings": r["findings"], "digest": r["digest"]} for r in told.collect()}
    check(manifest["days"], found, f"archive {name}")
    return rows.join(held.select("id"), "id", "left_anti")
