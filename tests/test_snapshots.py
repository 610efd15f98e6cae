"""Snapshots, exports and archives: what is published is whole, and runs that die leave what was there."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from memlake.sources import snapshots as S


@pytest.fixture
def tables(spark):
    records = spark.range(300).select(F.concat(F.lit("r"), "id").alias("id"), (F.col("id") % 7).alias("v"), F.when(F.col("id") % 3 == 0, F.array("id")).alias("list"))
    return {"records": records, "receipts": spark.range(5).select("id", F.lit(None).cast("string").alias("note")), "none": spark.createDataFrame([], "id long")}


def rows(frame):
    return sorted(map(str, frame.collect()))


def test_a_snapshot_is_what_was_given(spark, tables, tmp_path):
    root = str(tmp_path / "s")
    assert S.names(spark, root) == [] and S.latest(spark, root) is None
    manifest = S.write_snapshot(tables, root, "2026-01", "test", 5)
    assert {s: x["n"] for s, x in manifest["sections"].items()} == {"records": 300, "receipts": 5, "none": 0}
    S.write_snapshot({"records": tables["records"].limit(3)}, root, "2026-02", "test", 6)
    assert S.names(spark, root) == ["2026-01", "2026-02"] and S.latest(spark, root) == "2026-02"
    back = S.read_snapshot(spark, root, "2026-01")
    assert {s: rows(t) for s, t in back.items()} == {s: rows(t) for s, t in tables.items()}
    assert set(S.read_snapshot(spark, root)) == {"records"}
    with pytest.raises(ValueError, match="already"):
        S.write_snapshot(tables, root, "2026-01", "again", 7)
    for name in ("_x", "", "a/b"):
        with pytest.raises(ValueError, match="no name"):
            S.write_snapshot(tables, root, name, "test", 5)


def test_a_run_that_dies_leaves_the_last_good_snapshot(spark, tables, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    S.write_snapshot(tables, root, "good", "test", 1)
    broken = {**tables, "receipts": tables["receipts"].withColumn("note", F.when(F.col("id") == 3, F.raise_error(F.lit("disk full"))).otherwise(F.lit("x")))}
    with pytest.raises(Exception, match="disk full"):  # while a table is written
        S.write_snapshot(broken, root, "later", "test", 2)
    told = S.write_manifest
    for stage in ("sums", "write_manifest"):  # while it is checked, and before the manifest is there
        with monkeypatch.context() as m:
            m.setattr(S, stage, lambda *a, **b: (_ for _ in ()).throw(OSError("killed")))
            with pytest.raises(OSError, match="killed"):
                S.write_snapshot(tables, root, "later", "test", 2)
    with monkeypatch.context() as m, pytest.raises(OSError, match="killed"):  # after the manifest, before the rename
        m.setattr(S, "write_manifest", lambda *a, **b: (told(*a, **b), (_ for _ in ()).throw(OSError("killed")))[0])
        S.write_snapshot(tables, root, "later", "test", 2)
    assert S.names(spark, root) == ["good"] and rows(S.read_snapshot(spark, root)["records"]) == rows(tables["records"])
    assert len([f for f in os.listdir(root) if f.startswith("_staged")]) == 4
    S.write_snapshot(tables, root, "later", "test", 2)
    assert S.latest(spark, root) == "later"


def test_what_is_damaged_is_refused(spark, tables, tmp_path):
    root = str(tmp_path / "s")
    S.write_snapshot(tables, root, "a", "test", 1)
    S.write_snapshot(tables, root, "b", "test", 1)
    part = next(f for f in os.listdir(f"{root}/b/records") if f.endswith(".parquet"))
    os.remove(f"{root}/b/records/{part}")
    with pytest.raises(ValueError, match="records"):
        S.read_snapshot(spark, root, "b")
    shutil.rmtree(f"{root}/b/manifest")
    assert S.latest(spark, root) == "a"
    with pytest.raises(ValueError, match="no such"):
        S.read_snapshot(spark, root, "b")
    text = next(f for f in os.listdir(f"{root}/a/manifest") if f.endswith(".txt"))
    for f in os.listdir(f"{root}/a/manifest"):
        if f.endswith(".crc"):
            os.remove(f"{root}/a/manifest/{f}")
    with open(f"{root}/a/manifest/{text}", "w") as f:
        f.write('{"version": 99}')
    assert S.read_manifest(spark, f"{root}/a") is None
    with open(f"{root}/a/manifest/{text}", "w") as f:
        f.write('{"version"')
    with pytest.raises(ValueError, match="damaged"):
        S.read_manifest(spark, f"{root}/a")


def test_texts_by_type(spark, tmp_path):
    root = str(tmp_path / "t")
    texts = spark.createDataFrame([("work", "---\na: 1\n---\nfirst\n"), ("work", ""), ("work", "x\r\ny"), ("chat/odd name", "日本\n"), ("chat/odd name", "日本\n")], "type string, text string")
    assert S.write_texts(texts.repartition(3), root, "one") == {"work": {"n": 3}, "chat/odd name": {"n": 2}}
    assert rows(S.read_texts(spark, root, "one")) == rows(texts)
    assert S.write_texts(texts.limit(0), root, "two") == {} and S.read_texts(spark, root, "two").collect() == []
    with pytest.raises(ValueError, match="mark"):
        S.write_texts(spark.createDataFrame([("a", "x\x1ey")], "type string, text string"), root, "three")
    assert S.names(spark, root) == ["one", "two"]


def test_nothing_goes_before_it_is_archived(spark, tmp_path):
    root, day = str(tmp_path / "a"), S.DAY_MS
    messages = spark.createDataFrame([("1", "mail a.b@example.com now", 5), ("2", None, day + 1), ("3", "plain", day + 2), ("4", "new", 9 * day), ("5", "no time", None)], "id string, text string, ts_ms long")
    told = S.write_archive(messages, root, "x", 2 * day)
    assert {d: (x["n"], x["findings"]) for d, x in told.items()} == {"0": (1, 1), "1": (2, 0)}
    held = {r["id"]: r["text"] for r in S.read_archive(spark, root, "x").collect()}
    assert set(held) == {"1", "2", "3"} and "a.b@" not in held["1"] and held["3"] == "plain"
    late = messages.union(spark.createDataFrame([("6", "late", 7)], messages.schema))
    assert sorted(r["id"] for r in S.purge_archived(late, root, "x").collect()) == ["4", "5", "6"]
    part = next(f for f in os.listdir(f"{root}/x/messages/day=1") if f.endswith(".parquet"))
    os.remove(f"{root}/x/messages/day=1/{part}")
    with pytest.raises(ValueError, match="archive x"):
        S.purge_archived(messages, root, "x")
    with pytest.raises(ValueError, match="no such"):
        S.purge_archived(messages, root, "y")
    with pytest.raises(ValueError, match="lacks"):
        S.write_archive(messages.union(messages), root, "z", 2 * day)
    assert S.write_archive(messages, root, "empty", 0) == {} and S.purge_archived(messages, root, "empty").count() == 5
