"""Slices from streams with late and replayed messages, against the table and a loop."""

import random

from pyspark.sql import functions as F

from memlake.streaming import slices as S


def by_hand(messages, mark, steady, idle):
    out, sessions = set(), {}
    for session, seq, ts in set(messages):
        if ts <= mark:
            sessions.setdefault(session, []).append((ts, seq))
    for session, rows in sessions.items():
        open_, done = [], 0

        def end(cause):
            nonlocal open_, done
            done += 1
            out.add((session, done, cause, open_[0][0], open_[-1][0], tuple(s for _, s in open_)))  # noqa: B023
            open_ = []

        for ts, seq in sorted(rows):
            if open_ and ts - open_[-1][0] >= idle:
                end("idle")
            open_.append((ts, seq))
            if len(open_) >= min(steady, 2**done):
                end("full")
        if open_ and mark - open_[-1][0] >= idle:
            end("idle")
    return out


def told(frame):
    rows = [(r["session_id"], r["slice"], r["cause"], r["first_ms"], r["last_ms"], tuple(r["seqs"])) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def messages(seed, n):
    draw, out = random.Random(seed), []
    clocks = dict.fromkeys("abcd", 1_000_000)
    for seq in range(n):
        session = draw.choice("aaabbcd")
        clocks[session] += draw.choice([1000, 5000, 20_000, 400_000])
        out.append((session, seq, clocks[session]))
    return out


def test_table_against_a_loop(spark):
    rows = messages(1, 400)
    frame = spark.createDataFrame(rows + rows[::7], "session_id string, seq long, ts_ms long").repartition(5)
    for mark in (0, 5_000_000, 10**9):
        assert told(S.slices(frame, mark, 6, 60_000)) == by_hand(rows, mark, 6, 60_000)
    assert S.slices(frame.limit(0), 10, 6, 60_000).collect() == []


def test_stream_with_late_and_repeated_messages(spark, tmp_path):
    rows = sorted(messages(2, 260), key=lambda r: r[2])
    draw, delay = random.Random(3), 300_000
    files = [rows[k : k + 50] for k in range(0, len(rows), 50)]
    for k in range(1, len(files)):  # some come a file later, within the delay; some come again
        moved = [r for r in files[k - 1] if draw.random() < 0.2 and r[2] > max(x[2] for x in files[k - 1]) - delay // 2]
        files[k - 1] = [r for r in files[k - 1] if r not in moved]
        files[k] = [*moved, *files[k], *draw.sample(files[k - 1], 10)]
    for k, part in enumerate(files):
        draw.shuffle(part)
        spark.createDataFrame(part, "session_id string, seq long, ts_ms long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/part{k}")
    stream_from = f"{tmp_path}/in"
    first = spark.read.parquet(f"{tmp_path}/part0")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKS)
    try:
        for k in range(len(files)):
            spark.read.parquet(f"{tmp_path}/part{k}").coalesce(1).write.mode("append").parquet(stream_from)
            events = spark.readStream.schema(first.schema).parquet(stream_from).withColumn("ts", F.timestamp_millis("ts_ms"))
            query = S.slice_stream(events, 6, 60_000, "300 seconds").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    mark = max(r[2] for r in rows) - delay
    want = by_hand(rows, mark, 6, 60_000)
    assert {w[2] for w in want} == {"full", "idle"} and len(want) > 40
    assert told(spark.read.parquet(f"{tmp_path}/out")) == want
