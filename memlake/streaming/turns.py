"""Session events as streams: turns, replays, idle flushes, cost windows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memlake.functions import columns as C
from memlake.operators.shared import checkpoint, small


def run_to_table(stream: DataFrame, store: str | None = None) -> DataFrame:
    """Run a stream over what is there now into a table of the shared folder (spark.checkpoint.dir), and read it. store: the class that keeps its state, if not the session's."""
    spark: SparkSession = stream.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not (spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="memlake-stream-")
    at = f"{shared}/stream-{uuid.uuid4().hex}"
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    if store is not None:
        spark.conf.set(name, store)
    try:
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if store is not None:
            spark.conf.set(name, before) if before is not None else spark.conf.unset(name)
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def clean_events(events: DataFrame) -> DataFrame:
    """Events whose messages have a cleaned payload; those with nothing to keep go. Marks of turns stay."""
    message = F.col("type").endswith("/message")
    payload = C.sanitized(F.col("payload"))
    payload = F.when(F.col("type") == "assistant/message", C.without_code(payload)).otherwise(payload)
    kept = events.withColumn("payload", F.when(message, payload).otherwise(F.col("payload")))
    return kept.where(~message | C.capturable(F.col("payload")))


def assemble_turns(events: DataFrame) -> DataFrame:
    """(session_id, turn, seq, type, payload, step): cleaned messages of a turn once its end has come, from a stream (session_id, seq, type, turn, payload).

    State is the open turn of a session and its messages, however many: none of an open turn is given up. A start drops what an
    open turn had; an end without a start does nothing. step counts the assistant's messages so far. Within a micro-batch events
    go by seq.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turn, seqs, types, payloads = state.get if state.exists else (None, [], [], [])
        seqs, types, payloads, out = list(seqs), list(types), list(payloads), []
        rows = pd.concat(list(batches)).sort_values("seq")
        for row in rows.itertuples(index=False):
            if row.type == "turn/start":
                turn, seqs, types, payloads = int(row.turn), [], [], []
            elif row.type == "turn/end":
                step = 0
                for s, t, p in zip(seqs, types, payloads, strict=True) if turn is not None else ():
                    step += t == "assistant/message"
                    out.append((key[0], turn, s, t, p, step))
                turn, seqs, types, payloads = None, [], [], []
            elif turn is not None and row.type.endswith("/message"):
                seqs.append(int(row.seq))
                types.append(row.type)
                payloads.append(row.payload)
        state.update((turn, seqs, types, payloads))
        yield pd.DataFrame(out, columns=["session_id", "turn", "seq", "type", "payload", "step"])

    said = "session_id string, turn int, seq long, type string, payload string, step int"
    return clean_events(events).groupBy("session_id").applyInPandasWithState(fold, said, "turn int, seqs array<long>, types array<string>, payloads array<string>", "append", GroupStateTimeout.NoTimeout)


def assembled(events: DataFrame) -> DataFrame:
    """The same over a whole table: what a start begins and an end closes."""
    order = W.partitionBy("session_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    rows = clean_events(events).withColumn("segment", F.count(F.when(F.col("type") == "turn/start", True)).over(order)).where("segment > 0")
    own = W.partitionBy("session_id", "segment")
    rows = rows.withColumn("end", F.min(F.when(F.col("type") == "turn/end", F.col("seq"))).over(own)).withColumn("open", F.min(F.when(F.col("type") == "turn/start", F.col("turn"))).over(own))
    step = F.count(F.when(F.col("type") == "assistant/message", True)).over(own.orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    held = rows.withColumn("step", step.cast("int")).where((F.col("seq") < F.col("end")) & F.col("type").endswith("/message"))
    return held.select("session_id", F.col("open").alias("turn"), "seq", "type", "payload", "step")


def above_watermark(messages: DataFrame, floors: DataFrame) -> DataFrame:
    """Messages (session_id, turn, ts_ms) of turns that a session hasn't kept yet and not before its start: floors (session_id, turn, start_ms), either null."""
    rows = messages.join(floors.select("session_id", F.col("turn").alias("kept_turn"), "start_ms"), "session_id", "left")
    new = F.col("kept_turn").isNull() | F.col("turn").isNull() | (F.col("turn") > F.col("kept_turn"))
    return rows.where(new & (F.col("start_ms").isNull() | (F.col("ts_ms") >= F.col("start_ms")))).select(messages.columns)


def without_replays(events: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """A stream with an event time `ts` without rows that repeat the keys within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def cost_stream(ledger: DataFrame, width: str = "1 day", delay: str = "1 hour", since: str | None = None) -> DataFrame:
    """Calls and tokens by window and model; a window comes out once the watermark has passed it. Entries before `since` (a time) are past their retention."""
    grouped = (ledger.where(F.col("ts") >= F.lit(since).cast("timestamp")) if since else ledger).withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "model").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"))
    return grouped.select(F.col("w.start").alias("start"), "model", "calls", "tokens")


def idle_slices(events: DataFrame, gap_ms: int, off: DataFrame | None = None) -> DataFrame:
    """(session_id, first_ms, last_ms, n): runs of events without a pause of gap_ms; sessions that are off are left out."""
    if off is not None:
        events = events.join(off.select("session_id"), "session_id", "left_anti")
    order = W.partitionBy("session_id").orderBy("ts_ms", "seq")
    new = F.coalesce((F.col("ts_ms") - F.lag("ts_ms").over(order) >= gap_ms).cast("int"), F.lit(1))
    runs = events.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("session_id", "run").agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.count(F.lit(1)).alias("n")).drop("run")


def warmup_flush(messages: DataFrame, steady: int = 6) -> DataFrame:
    """Each message with the flush that takes it: flushes take 1, 2, 4, ... messages and `steady` from then on."""
    k = F.row_number().over(W.partitionBy("session_id").orderBy("ts_ms", "id"))
    sizes, total = [], 0
    while (size := 2 ** len(sizes)) < steady:
        total += size
        sizes.append(total)
    rows, flush = messages.withColumn("k", k), F.lit(len(sizes)) + F.ceil((F.col("k") - total) / steady)
    for n in range(len(sizes), 0, -1):
        flush = F.when(F.col("k") <= sizes[n - 1], n).otherwise(flush)
    return rows.withColumn("flush", flush.cast("long"))


def next_attempts(outbox: DataFrame, base_ms: int = 60_000, cap_ms: int = 1_800_000, most: int = 6) -> DataFrame:
    """Jobs (id, fails, failed_ms) with when they may run again and whether they're dead."""
    wait = F.least(F.lit(float(cap_ms)), base_ms * F.pow(F.lit(2.0), F.greatest(F.col("fails"), F.lit(1)) - 1)).cast("long")
    return outbox.select("id", (F.col("failed_ms") + wait).alias("next_ms"), F.when(F.col("fails") >= most, "dead").otherwise("retry").alias("status"))


def mode_actions(modes: DataFrame) -> DataFrame:
    """Mode changes (session_id, seq, mode) with what they call for."""
    was = F.lag("mode").over(W.partitionBy("session_id").orderBy("seq"))
    rows = modes.withColumn("was", was)
    return rows.select("session_id", "seq", F.when(F.col("was").isNull() | (F.col("was") == F.col("mode")), "none").when(F.col("mode") == "off", "park").when(F.col("was") == "off", "unpark").otherwise("flush").alias("action"))


def obsolete_notices(retired: DataFrame, injected: DataFrame, most: int = 8) -> DataFrame:
    """(session_id, id): records retired after they were injected, the latest ones of each session."""
    met = injected.join(retired, "id").where(F.col("retired_ms") > F.col("injected_ms"))
    k = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("retired_ms"), "id"))
    return met.withColumn("k", k).where(F.col("k") <= most).select("session_id", "id")


def outbox_enqueue(changes: DataFrame, targets: DataFrame, shadow: DataFrame, live: DataFrame, families: list[str]) -> DataFrame:
    """(driver, space, id, intent): changes (id, intent, family) for each enabled target, a family filter on what is added,
    a shadow row required for what is forgotten, jobs that wait already left out. Targets are a small table of settings."""
    enabled = checkpoint(targets.where("enabled").select("driver", "space").distinct())
    jobs = changes.join(small(enabled))  # each change for each target is what is asked for
    known = jobs.join(shadow.select("driver", "space", "id", F.lit(True).alias("known")), ["driver", "space", "id"], "left")
    wanted = known.where(((F.col("intent") != "add") | F.col("family").isin(*families)) & ((F.col("intent") != "forget") | F.col("known")))
    return wanted.join(live, ["driver", "space", "id", "intent"], "left_anti").select("driver", "space", "id", "intent")
