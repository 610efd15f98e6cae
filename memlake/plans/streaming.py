"""Queries over event streams: each runs a stream to its end, or its twin over the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.plans.registry import Queries
from memlake.sources.derived import DAY, EVENT_TYPES, HOUR, MESSAGES, RECORDS, SESSION_EVENTS, messages, read, records, session_events
from memlake.streaming import slices as L
from memlake.streaming import turns as S

Q = Queries()


def event_stream(spark, sf):
    """The events as a stream of files: of the table's folder, or of the one file of that name in the input folder."""
    path = f"{sf}/events.parquet"
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema)
    one_file = any(f.endswith("/events.parquet") for f in table.inputFiles()[:1])
    return stream.option("pathGlobFilter", "events.parquet").parquet(sf) if one_file else stream.parquet(path)


def with_types(events):
    kinds = F.create_map(*(F.lit(x) for pair in EVENT_TYPES.items() for x in pair))
    kind = kinds[F.col("event_type")]
    turn = F.when(kind.isin("turn/start", "turn/end"), F.floor(F.col("event_id") / 400).cast("int"))
    return events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), F.col("event_id").alias("seq"), kind.alias("type"), turn.alias("turn"), F.col("props").alias("payload"))


TURNS = f"""WITH {SESSION_EVENTS}, s AS (SELECT *, count(*) FILTER (type = 'turn/start') OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS seg FROM session_events),
e AS (SELECT *, min(seq) FILTER (type = 'turn/end') OVER (PARTITION BY session_id, seg) AS done, min(turn) FILTER (type = 'turn/start') OVER (PARTITION BY session_id, seg) AS open,
  CAST(count(*) FILTER (type = 'assistant/message') OVER (PARTITION BY session_id, seg ORDER BY seq ROWS UNBOUNDED PRECEDING) AS INT) AS step FROM s WHERE seg > 0)
SELECT session_id, open AS turn, seq, type, trim(payload) AS payload, step FROM e WHERE seq < done AND type LIKE '%/message'"""


@Q.add(TURNS)
def l1_assemble_turns(spark, sf):
    return S.run_to_table(S.assemble_turns(with_types(event_stream(spark, sf))))


@Q.add(TURNS)
def l1_assemble_turns_batch(spark, sf):
    return S.assembled(session_events(spark, sf))


@Q.add("SELECT DISTINCT user_id, event_type, CAST(event_id // 50 AS BIGINT) AS slot FROM events")
def l2_watermark_dedupe(spark, sf):
    stream = event_stream(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.floor(F.col("event_id") / 50).alias("slot"))
    return S.run_to_table(S.without_replays(stream, ["user_id", "event_type", "slot"])).select("user_id", "event_type", "slot")


@Q.add(f"""WITH {MESSAGES}, f AS (SELECT session_id, CASE WHEN conv_id % 4 = 0 THEN 1 END AS kept, CASE WHEN conv_id % 5 = 0 THEN min(ts_ms) + 120000 END AS start_ms FROM messages WHERE conv_id % 2 = 0 GROUP BY session_id, conv_id)
SELECT m.id FROM messages m LEFT JOIN f ON m.session_id = f.session_id WHERE (kept IS NULL OR turn IS NULL OR turn > kept) AND (start_ms IS NULL OR ts_ms >= start_ms)""")
def l2_session_floor(spark, sf):
    rows = messages(spark, sf)
    own = rows.where("conv_id % 2 = 0").groupBy("session_id", "conv_id").agg(F.min("ts_ms").alias("first_ms"))
    floors = own.select("session_id", F.when(F.col("conv_id") % 4 == 0, 1).alias("turn"), F.when(F.col("conv_id") % 5 == 0, F.col("first_ms") + 120_000).alias("start_ms"))
    return S.above_watermark(rows, floors).select("id")


@Q.add(f"""WITH {SESSION_EVENTS}, n AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER w < {6 * HOUR} THEN 0 ELSE 1 END AS new FROM session_events WHERE session_id NOT LIKE '%7' WINDOW w AS (PARTITION BY session_id ORDER BY ts_ms, seq)),
r AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS run FROM n) SELECT session_id, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) AS n FROM r GROUP BY session_id, run""")
def l3_idle_flush(spark, sf):
    events = session_events(spark, sf)
    return S.idle_slices(events, 6 * HOUR, events.where("session_id like '%7'").select("session_id").distinct())


@Q.add(f"""WITH {MESSAGES}, k AS (SELECT id, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms, id) AS k FROM messages) SELECT id, CAST(CASE WHEN k <= 1 THEN 1 WHEN k <= 3 THEN 2 WHEN k <= 7 THEN 3 ELSE 3 + ceil((k - 7) / 6) END AS BIGINT) AS flush FROM k""")
def l4_warmup_trigger(spark, sf):
    return S.warmup_flush(messages(spark, sf)).select("id", "flush")


#: Slices of messages by thresholds of 1, 2, 4, 6, 6, ... and pauses of six hours, up to an hour before the last message: one recursion step a message.
SLICED = f"""WITH RECURSIVE e AS (SELECT 'u' || user_id AS session_id, event_id AS seq, epoch_us(ts) // 1000 AS ts_ms FROM events WHERE event_type IN ('click', 'view')), m AS (SELECT max(ts_ms) - {HOUR} AS mark FROM e),
k AS (SELECT session_id, seq, ts_ms, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms, seq) AS k FROM e, m WHERE ts_ms <= mark),
r(session_id, k, done, seqs, first_ms, last_ms, cause, o_slice, o_first, o_last, o_seqs) AS (
  SELECT DISTINCT session_id, 0::BIGINT, 0::BIGINT, []::BIGINT[], 0::BIGINT, 0::BIGINT, NULL::VARCHAR, 0::BIGINT, 0::BIGINT, 0::BIGINT, []::BIGINT[] FROM k
  UNION ALL
  SELECT session_id, k, done1 + CASE WHEN is_full THEN 1 ELSE 0 END, CASE WHEN is_full THEN []::BIGINT[] ELSE seqs1 END, first1, ts_ms, CASE WHEN quiet THEN 'idle' WHEN is_full THEN 'full' END, done + 1, CASE WHEN quiet THEN first_ms ELSE first1 END, CASE WHEN quiet THEN last_ms ELSE ts_ms END, CASE WHEN quiet THEN seqs ELSE seqs1 END
  FROM (SELECT *, done + CASE WHEN quiet THEN 1 ELSE 0 END AS done1, CASE WHEN quiet THEN [seq] ELSE list_append(seqs, seq) END AS seqs1, CASE WHEN quiet OR len(seqs) = 0 THEN ts_ms ELSE first_ms END AS first1, len(seqs1) >= least(6, pow(2, done1)) AS is_full
    FROM (SELECT r.session_id, n.k, n.seq, n.ts_ms, done, seqs, first_ms, last_ms, len(seqs) > 0 AND n.ts_ms - last_ms >= {6 * HOUR} AS quiet FROM r JOIN k n ON n.session_id = r.session_id AND n.k = r.k + 1))),
ended AS (SELECT session_id, o_slice AS slice, cause, o_first AS first_ms, o_last AS last_ms, o_seqs AS seqs FROM r WHERE cause IS NOT NULL
  UNION ALL SELECT session_id, done + 1, 'idle', first_ms, last_ms, seqs FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY k DESC) AS back FROM r), m WHERE back = 1 AND len(seqs) > 0 AND mark - last_ms >= {6 * HOUR})
SELECT session_id, slice, cause, first_ms, last_ms, array_to_string(seqs, ',') AS seqs FROM ended"""


def spoken(events):
    said = events.where(F.col("event_type").isin("click", "view"))
    utc = F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")))
    return said.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), F.col("event_id").alias("seq"), utc.alias("ts"))


@Q.add(SLICED)
def l3_l4_slices(spark, sf):
    rows = spoken(read(spark, sf, "events")).select("session_id", "seq", F.unix_millis("ts").alias("ts_ms"))
    mark = rows.agg(F.max("ts_ms")).first()[0] or 0
    return L.slices(rows, mark - HOUR, 6, 6 * HOUR).withColumn("seqs", F.array_join(F.col("seqs").cast("array<string>"), ","))


@Q.add(SLICED)
def l3_l4_slice_stream(spark, sf):
    out = S.run_to_table(L.slice_stream(spoken(event_stream(spark, sf)), 6, 6 * HOUR, "1 hour"), L.ROCKS)
    return out.withColumn("seqs", F.array_join(F.col("seqs").cast("array<string>"), ","))


@Q.add(f"WITH {RECORDS} SELECT id, updated_ms + CAST(least(1800000, 60000 * pow(2, greatest(seq % 8, 1) - 1)) AS BIGINT) AS next_ms, CASE WHEN seq % 8 >= 6 THEN 'dead' ELSE 'retry' END AS status FROM records")
def l5_backoff(spark, sf):
    return S.next_attempts(records(spark, sf).select("id", (F.col("seq") % 8).alias("fails"), F.col("updated_ms").alias("failed_ms")))


@Q.add("""WITH m AS (SELECT 'u' || user_id AS session_id, event_id AS seq, CASE WHEN event_type = 'error' THEN 'off' WHEN event_type = 'click' THEN 'chat' ELSE 'work' END AS mode FROM events), w AS (SELECT *, lag(mode) OVER (PARTITION BY session_id ORDER BY seq) AS was FROM m)
SELECT session_id, seq, CASE WHEN was IS NULL OR was = mode THEN 'none' WHEN mode = 'off' THEN 'park' WHEN was = 'off' THEN 'unpark' ELSE 'flush' END AS action FROM w""")
def l6_mode_switch(spark, sf):
    mode = F.when(F.col("event_type") == "error", "off").when(F.col("event_type") == "click", "chat").otherwise("work")
    return S.mode_actions(read(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), F.col("event_id").alias("seq"), mode.alias("mode")))


@Q.add(f"""WITH l AS (SELECT epoch_us(ts) AS us, 'm' || (user_id % 5) AS model, CAST(floor(value) AS BIGINT) AS tokens FROM events), w AS (SELECT max(us) - 3600000000 AS mark FROM l)
SELECT us // {DAY * 1000} AS day, model, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens FROM l, w WHERE (us // {DAY * 1000} + 1) * {DAY * 1000} <= mark GROUP BY 1, 2""")
def l7_cost_stream(spark, sf):
    utc = F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")))
    ledger = event_stream(spark, sf).select(utc.alias("ts"), F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("model"), F.floor("value").alias("tokens"))
    out = S.run_to_table(S.cost_stream(ledger))
    return out.select(F.floor(F.unix_micros("start") / (DAY * 1000)).alias("day"), "model", "calls", "tokens")


@Q.add(f"""WITH {RECORDS}, i AS (SELECT 's' || (o_orderkey % 40) AS session_id, 'r' || (o_orderkey % 900) AS id, max((epoch_us(o_orderdate) // 1000)) + {20 * 365 * DAY} AS injected_ms FROM orders GROUP BY 1, 2), r AS (SELECT id, updated_ms AS retired_ms FROM records WHERE retired_reason IS NOT NULL),
k AS (SELECT session_id, i.id, row_number() OVER (PARTITION BY session_id ORDER BY retired_ms DESC, i.id) AS k FROM i JOIN r ON i.id = r.id WHERE retired_ms > injected_ms) SELECT session_id, id FROM k WHERE k <= 8""")
def l8_obsolete_notices(spark, sf):
    from memlake.sources.derived import epoch_ms

    k = F.col("o_orderkey")
    injected = read(spark, sf, "orders").groupBy(F.concat(F.lit("s"), (k % 40).cast("string")).alias("session_id"), F.concat(F.lit("r"), (k % 900).cast("string")).alias("id")).agg((F.max(epoch_ms(F.col("o_orderdate"))) + 20 * 365 * DAY).alias("injected_ms"))
    retired = records(spark, sf).where("retired_reason is not null").select("id", F.col("updated_ms").alias("retired_ms"))
    return S.obsolete_notices(retired, injected)


@Q.add(f"""WITH {RECORDS}, c AS (SELECT id, seq, CASE WHEN seq % 3 = 0 THEN 'forget' ELSE 'add' END AS intent, CASE WHEN seq % 2 = 0 THEN 'work' ELSE 'chat' END AS family FROM records), t(driver, space) AS (VALUES ('d1', 'a'), ('d1', 'b'), ('d2', 'a'))
SELECT driver, space, id, intent FROM c, t WHERE (intent <> 'add' OR family = 'work') AND (intent <> 'forget' OR (driver = 'd1' AND space = 'a' AND seq % 6 = 0)) AND NOT (driver = 'd2' AND seq % 5 = 0 AND intent = 'add')""")
def l9_outbox_enqueue(spark, sf):
    rows = records(spark, sf)
    changes = rows.select("id", F.when(F.col("seq") % 3 == 0, "forget").otherwise("add").alias("intent"), F.when(F.col("seq") % 2 == 0, "work").otherwise("chat").alias("family"))
    targets = spark.createDataFrame([("d1", "a", True), ("d1", "b", True), ("d2", "a", True), ("d3", "a", False)], "driver string, space string, enabled boolean")
    shadow = rows.where("seq % 6 = 0").select(F.lit("d1").alias("driver"), F.lit("a").alias("space"), "id")
    live = rows.where("seq % 5 = 0").select(F.lit("d2").alias("driver"), F.lit("a").alias("space"), "id", F.lit("add").alias("intent"))
    return S.outbox_enqueue(changes, targets, shadow, live, ["work"])
