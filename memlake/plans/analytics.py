"""Queries of aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import columns as C
from memlake.operators import analytics as O
from memlake.plans.filters import FAMILY, family
from memlake.plans.registry import Queries
from memlake.sources.derived import DAY, LEDGER, LEDGER_NOW, MESSAGES, NOW, RECORDS, SESSION_EVENTS, epoch_ms, ledger, messages, read, records, session_events

Q = Queries()

COSTS = "count(*) AS calls, CAST(sum(input_chars) AS BIGINT) AS input_chars, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(reasoning_tokens) AS BIGINT) AS reasoning_tokens"
AVERAGES = "round(avg(output_tokens), 6) AS avg_output, quantile_cont(output_tokens, 0.5) AS median_output"
RANGED = f"ranged AS (SELECT l.*, r.name AS range FROM ledger l JOIN (VALUES ('day', {DAY}), ('week', {7 * DAY}), ('month', {30 * DAY}), ('all', 0)) r(name, ms) ON r.ms = 0 OR l.ts_ms >= {LEDGER_NOW} - r.ms)"


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@Q.add(f"WITH {LEDGER}, {RANGED} SELECT range, {COSTS}, {AVERAGES} FROM ranged GROUP BY range")
def d1_cost_windows(spark, sf):
    return rounded(O.cost_windows(ledger(spark, sf), LEDGER_NOW), "avg_output")


@Q.add(f"WITH {LEDGER}, {RANGED} SELECT range, provider, model, {COSTS} FROM ranged GROUP BY range, provider, model")
def d1_cost_by_model(spark, sf):
    return O.cost_by_model(ledger(spark, sf), LEDGER_NOW)


@Q.add(f"WITH {LEDGER} SELECT CASE WHEN layer IN ('l1-extract','l1-dedup') THEN 'l1' ELSE layer END AS layer, {COSTS}, {AVERAGES} FROM ledger WHERE ts_ms >= {LEDGER_NOW - 14 * DAY} GROUP BY 1")
def d2_cost_by_layer(spark, sf):
    return rounded(O.cost_by_layer(ledger(spark, sf), LEDGER_NOW - 14 * DAY), "avg_output")


@Q.add(f"""WITH {LEDGER} SELECT (ts_ms + 28800000) // {DAY} AS bucket, provider, model, count(*) AS calls, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(reasoning_tokens) AS BIGINT) AS reasoning_tokens
FROM ledger WHERE layer IN ('l1-extract','l1-dedup') GROUP BY 1, 2, 3""")
def d3_cost_buckets(spark, sf):
    return O.cost_buckets(ledger(spark, sf), DAY, 28_800_000, "l1")


@Q.add(f"""WITH {LEDGER}, c AS (SELECT {LEDGER_NOW} // {7 * DAY} - i AS bucket FROM range(12) r(i))
SELECT bucket, coalesce(count(l.ts_ms), 0) AS calls, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens FROM c LEFT JOIN ledger l ON l.ts_ms // {7 * DAY} = bucket AND layer = 'l2' GROUP BY bucket""")
def d4_cost_trend(spark, sf):
    return O.cost_trend(ledger(spark, sf), LEDGER_NOW, "week", "l2")


@Q.add(f"""WITH {LEDGER}, b AS (SELECT provider, model, g, ts_ms // w AS bucket, count(*) AS calls, sum(output_tokens) AS output FROM ledger, (VALUES ('day', {DAY}), ('week', {7 * DAY}), ('month', {30 * DAY})) x(g, w) GROUP BY 1, 2, 3, 4)
SELECT provider || '/' || model AS model, g AS granularity, round(avg(calls), 6) AS avg_calls, round(avg(output), 6) AS avg_output, CAST(quantile_cont(CAST(output AS DOUBLE), 0.5) AS DOUBLE) AS median_output FROM b GROUP BY 1, 2""")
def d5_model_metrics(spark, sf):
    return rounded(O.model_metrics(ledger(spark, sf)), "avg_calls", "avg_output")


@Q.add(f"WITH {RECORDS} SELECT coalesce(wing, '(none)') AS wing, count(*) AS n FROM records GROUP BY 1")
def d6_wing_counts(spark, sf):
    return records(spark, sf).groupBy(F.coalesce("wing", F.lit("(none)")).alias("wing")).agg(F.count(F.lit(1)).alias("n"))


@Q.add(f"WITH {RECORDS} SELECT room, count(*) AS n FROM (SELECT unnest(tags) AS room FROM records) GROUP BY 1")
def d7_room_counts(spark, sf):
    return records(spark, sf).select(F.explode("tags").alias("room")).groupBy("room").agg(F.count(F.lit(1)).alias("n"))


@Q.add(f"WITH {RECORDS} SELECT count(*) AS n FROM records WHERE len(tags) = 0")
def d8_untagged_count(spark, sf):
    return records(spark, sf).where(F.size("tags") == 0).agg(F.count(F.lit(1)).alias("n"))


@Q.add(f"WITH {MESSAGES} SELECT count(DISTINCT session_id) AS sessions, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS chars FROM messages")
def d9_corpus_estimate(spark, sf):
    return messages(spark, sf).agg(F.countDistinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("messages"), F.sum(F.length("text")).alias("chars"))


@Q.add(f"WITH {MESSAGES}, {RECORDS}, w AS (SELECT max(ts_ms) AS last_ms, count(DISTINCT session_id) AS sessions FROM messages) SELECT last_ms, sessions, (SELECT count(*) FROM records) AS records, (SELECT count(*) FROM records WHERE created_ms > last_ms) AS newer FROM w")
def d10_rebuild_watermark(spark, sf):
    last = messages(spark, sf).agg(F.max("ts_ms").alias("last_ms"), F.countDistinct("session_id").alias("sessions"))
    both = records(spark, sf).select("created_ms").join(F.broadcast(last))
    return both.groupBy("last_ms", "sessions").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("created_ms") > F.col("last_ms")).alias("newer"))


@Q.add(f"WITH {RECORDS} SELECT type, {FAMILY} AS family, count(*) AS n, count(*) FILTER (retired_reason IS NOT NULL) AS retired FROM records GROUP BY 1, 2")
def d11_type_family_counts(spark, sf):
    return records(spark, sf).groupBy("type", family().alias("family")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("retired_reason").isNotNull()).alias("retired"))


def pairs(spark, sf):
    """Conflict pairs of orders: the winner is the order, the loser the one before it of the same customer."""
    o = read(spark, sf, "orders")
    kinds = F.when(F.col("o_orderpriority").startswith("1"), "hard").when(F.col("o_orderpriority").startswith("2"), "conditional").otherwise("supersession")
    return o.select(
        F.col("o_orderkey").alias("pair_id"),
        F.concat(F.lit("r"), (F.col("o_orderkey") % 997).cast("string")).alias("winner_id"),
        F.concat(F.lit("r"), (F.col("o_orderkey") % 991).cast("string")).alias("loser_id"),
        epoch_ms(F.col("o_orderdate")).alias("created_ms"),
        kinds.alias("conflict_type"),
        F.when(F.col("o_orderstatus") == "F", "winner").when(F.col("o_orderstatus") == "P", "defer").alias("resolution"),
        F.when(F.col("o_custkey") % 5 != 0, F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("claim_key"),
        (F.col("o_orderkey") % 5).cast("int").alias("defer_count"),
        F.when(F.col("o_orderkey") % 4 == 0, epoch_ms(F.col("o_orderdate")) + 5 * DAY).alias("deferred_ms"),
    )


PAIRS = f"""pairs AS (SELECT o_orderkey AS pair_id, 'r' || (o_orderkey % 997) AS winner_id, 'r' || (o_orderkey % 991) AS loser_id, (epoch_us(o_orderdate) // 1000) AS created_ms,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'hard' WHEN o_orderpriority LIKE '2%' THEN 'conditional' ELSE 'supersession' END AS conflict_type,
  CASE WHEN o_orderstatus = 'F' THEN 'winner' WHEN o_orderstatus = 'P' THEN 'defer' END AS resolution, CASE WHEN o_custkey % 5 <> 0 THEN 'c' || o_custkey END AS claim_key,
  CAST(o_orderkey % 5 AS INT) AS defer_count, CASE WHEN o_orderkey % 4 = 0 THEN (epoch_us(o_orderdate) // 1000) + {5 * DAY} END AS deferred_ms FROM orders)"""


@Q.add(f"WITH {PAIRS} SELECT conflict_type, coalesce(resolution, 'open') AS resolution, count(*) AS n FROM pairs GROUP BY 1, 2")
def d12_conflict_counts(spark, sf):
    return pairs(spark, sf).groupBy("conflict_type", F.coalesce("resolution", F.lit("open")).alias("resolution")).agg(F.count(F.lit(1)).alias("n"))


def attempts(spark, sf):
    e = read(spark, sf, "events")
    ids = F.array(*(F.concat(F.lit("r"), ((F.col("event_id") * m) % 500).cast("string")) for m in (1, 7, 7, 13)))
    return e.select(epoch_ms(F.col("ts")).alias("ts_ms"), ids.alias("candidate_ids"), F.array(F.concat(F.lit("r"), ((F.col("event_id") * 7) % 500).cast("string")), F.concat(F.lit("r"), (F.col("user_id") % 500).cast("string"))).alias("used_ids"))


ATTEMPTS = "attempts AS (SELECT (epoch_us(ts) // 1000) AS ts_ms, ['r' || (event_id % 500), 'r' || ((event_id * 7) % 500), 'r' || ((event_id * 7) % 500), 'r' || ((event_id * 13) % 500)] AS c, ['r' || ((event_id * 7) % 500), 'r' || (user_id % 500)] AS u FROM events)"
USAGE = f"{ATTEMPTS}, every AS (SELECT ts_ms, u, unnest(list_distinct(list_concat(c, u))) AS id FROM attempts), usage AS (SELECT id, count(*) AS attempts, count(*) FILTER (list_contains(u, id)) AS used, max(ts_ms) AS last_attempt_ms, max(ts_ms) FILTER (list_contains(u, id)) AS last_used_ms FROM every GROUP BY id)"


@Q.add(f"WITH {USAGE} SELECT * FROM usage")
def d13_recall_usage(spark, sf):
    return O.recall_usage(attempts(spark, sf))


def feedback(spark, sf):
    e = read(spark, sf, "events")
    return e.select(F.concat(F.lit("r"), (F.col("user_id") % 500).cast("string")).alias("id"), (F.col("event_id") % 7 - 1).cast("int").alias("score"), epoch_ms(F.col("ts")).alias("at_ms"), F.col("event_id").alias("n"))


FEEDBACK = "feedback AS (SELECT 'r' || (user_id % 500) AS id, CAST(event_id % 7 - 1 AS INT) AS score, (epoch_us(ts) // 1000) AS at_ms, event_id AS n FROM events)"


@Q.add(f"""WITH {FEEDBACK} SELECT id, arg_max(score, (at_ms, n)) AS last_score, count(*) FILTER (score >= 0) AS rated, round(avg(score) FILTER (score >= 0), 2) AS mean, count(*) FILTER (score = -1) AS obsolete,
  array_to_string(list_reverse(list(score ORDER BY at_ms DESC, n DESC)[1:12]), ',') AS history FROM feedback GROUP BY id""")
def d14_feedback_fold(spark, sf):
    return O.feedback_fold(feedback(spark, sf)).withColumn("history", F.array_join(F.col("history").cast("array<string>"), ","))


@Q.add(f"""WITH {USAGE}, m AS (SELECT 'r' || i AS old, 'r' || (i + 1) AS new FROM range(0, 400) r(i) WHERE i % 4 <> 3),
j AS (SELECT CASE WHEN CAST(substr(id, 2) AS INT) < 400 THEN 'r' || ((CAST(substr(id, 2) AS INT) // 4) * 4 + 3) ELSE id END AS id, attempts, used FROM usage)
SELECT id, CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(used) AS BIGINT) AS used FROM j GROUP BY id""")
def d15_rekey_merge(spark, sf):
    usage = O.recall_usage(attempts(spark, sf))
    moves = spark.range(400).where("id % 4 <> 3").select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("old"), F.concat(F.lit("r"), (F.col("id") + 1).cast("string")).alias("new"))
    return O.rekey(usage.select("id", "attempts", "used"), moves)


@Q.add(f"WITH {MESSAGES} SELECT session_id, max(turn) AS turn, arg_max(step, (turn, -ts_ms)) AS step FROM messages WHERE turn IS NOT NULL GROUP BY session_id")
def d16_session_watermark(spark, sf):
    return O.session_watermark(messages(spark, sf))


@Q.add("""WITH g AS (SELECT 'customer' || (o_custkey % 700) AS entity, CASE WHEN o_orderkey % 3 = 0 THEN 'status' ELSE 'priority' END AS attribute, CASE WHEN o_orderkey % 50 = 0 THEN 'eu' END AS scope,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE substr(o_orderpriority, 1, 1) END AS value, CASE WHEN o_custkey % 2 = 0 THEN (epoch_us(o_orderdate) // 1000) END AS time_ms FROM orders),
a AS (SELECT entity, attribute, count(*) AS n, count(DISTINCT lower(value)) AS vals, count(DISTINCT coalesce(scope, '')) AS scopes, count(time_ms) AS timed, count(DISTINCT time_ms) AS times FROM g GROUP BY 1, 2)
SELECT entity, attribute, n, vals AS values, CASE WHEN vals <= 1 THEN 'agreement' WHEN scopes > 1 THEN 'conditional' WHEN timed = n AND times = n THEN 'supersession' ELSE 'hard' END AS verdict FROM a""")
def d17_claim_classification(spark, sf):
    o, k = read(spark, sf, "orders"), F.col("o_orderkey")
    value = F.when(k % 3 == 0, F.col("o_orderstatus")).otherwise(F.substring("o_orderpriority", 1, 1))
    claims = o.select(
        F.concat(F.lit("Customer"), (F.col("o_custkey") % 700).cast("string"), F.lit(" ")).alias("entity"),
        F.when(k % 3 == 0, "Status").otherwise("PRIORITY").alias("attribute"),
        F.when(k % 50 == 0, F.when(k % 100 == 0, "E U").otherwise("(eu)")).alias("scope"),
        F.when(k % 2 == 0, F.concat(F.lit('"'), value, F.lit('" '))).otherwise(F.lower(value)).alias("value"),
        F.when(F.col("o_custkey") % 2 == 0, epoch_ms(F.col("o_orderdate"))).alias("time_ms"),
    )
    return O.claim_classes(claims)


NAMES = "names AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 1 THEN p_name || ' x' || (p_partkey % 9) ELSE p_name END AS name FROM part)"


def names(spark, sf):
    k = F.col("p_partkey")
    return read(spark, sf, "part").select(F.when(k % 3 == 0, F.upper("p_name")).when(k % 3 == 1, F.concat("p_name", F.lit(" x"), (k % 9).cast("string"))).otherwise(F.col("p_name")).alias("name"))


@Q.add(f"WITH {NAMES} SELECT lower(replace(name, ' ', '')) AS key, count(DISTINCT name) AS spellings FROM names GROUP BY 1 HAVING count(DISTINCT name) > 1")
def d18_entity_spellings(spark, sf):
    return O.spellings(names(spark, sf))


@Q.add(f"""WITH {NAMES}, k AS (SELECT DISTINCT lower(replace(name, ' ', '')) AS key FROM names)
SELECT a.key AS short, b.key AS long FROM k a JOIN k b ON length(a.key) >= 4 AND length(b.key) > length(a.key) AND length(b.key) <= 2 * length(a.key) AND (starts_with(b.key, a.key) OR ends_with(b.key, a.key))""")
def d18_affix_pairs(spark, sf):
    return O.affix_pairs(names(spark, sf))


@Q.add(f"WITH {PAIRS} SELECT coalesce(claim_key, '(none)') AS claim_key, count(DISTINCT pair_id) AS n, min(pair_id) AS first_pair FROM pairs WHERE resolution IS NULL GROUP BY 1")
def d19_claim_groups(spark, sf):
    open_ = pairs(spark, sf).where("resolution is null")
    return open_.groupBy(F.coalesce("claim_key", F.lit("(none)")).alias("claim_key")).agg(F.countDistinct("pair_id").alias("n"), F.min("pair_id").alias("first_pair"))


@Q.add(f"""WITH {RECORDS}, m AS (SELECT scene, priority % 20 AS step, 's' || (seq % 40) AS session, id FROM records WHERE type IN ('work_method', 'tool_experience')),
g AS (SELECT scene, count(DISTINCT session) AS sessions, count(DISTINCT id) AS evidence, least(count(DISTINCT step), 20) AS steps FROM m GROUP BY scene)
SELECT scene, sessions, evidence, steps, sessions >= 3 AND evidence >= 5 AS promoted FROM g""")
def d20_skill_mining(spark, sf):
    method = records(spark, sf).where(F.col("type").isin("work_method", "tool_experience"))
    groups = method.select("scene", (F.col("priority") % 20).alias("step"), (F.col("seq") % 40).alias("session"), "id").groupBy("scene").agg(F.countDistinct("session").alias("sessions"), F.countDistinct("id").alias("evidence"), F.least(F.countDistinct("step"), F.lit(20)).alias("steps"))
    return groups.withColumn("promoted", (F.col("sessions") >= 3) & (F.col("evidence") >= 5))


@Q.add(f"WITH {RECORDS} SELECT id, CASE WHEN retired_reason IS NULL AND priority < 90 AND updated_ms < {NOW - 90 * DAY} THEN 'archived' WHEN retired_reason IS NULL THEN 'active' ELSE 'off' END AS status FROM records")
def d21_archive_due(spark, sf):
    idle = (F.col("priority") < 90) & (F.col("updated_ms") < NOW - 90 * DAY)
    return records(spark, sf).select("id", F.when(F.col("retired_reason").isNotNull(), "off").when(idle, "archived").otherwise("active").alias("status"))


MATURITY = f"""{RECORDS}, {USAGE}, {FEEDBACK}, last AS (SELECT id, arg_max(score, (at_ms, n)) AS mark FROM feedback GROUP BY id),
mat AS (SELECT r.id, least(1.0, greatest(0.0, 0.45 * least(1.0, priority / 100) + 0.3 * least(1.0, coalesce(u.used, 0) / 5) + 0.25 * greatest(0.2, pow(0.5, greatest(0, {NOW} - updated_ms) / {DAY}.0 / 30))
  + 0.3 * CASE mark WHEN 5 THEN 1 WHEN 4 THEN 0.5 WHEN 2 THEN -0.4 WHEN 1 THEN -0.7 WHEN 0 THEN -1 ELSE 0 END)) AS score FROM records r LEFT JOIN usage u ON r.id = u.id LEFT JOIN last l ON r.id = l.id)"""


def with_maturity(spark, sf):
    rows = records(spark, sf).join(O.recall_usage(attempts(spark, sf)).select("id", "used"), "id", "left").join(O.feedback_fold(feedback(spark, sf)).select("id", "last_score"), "id", "left")
    m = C.maturity(F.col("priority"), F.col("used"), C.decay_weight(F.col("updated_ms"), F.lit(NOW), 30, 0.2), F.col("last_score"))
    return rows.withColumn("m", m)


@Q.add(f"WITH {MATURITY} SELECT id, round(score, 6) AS score, CASE WHEN score >= 0.66 THEN 'high' WHEN score >= 0.4 THEN 'mid' ELSE 'low' END AS level FROM mat")
def d22_maturity(spark, sf):
    return with_maturity(spark, sf).select("id", F.round("m.score", 6).alias("score"), "m.level")


@Q.add(f"""WITH {MATURITY}, {PAIRS} SELECT p.pair_id, w.id AS winner, l.id AS loser, round(a.score, 6) AS winner_score, round(b.score, 6) AS loser_score FROM pairs p JOIN records w ON p.winner_id = w.id JOIN records l ON p.loser_id = l.id
  JOIN mat a ON a.id = w.id JOIN mat b ON b.id = l.id WHERE p.resolution IS NULL AND (w.scope = 'global' OR w.workspace_id = 'w1') ORDER BY p.created_ms, p.pair_id LIMIT 100""")
def d23_conflict_list(spark, sf):
    rated = with_maturity(spark, sf).select("id", "scope", "workspace_id", F.col("m.score").alias("score"))
    w, l = rated.alias("w"), rated.alias("l")
    shown = C.scope_visible(F.col("w.scope"), F.col("w.workspace_id"), F.lit("w1"))
    both = pairs(spark, sf).where("resolution is null").join(w, F.col("winner_id") == F.col("w.id")).join(l, F.col("loser_id") == F.col("l.id")).where(shown)
    return both.orderBy("created_ms", "pair_id").limit(100).select("pair_id", F.col("w.id").alias("winner"), F.col("l.id").alias("loser"), F.round("w.score", 6).alias("winner_score"), F.round("l.score", 6).alias("loser_score"))


@Q.add(f"""WITH {SESSION_EVENTS}, e AS (SELECT session_id, seq, CASE WHEN type = 'compaction' AND seq % 5 = 0 THEN 'compaction' WHEN type LIKE '%message' THEN 'inject' END AS kind, length(payload) * 10 AS chars FROM session_events),
r AS (SELECT session_id, max(seq) FILTER (kind = 'compaction') AS reset FROM e GROUP BY 1)
SELECT e.session_id, CAST(coalesce(sum(CAST(ceil(chars / 4) AS BIGINT) + 8) FILTER (kind = 'inject' AND (reset IS NULL OR seq > reset)), 0) AS BIGINT) AS recall_tokens FROM e JOIN r ON e.session_id = r.session_id GROUP BY 1""")
def d24_occupancy(spark, sf):
    e = session_events(spark, sf)
    kind = F.when((F.col("type") == "compaction") & (F.col("seq") % 5 == 0), "compaction").when(F.col("type").endswith("message"), "inject")
    return O.occupancy(e.select("session_id", "seq", kind.alias("kind"), (F.length("payload") * 10).alias("chars")))


@Q.add(f"""WITH {LEDGER}, k AS (SELECT *, row_number() OVER (PARTITION BY provider, model ORDER BY ts_ms, event_id) AS k, count(*) OVER (PARTITION BY provider, model) AS total FROM ledger WHERE ts_ms < {LEDGER_NOW - 2 * DAY})
SELECT provider, model, min(input_chars + 1) AS good_chunk, round(sum((output_tokens + 1) * CASE WHEN k = 1 THEN 1.0 ELSE 0.3 END * pow(0.7, total - k)), 5) AS latency_ema, {LEDGER_NOW} - max(ts_ms) > {2 * DAY + 600000} AS stale FROM k GROUP BY 1, 2""")
def d25_route_health(spark, sf):
    calls = ledger(spark, sf).where(F.col("ts_ms") < LEDGER_NOW - 2 * DAY).select("provider", "model", "ts_ms", F.col("event_id").alias("n"), (F.col("input_chars") + 1).alias("chunk_chars"), (F.col("output_tokens") + 1).alias("latency_ms"))
    return O.route_health(calls, LEDGER_NOW, 2 * DAY + 600_000).withColumn("latency_ema", F.round("latency_ema", 5))


@Q.add(f"WITH {MESSAGES}, e AS (SELECT count(DISTINCT session_id) AS sessions, count(*) AS n, sum(length(text)) AS chars FROM messages) SELECT CAST(greatest(sessions, ceil((chars + 64 * n) / greatest(20000, 64000 - 42000))) AS BIGINT) AS calls FROM e")
def d26_rebuild_estimate(spark, sf):
    e = messages(spark, sf).agg(F.countDistinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    return e.select(F.greatest("sessions", F.ceil((F.col("chars") + 64 * F.col("n")) / max(20000, 64000 - 42000))).alias("calls"))


@Q.add(f"""WITH {PAIRS} SELECT conflict_type, o AS section, count(*) AS n FROM pairs JOIN (VALUES ('hard', 1), ('conditional', 2), ('supersession', 3)) s(t, o) ON conflict_type = t WHERE resolution IS NULL GROUP BY 1, 2""")
def d28_conflict_sections(spark, sf):
    order = spark.createDataFrame([("hard", 1), ("conditional", 2), ("supersession", 3)], "conflict_type string, section int")
    return pairs(spark, sf).where("resolution is null").join(F.broadcast(order), "conflict_type").groupBy("conflict_type", "section").agg(F.count(F.lit(1)).alias("n"))
