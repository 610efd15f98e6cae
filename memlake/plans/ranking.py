"""Queries of windows, budgets and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import columns as C
from memlake.operators import ranking as O
from memlake.plans.analytics import PAIRS, pairs
from memlake.plans.filters import KEY
from memlake.plans.registry import Queries
from memlake.sources.derived import DAY, MESSAGES, NOW, RECORDS, SESSION_EVENTS, messages, read, records, session_events

Q = Queries()


@Q.add(f"WITH {MESSAGES}, b AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms DESC, id DESC) AS back, count(*) OVER (PARTITION BY session_id) AS c FROM messages) SELECT session_id, id, least(c, 3) - back + 1 AS place FROM b WHERE back <= 3")
def e1_recent_per_session(spark, sf):
    return O.recent_per_session(messages(spark, sf), 3).select("session_id", "id", "place")


@Q.add("""WITH r AS (SELECT event_id, 'run' || (user_id * 7 % 31) AS run_id, (epoch_us(ts) // 1000) AS decided_ms FROM events), k AS (SELECT run_id FROM r GROUP BY run_id ORDER BY max(decided_ms) DESC, run_id DESC LIMIT 10)
SELECT run_id, count(*) AS n, min(event_id) AS first_id FROM r WHERE run_id IN (SELECT run_id FROM k) GROUP BY run_id""")
def e2_receipts_retention(spark, sf):
    from memlake.sources.derived import epoch_ms

    receipts = read(spark, sf, "events").select("event_id", F.concat(F.lit("run"), (F.col("user_id") * 7 % 31).cast("string")).alias("run_id"), epoch_ms(F.col("ts")).alias("decided_ms"))
    return O.latest_runs(receipts, 10).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


SUFFIX = "...(cut)"


@Q.add(f"""WITH {MESSAGES}, l AS (SELECT session_id AS query_id, n AS rank, CASE WHEN length(text) <= 200 THEN text ELSE rtrim(substr(text, 1, {200 - len(SUFFIX)})) || '{SUFFIX}' END AS line FROM messages),
r AS (SELECT *, 600 - coalesce(sum(length(line) + 1) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM l),
o AS (SELECT *, sum(CASE WHEN length(line) > room THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS overs FROM r)
SELECT query_id, rank, CASE WHEN length(line) <= room THEN line ELSE rtrim(substr(line, 1, CAST(room - {len(SUFFIX)} AS INT))) || '{SUFFIX}' END AS line FROM o WHERE overs = 0 OR (overs = 1 AND length(line) > room AND room >= 40)""")
def e3_recall_budget(spark, sf):
    lines = messages(spark, sf).select(F.col("session_id").alias("query_id"), F.col("n").alias("rank"), F.col("text").alias("line"))
    return O.recall_budget(lines, 200, 600, SUFFIX)


@Q.add(f"""WITH {RECORDS}, s AS (SELECT scene AS owner, id, priority, strlen(content) AS b FROM records WHERE seq % 2 = 0 AND seq % 3 <> 0),
k AS (SELECT *, row_number() OVER w AS k, sum(b) OVER (PARTITION BY owner ORDER BY priority DESC, id ROWS UNBOUNDED PRECEDING) AS s FROM s WINDOW w AS (PARTITION BY owner ORDER BY priority DESC, id))
SELECT owner, id, sum(CASE WHEN s > 5000 AND k > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY owner ORDER BY priority DESC, id ROWS UNBOUNDED PRECEDING) = 0 AS fits FROM k""")
def e4_slot_budget(spark, sf):
    slots = records(spark, sf).select(F.col("scene").alias("owner"), "id", "priority", F.col("content").alias("body"), (F.col("seq") % 2 == 0).alias("pinned"), F.when(F.col("seq") % 3 == 0, "done").otherwise("open").alias("status"))
    return O.slot_budget(slots, 5000)


@Q.add(f"""WITH {RECORDS}, h AS (SELECT lang AS query_id, 'p' || (seq % 3) AS provider, row_number() OVER (PARTITION BY lang, seq % 3 ORDER BY seq) AS rank, {KEY.format('content')} AS key, seq FROM records),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY rank, provider) AS again FROM h), d AS (SELECT query_id, provider, seq, row_number() OVER (PARTITION BY query_id, provider ORDER BY rank) AS rank FROM f WHERE again = 1),
p AS (SELECT query_id, provider, seq, row_number() OVER (PARTITION BY query_id ORDER BY rank, provider) AS place FROM d) SELECT * FROM p WHERE place <= 60""")
def e5_rank_interleave(spark, sf):
    from pyspark.sql import Window as W

    rows = records(spark, sf).select("lang", "seq", O.digest_of(F.col("content")).alias("digest"))  # no text goes through the windows
    rank = F.row_number().over(W.partitionBy("lang", F.col("seq") % 3).orderBy("seq"))
    hits = rows.select(F.col("lang").alias("query_id"), F.concat(F.lit("p"), (F.col("seq") % 3).cast("string")).alias("provider"), rank.alias("rank"), "digest", "seq")
    return O.interleave(hits, 60).select("query_id", "provider", "seq", "place")


@Q.add(f"""WITH RECURSIVE {MESSAGES}, o AS (SELECT session_id, id, length(text) + 64 AS n, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms, id) AS k FROM messages),
c(session_id, id, k, s, chunk) AS (SELECT session_id, id, k, n, 0 FROM o WHERE k = 1 UNION ALL SELECT o.session_id, o.id, o.k, CASE WHEN c.s + o.n > 700 THEN o.n ELSE c.s + o.n END, CASE WHEN c.s + o.n > 700 THEN c.chunk + 1 ELSE c.chunk END FROM c JOIN o ON o.session_id = c.session_id AND o.k = c.k + 1)
SELECT session_id, id, CAST(chunk AS INT) AS chunk FROM c""")
def e6_char_budget_chunks(spark, sf):
    return O.char_chunks(messages(spark, sf), 700)


@Q.add(f"""WITH {RECORDS}, c AS (SELECT type, count(*) AS n FROM records GROUP BY type), t AS (SELECT *, n * 100 / sum(n) OVER () AS exact FROM c),
s AS (SELECT *, least(n, greatest(1, CAST(floor(exact) AS BIGINT))) AS share, exact - floor(exact) AS rest FROM t), q AS (SELECT *, share + CASE WHEN row_number() OVER (ORDER BY rest DESC, type) <= 100 - sum(share) OVER () AND share < n THEN 1 ELSE 0 END AS quota FROM s),
r AS (SELECT id, type, row_number() OVER (PARTITION BY type ORDER BY id) - 1 AS at_row FROM records), w AS (SELECT type, CAST(floor(j.j * n / quota) AS BIGINT) AS at_row FROM q, range(0, 100) j(j) WHERE j.j < quota)
SELECT r.id, r.type FROM r JOIN w ON r.type = w.type AND r.at_row = w.at_row""")
def e7_stratified_sample(spark, sf):
    return O.stratified(records(spark, sf), 100)


@Q.add(f"""WITH {SESSION_EVENTS}, m AS (SELECT *, lag(type) OVER w AS b, lag(seq) OVER w AS s FROM session_events WHERE turn IS NOT NULL WINDOW w AS (PARTITION BY session_id, turn ORDER BY seq)),
l AS (SELECT session_id, turn, max(seq) AS end_seq, arg_max(s, seq) AS start_seq FROM m WHERE type = 'turn/end' AND b = 'turn/start' AND turn > 2 GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS k FROM l) SELECT session_id, turn, start_seq, end_seq FROM k WHERE k <= 2""")
def e8_latest_turn_bracket(spark, sf):
    return O.turn_brackets(session_events(spark, sf), 2)


LOG = f"log AS (SELECT session_id, seq, CASE WHEN type = 'compaction' THEN 'compact' ELSE 'add' END AS kind, 'r' || (seq % 300) AS id, seq % 11 = 0 AS protected FROM session_events)"


@Q.add(f"""WITH {SESSION_EVENTS}, {LOG}, a AS (SELECT session_id, id, max(seq) AS added, bool_or(protected) AS protected FROM log WHERE kind = 'add' GROUP BY 1, 2), c AS (SELECT session_id, max(seq) AS cut FROM log WHERE kind = 'compact' GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id, protected ORDER BY added DESC, id) AS k FROM a)
SELECT k.session_id, id, protected, coalesce(cut > added, false) AS superseded FROM k LEFT JOIN c ON k.session_id = c.session_id WHERE protected OR k <= 20""")
def e9_injected_set_cap(spark, sf):
    e = session_events(spark, sf)
    log = e.select("session_id", "seq", F.when(F.col("type") == "compaction", "compact").otherwise("add").alias("kind"), F.concat(F.lit("r"), (F.col("seq") % 300).cast("string")).alias("id"), (F.col("seq") % 11 == 0).alias("protected"))
    return O.injected_set(log, 20)


@Q.add(f"WITH {RECORDS} SELECT id, CASE WHEN seq % 2 = 0 AND seq % 3 = 0 THEN 'cleared' WHEN seq % 3 = 0 THEN 'superseded' ELSE 'unchanged' END AS mark FROM records")
def e10_reconcile_visible(spark, sf):
    rows = records(spark, sf)
    return O.visible_state(rows.select("id"), rows.where("seq % 3 = 0"), rows.where("seq % 6 = 0"))


@Q.add(f"""WITH {RECORDS}, b AS (SELECT id, CAST(seq % 7 AS INT) AS anchors, seq % 5 = 0 AS done, updated_ms AS ord, seq % 4 + 1 AS calls FROM records), o AS (SELECT * FROM b WHERE anchors > 0 AND NOT done ORDER BY ord, id LIMIT 200),
p AS (SELECT id FROM (SELECT id, sum(calls) OVER (ORDER BY ord, id ROWS UNBOUNDED PRECEDING) AS s FROM o) WHERE s <= 300)
SELECT id, CASE WHEN done THEN 'done' WHEN anchors = 0 THEN 'free' WHEN id IN (SELECT id FROM p) THEN 'planned' ELSE 'deferred' END AS fate FROM b""")
def e12_budget_plan(spark, sf):
    rows = records(spark, sf).select("id", (F.col("seq") % 7).alias("anchors"), (F.col("seq") % 5 == 0).alias("done"), F.col("updated_ms").alias("order"), (F.col("seq") % 4 + 1).alias("calls"))
    return O.budget_plan(rows, 200, 300)


PLANNED = f"""{RECORDS}, b AS (SELECT id, least(seq % 12, 8) AS anchors, seq % 5 = 0 AND seq % 12 > 0 AS gone, updated_ms AS ord, length(content) AS chars FROM records), o AS (SELECT * FROM b WHERE NOT gone ORDER BY ord, id LIMIT 200),
c AS (SELECT id, CASE WHEN anchors = 0 THEN 'free' WHEN sum(CASE WHEN anchors > 0 THEN 1 ELSE 0 END) OVER (ORDER BY ord, id ROWS UNBOUNDED PRECEDING) <= 120 THEN 'planned' ELSE 'over-calls' END AS fate FROM o),
p AS (SELECT b.id, CASE WHEN gone THEN 'done' ELSE coalesce(c.fate, 'over-records') END AS fate, anchors, chars FROM b LEFT JOIN c ON c.id = b.id)"""


def verified(spark, sf):
    k = F.col("seq")
    return O.verification_plan(records(spark, sf).select("id", F.col("updated_ms").alias("order"), F.length("content").alias("chars"), (k % 12).alias("anchors"), (k % 5 == 0).alias("done")), 200, 8, 12_000, 120)


@Q.add(f"WITH {PLANNED} SELECT id, fate, anchors FROM p")
def e12_verification_plan(spark, sf):
    return verified(spark, sf)[0]


@Q.add(f"""WITH {PLANNED} SELECT count(*) AS total, count(*) FILTER (fate = 'planned') AS calls, count(*) FILTER (anchors = 0) AS without_anchor, count(*) FILTER (fate = 'done') AS done, count(*) FILTER (fate = 'over-records') AS over_records, count(*) FILTER (fate = 'over-calls') AS over_calls,
  sum(anchors) FILTER (fate IN ('planned', 'free'))::BIGINT AS anchors, sum(chars + CASE WHEN anchors > 0 THEN 12000 ELSE 0 END) FILTER (fate IN ('planned', 'free'))::BIGINT AS chars, ceil(sum(chars + CASE WHEN anchors > 0 THEN 12000 ELSE 0 END) FILTER (fate IN ('planned', 'free')) / 4)::BIGINT AS tokens FROM p""")
def e12_verification_estimate(spark, sf):
    return verified(spark, sf)[1]


@Q.add(f"""WITH {SESSION_EVENTS}, o AS (SELECT *, last_value(CASE WHEN type = 'turn/start' THEN turn END IGNORE NULLS) OVER w AS open, count(*) FILTER (type = 'turn/start') OVER w AS seg FROM session_events WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT session_id, seq, coalesce(turn, open) AS turn, count(*) FILTER (type = 'assistant/message') OVER (PARTITION BY session_id, seg ORDER BY seq ROWS UNBOUNDED PRECEDING) AS step FROM o WHERE seg > 0""")
def e13_fold_event_coordinates(spark, sf):
    return O.fold_coordinates(session_events(spark, sf)).select("session_id", "seq", "turn", "step")


@Q.add(f"WITH {MESSAGES} SELECT session_id, min(ts_ms) OVER (PARTITION BY session_id) AS first_ms, id, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms, id) AS place FROM messages WHERE turn IS NULL")
def e14_pending_slices(spark, sf):
    return O.pending_slices(messages(spark, sf))


HITS = "hits AS (SELECT scene AS query_id, id, row_number() OVER (PARTITION BY scene ORDER BY priority DESC, id) AS rank, priority / 100.0 AS score, wing, updated_ms, content, tags, seq FROM records)"


def hits(spark, sf):
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("scene").orderBy(F.desc("priority"), "id"))
    return records(spark, sf).select(F.col("scene").alias("query_id"), "id", rank.alias("rank"), (F.col("priority") / 100.0).alias("score"), "wing", "updated_ms", "content", "tags", "seq")


@Q.add(f"""WITH {RECORDS}, {HITS}, w(wing, weight) AS (VALUES ('work', 0.75), ('health', 0.4)) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(w.weight, 1.0) DESC, score DESC, rank) AS place FROM hits h LEFT JOIN w ON h.wing = w.wing""")
def f1_domain_sort(spark, sf):
    weights = spark.createDataFrame([("work", 0.75), ("health", 0.4)], "wing string, weight double")
    weighed = hits(spark, sf).join(F.broadcast(weights), "wing", "left")
    return O.reordered(weighed, F.coalesce("weight", F.lit(1.0)).desc(), F.desc("score")).select("query_id", "id", "place")


KEYWORDS = [("work", "und"), ("work", "the of"), ("health", "les la"), ("home", "zebra"), ("finance", "del")]


@Q.add(f"""WITH k(wing, keyword) AS (VALUES {', '.join(str(k) for k in KEYWORDS)}), s AS (SELECT conv_id || ':' || turn AS query_id, wing, bool_or(contains(lower(text), keyword)) AS hit FROM conversations, k GROUP BY 1, 2)
SELECT query_id, wing, CAST(CASE WHEN NOT bool_or(hit) OVER (PARTITION BY query_id) THEN 1.0 WHEN hit THEN 0.75 ELSE 0.4 END AS DOUBLE) AS weight FROM s""")
def f2_domain_weights(spark, sf):
    keywords = spark.createDataFrame(KEYWORDS, "wing string, keyword string")
    return O.keyword_weights(messages(spark, sf).select(F.col("id").alias("query_id"), F.col("text").alias("query")), keywords)


@Q.add("""WITH a AS (SELECT 'wing' || vec_id AS wing, embedding AS e FROM embeddings WHERE vec_id < 8), q AS (SELECT vec_id, embedding AS e FROM embeddings),
s AS (SELECT vec_id, wing, list_sum(list_transform(list_zip(q.e, a.e), lambda z: CAST(z[1] AS DOUBLE) * z[2])) / (sqrt(list_sum(list_transform(q.e, lambda z: CAST(z AS DOUBLE) * z))) * sqrt(list_sum(list_transform(a.e, lambda z: CAST(z AS DOUBLE) * z)))) AS c FROM q, a)
SELECT vec_id, wing, round(0.4 + 0.6 * greatest(0.0, least(1.0, coalesce(c, 0.0))), 6) AS weight FROM s""")
def f2_vector_gate(spark, sf):
    """Every vector's weight for each of eight domains, whose anchors are an array in one row."""
    e = read(spark, sf, "embeddings")
    anchors = e.where("vec_id < 8").agg(F.collect_list(F.struct(F.concat(F.lit("wing"), F.col("vec_id").cast("string")).alias("wing"), F.col("embedding").alias("anchor"))).alias("anchors"))
    near = e.join(F.broadcast(anchors)).select("vec_id", "embedding", F.explode("anchors").alias("a"))
    return near.select("vec_id", "a.wing", F.round(O.vector_weight(C.cosine(F.col("embedding"), F.col("a.anchor"))), 6).alias("weight"))


@Q.add(f"""WITH {RECORDS}, {HITS}, m AS (SELECT *, (SELECT coalesce(max(len(list_intersect(['t3', 'area2', 'x', 't5'], list_distinct(regexp_extract_all(lower(u.p), '[0-9a-z]{{2,}}'))))), 0) FROM unnest(tags) u(p)) AS m FROM hits)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY m DESC, rank) AS place FROM m""")
def f3_usage_sort(spark, sf):
    return O.reordered(hits(spark, sf), O.overlap(F.lit("t3 area2 x t5"), F.col("tags")).desc()).select("query_id", "id", "place")


@Q.add(f"""WITH {RECORDS}, {HITS} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY CASE CASE WHEN seq % 3 = 0 THEN seq % 7 - 1 END WHEN 5 THEN 1.0 WHEN 4 THEN 0.5 WHEN 2 THEN -0.4 WHEN 1 THEN -0.7 WHEN 0 THEN -1.0 ELSE 0 END DESC, rank) AS place FROM hits""")
def f4_human_mark_sort(spark, sf):
    mark = F.when(F.col("seq") % 3 == 0, F.col("seq") % 7 - 1)
    return O.reordered(hits(spark, sf), C.mark_signal(mark).desc()).select("query_id", "id", "place")


@Q.add(f"""WITH {RECORDS}, {HITS} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(CAST(score AS DOUBLE) * greatest(0.5, pow(0.5, greatest(0, {NOW} - updated_ms) / {DAY}.0 / 30)), 9) DESC, rank) AS place FROM hits""")
def f5_decay_sort(spark, sf):
    key = F.round(F.col("score") * C.decay_weight(F.col("updated_ms"), F.lit(NOW), 30), 9)
    return O.reordered(hits(spark, sf), key.desc()).select("query_id", "id", "place")


@Q.add(f"WITH {PAIRS} SELECT pair_id, coalesce(deferred_ms, created_ms) AS since FROM pairs WHERE resolution IS NULL AND coalesce(deferred_ms, created_ms) < 946684800000 AND defer_count < 3 ORDER BY 2, 1 LIMIT 50")
def f6_conflict_queue(spark, sf):
    return O.conflict_queue(pairs(spark, sf), 946_684_800_000, 50).select("pair_id", "since")


@Q.add("""WITH s AS (SELECT CAST(p_partkey AS VARCHAR) AS id, replace(p_name, ' ', '-') AS stem FROM part), taken AS (SELECT replace(p_name, ' ', '-') || '-3' AS name FROM part WHERE p_partkey % 50 = 0),
c AS (SELECT stem, n, CASE WHEN n = 1 THEN stem ELSE left(stem, CAST(39 - length(CAST(n AS VARCHAR)) AS INT)) || '-' || n END AS name FROM (SELECT DISTINCT stem FROM s), range(1, 1000) r(n)),
f AS (SELECT stem, name, row_number() OVER (PARTITION BY stem ORDER BY n) AS k FROM c WHERE name NOT IN (SELECT name FROM taken)), r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY id) AS k FROM s)
SELECT r.id, coalesce(f.name, 'mem-' || right(r.id, 8)) AS name FROM r LEFT JOIN f ON r.stem = f.stem AND r.k = f.k""")
def e11_unique_name_alloc(spark, sf):
    part = read(spark, sf, "part")
    stems = part.select(F.col("p_partkey").cast("string").alias("id"), F.regexp_replace("p_name", " ", "-").alias("stem"))
    taken = part.where("p_partkey % 50 = 0").select(F.concat(F.regexp_replace("p_name", " ", "-"), F.lit("-3")).alias("name")).distinct()
    return O.unique_names(stems, taken)
