"""Queries of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.operators import joins as O
from memlake.plans.filters import KEY
from memlake.plans.registry import Queries
from memlake.sources.derived import DAY, MESSAGES, NOW, RECORDS, messages, read, records

Q = Queries()


def rid(c):
    return F.concat(F.lit("r"), c.cast("string"))


@Q.add(f"WITH {RECORDS}, h AS (SELECT 'r' || ((item_id * 7) % 1500) AS id, item_id AS rank FROM benchmark) SELECT h.id, h.rank, r.priority, r.type FROM h JOIN records r ON h.id = r.id")
def c1_hydrate_hits(spark, sf):
    hits = read(spark, sf, "benchmark").select(rid((F.col("item_id") * 7) % 1500).alias("id"), F.col("item_id").alias("rank"))
    return hits.join(records(spark, sf), "id").select("id", "rank", "priority", "type")


@Q.add(f"WITH {RECORDS} SELECT id FROM records WHERE retired_reason IS NULL AND id NOT IN (SELECT 'r' || vec_id FROM embeddings) AND id NOT IN (SELECT 'r' || doc_id FROM labels WHERE toxic = 1)")
def c2_missing_vectors(spark, sf):
    vectors = read(spark, sf, "embeddings").select(rid(F.col("vec_id")).alias("id"))
    skipped = read(spark, sf, "labels").where("toxic = 1").select(rid(F.col("doc_id")).alias("id"))
    return O.missing(records(spark, sf).where("retired_reason is null").select("id"), vectors, skipped)


@Q.add(f"""WITH {RECORDS} SELECT id, version, updated_ms FROM records r WHERE retired_reason IS NULL AND NOT EXISTS (SELECT 1 FROM labels l WHERE 'r' || l.doc_id = r.id AND l.quality + 1 = r.version)
  AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE 'r' || e.vec_id = r.id AND e.label < 3) ORDER BY updated_ms, id LIMIT 100""")
def c3_missing_projection(spark, sf):
    done = read(spark, sf, "labels").select(rid(F.col("doc_id")).alias("id"), (F.col("quality") + 1).alias("version"))
    queued = read(spark, sf, "embeddings").where("label < 3").select(rid(F.col("vec_id")).alias("id"))
    live = records(spark, sf).where("retired_reason is null").join(done, ["id", "version"], "left_anti")
    return O.missing(live, queued).orderBy("updated_ms", "id").limit(100).select("id", "version", "updated_ms")


@Q.add(f"""WITH {MESSAGES}, open AS (SELECT * FROM messages WHERE turn IS NULL AND role IN ('user', 'assistant')),
seg AS (SELECT session_id, role, CAST(n AS INT) AS turn, CAST(0 AS INT) AS step, ts_ms + (conv_id % 4) * 25000 AS time_ms FROM messages WHERE conv_id % 6 <> 0 AND n > 0 AND (role = 'user' OR conv_id % 9 <> 3)),
j AS (SELECT o.id, s.turn, s.step, abs(s.time_ms - o.ts_ms) AS d, s.time_ms FROM open o JOIN seg s ON o.session_id = s.session_id AND o.role = s.role AND abs(s.time_ms - o.ts_ms) <= 90000),
b AS (SELECT id, count(DISTINCT turn) AS turns, arg_min(turn, (d, time_ms, turn)) AS turn, arg_min(step, (d, time_ms, turn)) AS step, min(d) AS d FROM j GROUP BY id),
r AS (SELECT o.id, CASE WHEN o.session_id NOT IN (SELECT session_id FROM seg) THEN 'no-session' WHEN NOT EXISTS (SELECT 1 FROM seg s WHERE s.session_id = o.session_id AND s.role = o.role) THEN 'no-role'
  WHEN turns IS NULL THEN 'out-of-window' WHEN turns > 1 THEN 'ambiguous-turn' END AS skip, b.turn, b.step, b.d FROM open o LEFT JOIN b ON o.id = b.id)
SELECT id, skip, CASE WHEN skip IS NULL THEN turn END AS turn, CASE WHEN skip IS NULL THEN step END AS step, CASE WHEN skip IS NULL THEN d END AS delta_ms FROM r""")
def c4_nearest_in_window(spark, sf):
    rows = messages(spark, sf)
    open_ = rows.where("turn is null and role in ('user', 'assistant')")
    seg = rows.where("conv_id % 6 <> 0 and n > 0 and (role = 'user' or conv_id % 9 <> 3)").select("session_id", "role", F.col("n").cast("int").alias("turn"), F.lit(0).alias("step"), (F.col("ts_ms") + (F.col("conv_id") % 4) * 25_000).alias("time_ms"))
    return O.nearest_in_window(open_, seg)


JOURNAL = f"""journal AS (SELECT id, 'retire' AS ev, CASE WHEN seq % 3 = 0 THEN 'manual' WHEN seq % 3 = 1 THEN 'conflict' ELSE 'merge' END AS reason, sha256({KEY.format('content')}) AS hash, seq FROM records WHERE seq % 5 = 0
  UNION ALL SELECT id, 'restore', NULL, NULL, seq + 1000000 FROM records WHERE seq % 20 = 0)"""
TOMBS = "stones AS (SELECT hash, arg_max(reason, seq) AS reason FROM (SELECT id, arg_max(ev, seq) AS ev, arg_max(reason, seq) FILTER (true) AS reason, arg_max(hash, seq) AS hash, max(seq) AS seq FROM journal GROUP BY id) WHERE ev = 'retire' AND reason IN ('manual', 'conflict') GROUP BY hash)"


def journal(spark, sf):
    from memlake.functions.columns import content_digest

    rows = records(spark, sf)
    reason = F.when(F.col("seq") % 3 == 0, "manual").when(F.col("seq") % 3 == 1, "conflict").otherwise("merge")
    retired = rows.where("seq % 5 = 0").select("id", F.lit("retire").alias("ev"), reason.alias("reason"), content_digest(F.col("content")).alias("hash"), "seq")
    none = F.lit(None).cast("string")
    return retired.union(rows.where("seq % 20 = 0").select("id", F.lit("restore"), none, none, F.col("seq") + 1_000_000))


@Q.add(f"WITH {RECORDS}, {JOURNAL}, {TOMBS} SELECT r.id, s.reason FROM records r JOIN stones s ON sha256({KEY.format('r.content')}) = s.hash")
def c5_tombstone_suppress(spark, sf):
    return O.suppressed(records(spark, sf), journal(spark, sf))


@Q.add(f"""WITH {RECORDS}, db AS (SELECT id AS key, {KEY.format('content')} AS d FROM records WHERE seq % 7 <> 0), f AS (SELECT id AS key, {KEY.format("content || CASE WHEN seq % 9 = 0 THEN ' x' ELSE '' END")} AS d FROM records WHERE seq % 5 <> 0),
rem AS (SELECT id AS key, {KEY.format("content || CASE WHEN seq % 4 = 0 THEN ' y' ELSE '' END")} AS d FROM records WHERE seq % 3 <> 0 UNION ALL SELECT id, 'other' FROM records WHERE seq % 8 = 0),
r AS (SELECT key, list(DISTINCT d) AS ds FROM rem GROUP BY key),
j AS (SELECT coalesce(db.key, f.key, r.key) AS key, db.d AS b, f.d AS f, r.ds FROM db FULL JOIN f ON db.key = f.key FULL JOIN r ON r.key = coalesce(db.key, f.key)),
v AS (SELECT key, CASE WHEN f IS NULL AND ds IS NULL THEN 'db-only/rewrite-file' WHEN b IS NULL AND ds IS NULL THEN 'file-only/reimport-db' WHEN b IS NULL AND f IS NULL THEN 'remote-only/pull'
  WHEN ds IS NULL THEN CASE WHEN b = f THEN 'db-file/none' ELSE 'all-differ/conflict' END WHEN f IS NULL THEN CASE WHEN list_contains(ds, b) THEN 'db-remote/rewrite-file' ELSE 'db-remote/push' END
  WHEN b IS NULL THEN CASE WHEN list_contains(ds, f) THEN 'file-remote/reimport-db' ELSE 'file-remote/pull' END
  WHEN b = f AND list_contains(ds, b) THEN 'all-same/none' WHEN b = f THEN 'db-file/push' WHEN list_contains(ds, b) THEN 'db-remote/rewrite-file' WHEN list_contains(ds, f) THEN 'file-remote/reimport-db' ELSE 'all-differ/conflict' END AS v FROM j)
SELECT key, split_part(v, '/', 1) AS verdict, split_part(v, '/', 2) AS action FROM v""")
def c6_three_way_diff(spark, sf):
    rows = records(spark, sf)
    changed = lambda m, tail: F.concat("content", F.when(F.col("seq") % m == 0, tail).otherwise(""))
    db = rows.where("seq % 7 <> 0").select(F.col("id").alias("key"), "content")
    file = rows.where("seq % 5 <> 0").select(F.col("id").alias("key"), changed(9, " x").alias("content"))
    remote = rows.where("seq % 3 <> 0").select(F.col("id").alias("key"), changed(4, " y").alias("content")).union(rows.where("seq % 8 = 0").select("id", F.lit("other")))
    return O.three_way(db, file, remote)


SOURCED = "sourced AS (SELECT *, CASE WHEN seq % 4 = 0 THEN CAST([] AS VARCHAR[]) ELSE [(seq % 90) || ':0', (seq % 90) || ':' || (seq % 5)] END AS source_message_ids FROM records)"


def sourced(spark, sf):
    k = F.col("seq")
    first = F.concat((k % 90).cast("string"), F.lit(":"))
    ids = F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(first, F.lit("0")), F.concat(first, (k % 5).cast("string"))))
    return records(spark, sf).withColumn("source_message_ids", ids)


@Q.add(f"""WITH {RECORDS}, {SOURCED}, {MESSAGES} SELECT id, len(source_message_ids) > 0 AND len(list_filter(source_message_ids, lambda x: x NOT IN (SELECT id FROM messages WHERE n < 4))) = 0 AS covered FROM sourced""".replace(
    "len(list_filter(source_message_ids, lambda x: x NOT IN (SELECT id FROM messages WHERE n < 4))) = 0", "NOT EXISTS (SELECT 1 FROM unnest(source_message_ids) u(x) WHERE x NOT IN (SELECT id FROM messages WHERE n < 4))"))
def c10_sources_covered(spark, sf):
    return O.sources_covered(sourced(spark, sf), messages(spark, sf).where("n < 4"))


@Q.add(f"""WITH {RECORDS}, {SOURCED}, {MESSAGES}, c AS (SELECT id, seq, len(source_message_ids) > 0 AS s, len(source_message_ids) > 0 AND NOT EXISTS (SELECT 1 FROM unnest(source_message_ids) u(x) WHERE x NOT IN (SELECT id FROM messages WHERE n < 4)) AS covered FROM sourced WHERE seq % 10 <> 0),
l AS (SELECT id, CASE WHEN seq % 50 = 7 THEN ' ' ELSE content END AS now FROM records WHERE seq % 6 <> 0),
j AS (SELECT coalesce(c.id, l.id) AS id, c.id AS c_id, l.id AS l_id, s, covered, now FROM c FULL JOIN l ON c.id = l.id)
SELECT id, CASE WHEN c_id IS NULL THEN 'unprovenanced' WHEN l_id IS NULL THEN CASE WHEN s THEN 'gone' ELSE 'retired-no-source' END WHEN s AND covered THEN 'rederivable' WHEN trim(now) = '' THEN 'empty-content' WHEN s THEN 'post-watermark' ELSE 'no-source' END AS fate FROM j""")
def c7_plan_preserve(spark, sf):
    facts = sourced(spark, sf).where("seq % 10 <> 0")
    live = records(spark, sf).where("seq % 6 <> 0").select("id", F.when(F.col("seq") % 50 == 7, " ").otherwise(F.col("content")).alias("content"))
    return O.plan_preserve(facts, live, messages(spark, sf).where("n < 4"))


REMOTE = "remote AS (SELECT 'ext' || (seq // 2 * 2) AS external_id, CASE WHEN seq % 40 = 0 THEN '  ' WHEN seq % 3 = 0 THEN content || ' new' ELSE content END AS content, CASE WHEN seq % 9 = 0 THEN 'other' ELSE 'work' END AS category, seq AS n FROM records)"
SHADOW = f"shadow AS (SELECT 'ext' || seq AS external_id, CASE WHEN seq % 28 = 0 THEN 'missing' ELSE id END AS record_id, sha256({KEY.format('content')}) || CASE WHEN seq % 5 = 0 THEN 'x' ELSE '' END AS db_digest, {KEY.format('content')} AS content_norm FROM records WHERE seq % 4 = 0)"


@Q.add(f"""WITH {RECORDS}, {JOURNAL}, {TOMBS}, {REMOTE}, {SHADOW}, f AS (SELECT external_id, arg_min(content, n) AS content, arg_min(category, n) AS category FROM remote GROUP BY 1), k AS (SELECT *, {KEY.format('content')} AS norm FROM f)
SELECT k.external_id, CASE WHEN norm = '' THEN 'blank' WHEN s.db_digest IS NOT NULL AND s.content_norm = norm THEN 'unchanged' WHEN s.db_digest IS NOT NULL AND r.id IS NULL THEN 'purged'
  WHEN s.db_digest IS NOT NULL AND sha256({KEY.format('r.content')}) <> s.db_digest THEN 'both_dirty' WHEN t.hash IS NOT NULL THEN 'tombstoned' WHEN s.db_digest IS NOT NULL THEN 'refresh' WHEN category NOT IN ('work') THEN 'filtered'
  WHEN k.external_id IN (SELECT ext_key FROM records WHERE ext_key IS NOT NULL) THEN 'relink' ELSE 'import' END AS verdict
FROM k LEFT JOIN shadow s ON k.external_id = s.external_id LEFT JOIN records r ON s.record_id = r.id LEFT JOIN stones t ON t.hash = sha256(norm)""")
def c8_external_reconcile(spark, sf):
    from memlake.functions.columns import content_digest, content_key

    rows, k = records(spark, sf), F.col("seq")
    content = F.when(k % 40 == 0, "  ").when(k % 3 == 0, F.concat("content", F.lit(" new"))).otherwise(F.col("content"))
    remote = rows.select(F.concat(F.lit("ext"), (F.floor(k / 2) * 2).cast("string")).alias("external_id"), content.alias("content"), F.when(k % 9 == 0, "other").otherwise("work").alias("category"), k.alias("n"))
    shadow = rows.where("seq % 4 = 0").select(F.concat(F.lit("ext"), k.cast("string")).alias("external_id"), F.when(k % 28 == 0, "missing").otherwise(F.col("id")).alias("record_id"), F.concat(content_digest(F.col("content")), F.when(k % 5 == 0, "x").otherwise("")).alias("db_digest"), content_key(F.col("content")).alias("content_norm"))
    return O.external_reconcile(remote, shadow, rows, journal(spark, sf), ["work"])


@Q.add(f"""WITH {RECORDS}, p AS (SELECT id AS record_id, {KEY.format('content')} AS content_norm, created_ms + {100 * DAY} AS deadline_ms FROM records WHERE seq % 3 = 0), l AS (SELECT {KEY.format('content')} AS norm, 'e' || arg_min(seq, -seq) AS external_id FROM records WHERE seq % 2 = 0 GROUP BY 1)
SELECT record_id, external_id, CASE WHEN external_id IS NOT NULL THEN 'settled' WHEN deadline_ms < {NOW} + {60 * DAY} THEN 'orphan' ELSE 'pending' END AS state FROM p LEFT JOIN l ON p.content_norm = l.norm""")
def c9_settle_by_content(spark, sf):
    from memlake.functions.columns import content_key

    rows = records(spark, sf)
    pending = rows.where("seq % 3 = 0").select(F.col("id").alias("record_id"), content_key(F.col("content")).alias("content_norm"), (F.col("created_ms") + 100 * DAY).alias("deadline_ms"))
    listing = rows.where("seq % 2 = 0").select("content", F.concat(F.lit("e"), F.col("seq").cast("string")).alias("external_id"), (-F.col("seq")).alias("n"))
    return O.settle(pending, listing, NOW + 60 * DAY)


@Q.add(f"WITH {RECORDS} SELECT p.path FROM (SELECT type || '/' || id || '.md' AS path FROM records WHERE seq % 3 <> 1) p WHERE p.path NOT IN (SELECT type || '/' || id || '.md' FROM records WHERE retired_reason IS NULL)")
def c11_orphan_targets(spark, sf):
    path = F.concat("type", F.lit("/"), "id", F.lit(".md")).alias("path")
    rows = records(spark, sf)
    return O.missing(rows.where("seq % 3 <> 1").select(path), rows.where("retired_reason is null").select(path), key="path")


@Q.add(f"""WITH RECURSIVE {RECORDS}, c(id, at_id, seen, n) AS (SELECT id, superseded_by, [id], 0 FROM records WHERE superseded_by IS NOT NULL
  UNION ALL SELECT c.id, r.superseded_by, list_append(c.seen, r.id), c.n + 1 FROM c JOIN records r ON c.at_id = r.id WHERE NOT list_contains(c.seen, r.id) AND c.n < 5)
SELECT id, array_to_string(arg_max(seen, n)[2:], ',') AS chain FROM c GROUP BY id""")
def c12_supersede_chain(spark, sf):
    return O.supersede_chain(records(spark, sf)).select("id", F.array_join("chain", ",").alias("chain"))


@Q.add(f"""WITH {RECORDS}, {SOURCED}, {MESSAGES}, e AS (SELECT id, unnest(source_message_ids) AS m FROM sourced)
SELECT e.id, array_to_string(list_sort(list(DISTINCT session_id || '/' || turn || '/' || step)), ',') AS anchors FROM e JOIN messages ON m = messages.id WHERE turn IS NOT NULL GROUP BY e.id""")
def c13_resolve_anchors(spark, sf):
    found = O.resolve_anchors(sourced(spark, sf), messages(spark, sf))
    return found.select("id", F.array_join(F.array_sort(F.transform("anchors", lambda a: F.concat_ws("/", a["session_id"], a["turn"].cast("string"), a["step"].cast("string")))), ",").alias("anchors"))


@Q.add(f"""WITH {RECORDS}, d AS (SELECT o_orderkey AS n, 'r' || (o_orderkey % 1300) AS record_id, 'r' || (o_orderkey % 1300) AS winner, 'r' || CASE WHEN o_orderkey % 17 = 0 THEN o_orderkey % 1300 ELSE o_custkey END AS loser FROM orders)
SELECT n, winner IN (SELECT id FROM records) AND loser IN (SELECT id FROM records) AND winner <> loser AS valid FROM d""")
def c15_validate_conflict_pair(spark, sf):
    k = F.col("o_orderkey")
    decisions = read(spark, sf, "orders").select(k.alias("n"), rid(k % 1300).alias("record_id"), rid(k % 1300).alias("winner"), rid(F.when(k % 17 == 0, k % 1300).otherwise(F.col("o_custkey"))).alias("loser"))
    return O.validate_pairs(decisions, records(spark, sf)).select("n", "valid")


@Q.add(f"""WITH {RECORDS}, c AS (SELECT room, count(*) AS n FROM (SELECT unnest(tags) AS room FROM records) GROUP BY 1), g AS (SELECT 't' || n_nationkey AS slug, n_name AS label FROM nation)
SELECT coalesce(room, slug) AS room, coalesce(n, 0) AS n, label, CASE WHEN slug IS NOT NULL THEN 'pre-registered' ELSE 'grown' END AS source FROM c FULL JOIN g ON room = slug""")
def c16_room_catalog_merge(spark, sf):
    counted = records(spark, sf).select(F.explode("tags").alias("room")).groupBy("room").agg(F.count(F.lit(1)).alias("n"))
    registry = read(spark, sf, "nation").select(F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("room"), F.col("n_name").alias("label"), F.lit(True).alias("known"))
    both = counted.join(registry, "room", "full")
    return both.select("room", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "label", F.when(F.col("known"), "pre-registered").otherwise("grown").alias("source"))


@Q.add(f"""WITH {RECORDS}, {SOURCED}, {MESSAGES}, a AS (SELECT DISTINCT e.id, e.seq AS n, session_id, turn, CASE WHEN e.seq % 2 = 0 THEN step END AS step FROM (SELECT id, seq, unnest(source_message_ids) AS m FROM sourced) e JOIN messages ON m = messages.id WHERE turn IS NOT NULL),
m AS (SELECT a.id, x.session_id, x.n AS seq, length(x.text) AS chars FROM a JOIN messages x ON a.session_id = x.session_id AND a.turn + CASE WHEN a.n % 13 = 1 THEN 1000 ELSE 0 END = x.turn AND (a.step IS NULL OR a.step = x.step) WHERE a.n % 11 <> 1 AND x.role IN ('user', 'assistant') AND trim(x.text) <> ''),
w AS (SELECT *, row_number() OVER o AS k, sum(chars) OVER (PARTITION BY id ORDER BY session_id, seq ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT DISTINCT * FROM m) WINDOW o AS (PARTITION BY id ORDER BY session_id, seq))
SELECT i.id, count(*) FILTER (k <= 2 AND s <= 900) AS events, CAST(coalesce(sum(chars) FILTER (k <= 2 AND s <= 900), 0) AS BIGINT) AS chars, coalesce(bool_or(NOT (k <= 2 AND s <= 900)), false) AS truncated,
  CASE WHEN count(k) > 0 THEN NULL WHEN i.id NOT IN (SELECT id FROM a) THEN 'no-anchor' WHEN any_value(i.seq) % 11 = 1 THEN 'session-unreadable' ELSE 'anchor-not-found' END AS failure
FROM (SELECT DISTINCT id, seq FROM sourced) i LEFT JOIN w ON i.id = w.id GROUP BY i.id""")
def c17_fetch_evidence(spark, sf):
    """Evidence of records: sessions are written in two ways, those of some are gone, and the anchors of some lead nowhere."""
    every, k = sourced(spark, sf), F.substring("id", 2, 20).cast("long")
    places = O.resolve_anchors(every, messages(spark, sf)).select("id", F.explode("anchors").alias("a")).select("id", "a.*")
    session = F.when(k % 11 == 1, F.concat(F.lit("gone-"), "session_id")).when(k % 3 == 0, F.concat(F.lit("session-"), "session_id")).otherwise(F.col("session_id"))
    anchors = places.select("id", session.alias("session_id"), (F.col("turn") + F.when(k % 13 == 1, 1000).otherwise(0)).alias("turn"), F.when(k % 2 == 0, F.col("step")).alias("step")).distinct()
    events = messages(spark, sf).withColumns({"seq": F.col("n"), "type": F.concat("role", F.lit("/message"))})
    return O.fetch_evidence(anchors, events, 2, 900, every.select("id"))
