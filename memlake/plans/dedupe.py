"""Queries of deduplication, conflicts, merges and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import columns as C
from memlake.operators import dedupe as O
from memlake.operators import filters, merges
from memlake.plans.analytics import PAIRS, pairs
from memlake.plans.filters import KEY, STATE
from memlake.plans.registry import Queries
from memlake.sources.derived import NOW, RECORDS, messages, read, records

Q = Queries()

ITEMS = "items AS (SELECT id, seq, CASE WHEN seq % 97 = 0 THEN '  ' WHEN seq % 5 = 0 THEN '  ' || content || chr(10) ELSE content END AS content, priority, [created_ms, updated_ms] AS timestamps FROM records)"


def items(spark, sf):
    content = F.when(F.col("seq") % 97 == 0, "  ").when(F.col("seq") % 5 == 0, F.concat(F.lit("  "), "content", F.lit("\n"))).otherwise(F.col("content"))
    return records(spark, sf).select("id", "seq", content.alias("content"), "priority", F.array("created_ms", "updated_ms").alias("timestamps"))


@Q.add(rf"""WITH {RECORDS}, {ITEMS}, k AS (SELECT *, trim(regexp_replace(content, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS key FROM items), g AS (SELECT *, CASE WHEN key = '' THEN chr(1) || id ELSE key END AS grp FROM k),
b AS (SELECT grp, arg_max(id, (length(content), priority, -seq)) AS representative, count(*) AS members, max(priority) AS max_priority, count(DISTINCT t) AS n_times FROM (SELECT *, unnest(timestamps) AS t FROM g) GROUP BY grp)
SELECT g.id, b.representative, b.members // 2 AS members, b.max_priority, b.n_times FROM g JOIN b ON g.grp = b.grp""")
def k1_exact_dedupe(spark, sf):
    return O.exact_dedupe(items(spark, sf)).select("id", "representative", "members", "max_priority", F.size("all_timestamps").cast("long").alias("n_times"))


@Q.add()
def k2_vector_dedupe(spark, sf):
    v = read(spark, sf, "embeddings")
    batch = v.select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("seq"), F.floor(F.col("vec_id") / 64).alias("batch"), F.lit("chat").alias("family"), F.col("label").cast("string").alias("type"), "embedding")
    return O.leader_clusters(batch)


def deduped(spark, sf):
    k = F.col("vec_id")
    v = read(spark, sf, "embeddings").select(F.concat(F.lit("r"), k.cast("string")).alias("id"), k.alias("seq"), F.floor(k / 64).alias("batch"), F.lit("chat").alias("family"), F.col("label").cast("string").alias("type"), "embedding")
    return O.before_store(items(spark, sf).withColumn("run_id", F.concat(F.lit("run"), (F.col("seq") % 9).cast("string"))), v)


@Q.add()
def k3_dedupe_pipeline(spark, sf):
    return deduped(spark, sf)[1]


@Q.add()
def k3_receipts(spark, sf):
    """A receipt for each item that another one takes in; tests compare them with the stages one after the other."""
    return deduped(spark, sf)[0].withColumn("candidate_ids", F.array_join("candidate_ids", ","))


def gram_sql(n: int, t: str) -> str:
    return f"CASE WHEN length({t}) = 0 THEN [] WHEN length({t}) <= {n} THEN [{t}] ELSE list_distinct(list_transform(range(1, length({t}) - {n - 2}), lambda i: substr({t}, i, {n}))) END"


BUNDLE = f"b AS (SELECT item_id AS seq, 'b' || item_id AS id, CASE WHEN item_id % 4 = 1 THEN (SELECT text FROM conversations c WHERE c.conv_id = item_id ORDER BY turn LIMIT 1) WHEN item_id % 4 = 2 THEN left(text, 80) || ' ' || left(text, 40) ELSE text END AS content FROM benchmark)"


def score_sql(a: str, b: str) -> str:
    i3, i2 = f"len(list_intersect({a}.g3, {b}.g3))", f"len(list_intersect({a}.g2, {b}.g2))"
    return f"round(greatest({i3} / nullif(len({a}.g3) + len({b}.g3) - {i3}, 0), 2 * {i2} / nullif(len({a}.g2) + len({b}.g2), 0)), 4)"


@Q.add(f"""WITH {BUNDLE}, e AS (SELECT conv_id || ':' || turn AS id, text AS content FROM conversations), n AS (SELECT *, {KEY.format('content')} AS t FROM b), m AS (SELECT *, {KEY.format('content')} AS t FROM e),
bg AS (SELECT *, {gram_sql(3, 't')} AS g3, {gram_sql(2, 't')} AS g2 FROM n), eg AS (SELECT *, {gram_sql(3, 't')} AS g3, {gram_sql(2, 't')} AS g2 FROM m),
dups AS (SELECT bg.id, min(eg.id) AS of FROM bg JOIN eg ON bg.t = eg.t GROUP BY bg.id), s AS (SELECT bg.id, eg.id AS e, {score_sql('bg', 'eg')} AS score FROM bg, eg WHERE bg.id NOT IN (SELECT id FROM dups)),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, e) AS k FROM s WHERE score >= 0.3), best AS (SELECT id, max(score) AS best, count(*) AS matched, string_agg(e, ',' ORDER BY k) AS refs FROM k WHERE k <= 3 GROUP BY id),
own AS (SELECT x.id, max({score_sql('x', 'y')}) AS own, arg_min(y.seq, (-({score_sql('x', 'y')}), y.id)) AS own_seq FROM bg x JOIN bg y ON y.seq < x.seq WHERE x.id NOT IN (SELECT id FROM dups) AND y.id NOT IN (SELECT id FROM dups) GROUP BY x.id)
SELECT b.seq, CASE WHEN d.id IS NOT NULL THEN 'dup' WHEN coalesce(best, own) >= 0.62 THEN 'near-dup' WHEN coalesce(best, own) >= 0.3 THEN 'conflict-candidate' ELSE 'new' END AS verdict,
  CASE WHEN d.id IS NOT NULL THEN 1.0 WHEN best IS NOT NULL THEN best WHEN own >= 0.3 THEN own END AS best, CASE WHEN d.id IS NOT NULL THEN 1 WHEN best IS NOT NULL THEN matched WHEN own >= 0.3 THEN 1 ELSE 0 END AS matched, CASE WHEN d.id IS NOT NULL THEN d.of WHEN best IS NOT NULL THEN best.refs WHEN own >= 0.3 THEN 'bundle#' || own_seq ELSE '' END AS refs
FROM b LEFT JOIN dups d ON b.id = d.id LEFT JOIN best ON b.id = best.id LEFT JOIN own ON b.id = own.id""")
def k4_import_plan(spark, sf):
    k = F.col("item_id")
    talk = read(spark, sf, "conversations")
    first = talk.groupBy("conv_id").agg(F.min_by("text", "turn").alias("first_text"))
    b = read(spark, sf, "benchmark").join(first, F.col("item_id") == F.col("conv_id"), "left")
    content = F.when(k % 4 == 1, F.col("first_text")).when(k % 4 == 2, F.concat(F.left("text", F.lit(80)), F.lit(" "), F.left("text", F.lit(40)))).otherwise(F.col("text"))
    bundle = b.select(k.alias("seq"), F.concat(F.lit("b"), k.cast("string")).alias("id"), content.alias("content"))
    existing = messages(spark, sf).select("id", F.col("text").alias("content"))
    return O.import_plan(bundle, existing).withColumn("refs", F.array_join(F.transform("refs", lambda x: x["id"]), ","))


DECIDED = "d AS (SELECT o_orderkey AS seq, 'run' || (o_orderkey % 7) AS run_id, 'r' || (o_orderkey % 900) AS winner, 'r' || o_custkey AS loser, CASE WHEN o_orderpriority LIKE '1%' THEN 'hard' ELSE 'conditional' END AS kind, o_orderkey % 3 = 0 AS in_batch FROM orders)"


@Q.add(f"""WITH {DECIDED}, x AS (SELECT *, sha256('pair/v1' || chr(10) || length(run_id) || ':' || run_id || chr(10) || length(winner) || ':' || winner || chr(10) || length(loser) || ':' || loser || chr(10)) AS pair_id FROM d),
u AS (SELECT pair_id, arg_min(kind, seq) AS kind, min(seq) AS seq, arg_min(in_batch, seq) AS in_batch FROM x GROUP BY pair_id HAVING NOT bool_or(seq % 70 = 0)), h AS (SELECT pair_id FROM u WHERE kind = 'hard' ORDER BY seq LIMIT 60)
SELECT seq, pair_id, CASE WHEN kind <> 'hard' OR pair_id IN (SELECT pair_id FROM h) THEN 'pending' WHEN in_batch THEN 'unparked' ELSE 'auto' END AS fate FROM u""")
def k5_freeze_pairs(spark, sf):
    k = F.col("o_orderkey")
    d = read(spark, sf, "orders").select(k.alias("seq"), F.concat(F.lit("run"), (k % 7).cast("string")).alias("run_id"), F.concat(F.lit("r"), (k % 900).cast("string")).alias("winner"), F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("loser"), F.when(F.col("o_orderpriority").startswith("1"), "hard").otherwise("conditional").alias("kind"), (k % 3 == 0).alias("in_batch"))
    existing = d.where("seq % 70 = 0").select(C.input_digest(F.array("run_id", "winner", "loser"), "pair/v1").alias("pair_id"))
    return O.freeze_pairs(d, existing, 40, 100)


OUTCOMES = "out AS (SELECT o_orderkey % 5000 AS pair_id, o_orderkey AS seq, CASE o_orderkey % 5 WHEN 0 THEN 'winner' WHEN 1 THEN 'loser' WHEN 2 THEN 'both' WHEN 3 THEN 'auto' ELSE 'defer' END AS outcome FROM orders WHERE o_orderkey % 3 = 0)"


@Q.add(f"""WITH {PAIRS}, {OUTCOMES}, f AS (SELECT pair_id, arg_min(outcome, seq) AS outcome FROM out GROUP BY 1), j AS (SELECT p.*, f.outcome, resolution IS NULL OR resolution = 'defer' AS op FROM pairs p LEFT JOIN f ON p.pair_id = f.pair_id)
SELECT pair_id, CASE WHEN op AND outcome IS NOT NULL THEN outcome ELSE resolution END AS resolution, CASE WHEN op AND outcome = 'defer' THEN least(defer_count + 1, 3) ELSE defer_count END AS defer_count,
  CASE WHEN op AND outcome IN ('winner', 'auto') THEN loser_id WHEN op AND outcome = 'loser' THEN winner_id END AS retired FROM j""")
def k6_resolve_pairs(spark, sf):
    k = F.col("o_orderkey")
    names = F.array(*map(F.lit, ("winner", "loser", "both", "auto", "defer")))
    outcomes = read(spark, sf, "orders").where("o_orderkey % 3 = 0").select((k % 5000).alias("pair_id"), k.alias("seq"), F.element_at(names, (k % 5 + 1).cast("int")).alias("outcome"))
    return O.resolve_pairs(pairs(spark, sf), outcomes)


@Q.add("""WITH r AS (SELECT DISTINCT 'run' || (o_orderkey % 9) AS run_id, 'r' || o_custkey AS record_id, CASE o_orderkey % 4 WHEN 0 THEN 'store' WHEN 1 THEN 'merge' WHEN 2 THEN 'skip' ELSE 'skip_missing' END AS kind FROM orders)
SELECT run_id, record_id, kind, sha256('receipt/v1' || chr(10) || length(run_id) || ':' || run_id || chr(10) || length(record_id) || ':' || record_id || chr(10) || length(kind) || ':' || kind || chr(10)) AS receipt_id FROM r""")
def k7_build_receipts(spark, sf):
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "store").when(k % 4 == 1, "merge").when(k % 4 == 2, "skip").otherwise("skip_missing")
    rows = read(spark, sf, "orders").select(F.concat(F.lit("run"), (k % 9).cast("string")).alias("run_id"), F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("record_id"), kind.alias("kind")).distinct()
    return rows.withColumn("receipt_id", C.input_digest(F.array("run_id", "record_id", "kind"), "receipt/v1"))


@Q.add(f"""WITH {RECORDS}, d AS (SELECT id, seq, CASE seq % 40 WHEN 1 THEN 'store' WHEN 11 THEN 'update' WHEN 21 THEN 'merge' ELSE 'skip' END AS action, ['r' || (seq + 3), 'r' || (seq + 13)] AS targets FROM records WHERE seq % 10 = 1),
a AS (SELECT * FROM d WHERE action IN ('update', 'merge')), c AS (SELECT a.id, a.seq, u.t AS target FROM a, unnest(targets) u(t) WHERE u.t IN (SELECT id FROM records)), f AS (SELECT target, arg_min(id, seq) AS b FROM c GROUP BY target),
own AS (SELECT id, id AS member FROM a UNION SELECT id, target FROM c), m AS (SELECT own.id, max(version) + 1 AS version, min(valid_from_ms) AS vf, CASE WHEN bool_or(valid_to_ms IS NULL) THEN NULL ELSE max(valid_to_ms) END AS vt FROM own JOIN records r ON own.member = r.id GROUP BY 1)
SELECT 'm-' || id AS id, 'merged' AS fate, CAST(NULL AS VARCHAR) AS by, version, vf AS valid_from_ms, vt AS valid_to_ms FROM m UNION ALL SELECT target, 'retired', 'm-' || b, NULL, NULL, NULL FROM f
UNION ALL SELECT id, CASE action WHEN 'store' THEN 'stored' WHEN 'skip' THEN 'skipped' ELSE 'folded' END, NULL, NULL, NULL, NULL FROM d""")
def k8_apply_decisions(spark, sf):
    rows, k = records(spark, sf), F.col("seq")
    action = F.when(k % 40 == 1, "store").when(k % 40 == 11, "update").when(k % 40 == 21, "merge").otherwise("skip")
    target = lambda n: F.concat(F.lit("r"), (k + n).cast("string"))
    return O.apply_decisions(rows.where("seq % 10 = 1").select("id", "seq", action.alias("action"), F.array(target(3), target(13)).alias("targets")), rows, NOW)


DECISIONS = "d AS (SELECT id, seq, CASE seq % 30 WHEN 1 THEN 'conflict' WHEN 11 THEN 'update' ELSE 'merge' END AS action, ['r' || (seq + 3), 'r' || (seq + 13)] AS targets, CASE WHEN seq % 20 = 1 THEN 'merged ' || seq ELSE ' ' END AS merged_content, CASE seq % 4 WHEN 0 THEN NULL ELSE id END AS winner, CASE seq % 7 WHEN 0 THEN id WHEN 1 THEN 'gone' WHEN 2 THEN 'r' || (seq + 60) ELSE 'r' || (seq + 5) END AS loser FROM records WHERE seq % 10 = 1), cl AS (SELECT d.id, d.seq, u.t AS target FROM d, unnest(targets) u(t) WHERE action IN ('update', 'merge') AND u.t IN (SELECT id FROM records)), own AS (SELECT id, id AS member FROM d WHERE action IN ('update', 'merge') UNION SELECT id, target FROM cl)"


def decisions(spark, sf):
    rows, k = records(spark, sf), F.col("seq")
    other = lambda n: F.concat(F.lit("r"), (k + n).cast("string"))
    action = F.when(k % 30 == 1, "conflict").when(k % 30 == 11, "update").otherwise("merge")
    loser = F.when(k % 7 == 0, F.col("id")).when(k % 7 == 1, "gone").when(k % 7 == 2, other(60)).otherwise(other(5))
    said = rows.where("seq % 10 = 1").select("id", "seq", action.alias("action"), F.array(other(3), other(13)).alias("targets"), F.when(k % 20 == 1, F.concat(F.lit("merged "), k.cast("string"))).otherwise(" ").alias("merged_content"), F.when(k % 4 != 0, F.col("id")).alias("winner"), loser.alias("loser"))
    return said, rows


@Q.add(f"""WITH {RECORDS}, {DECISIONS}, m AS (SELECT own.id AS survivor, r.seq, member = own.id AS is_self, content, tags, wing, ext_key, created_ms, updated_ms FROM own JOIN records r ON own.member = r.id),
t AS (SELECT survivor, u.t, min((NOT is_self, seq, u.o)) AS o FROM m, unnest(tags) WITH ORDINALITY AS u(t, o) GROUP BY 1, 2), g AS (SELECT survivor, array_to_string(list(t ORDER BY o)[1:6], ',') AS tags FROM t GROUP BY 1),
w AS (SELECT survivor, max(wing) FILTER (is_self) AS mine, count(DISTINCT wing) FILTER (NOT is_self) AS n, min(wing) FILTER (NOT is_self) AS one, max(content) FILTER (is_self) AS content, arg_min(ext_key, (NOT is_self, seq)) FILTER (ext_key IS NOT NULL) AS ext_key FROM m GROUP BY 1),
x AS (SELECT survivor, count(DISTINCT t) AS n_times FROM (SELECT survivor, unnest([created_ms, updated_ms, {NOW}]) AS t FROM m) GROUP BY 1)
SELECT 'm-' || w.survivor AS id, md5(CASE WHEN trim(d.merged_content) <> '' THEN trim(d.merged_content) ELSE w.content END) AS content_md5, coalesce(g.tags, '') AS tags, coalesce(mine, CASE WHEN n = 1 THEN one END) AS wing, w.ext_key, n_times FROM w JOIN d ON d.id = w.survivor JOIN x ON x.survivor = w.survivor LEFT JOIN g ON g.survivor = w.survivor""")
def k8_merged_records(spark, sf):
    said, rows = decisions(spark, sf)
    return O.merged_records(said, rows, NOW).select("id", F.md5("content").alias("content_md5"), F.array_join("tags", ",").alias("tags"), "wing", "ext_key", F.size("timestamps").cast("long").alias("n_times"))


@Q.add(f"""WITH {RECORDS}, {DECISIONS}, c AS (SELECT id, winner, loser, CASE WHEN winner = id THEN loser WHEN loser = id THEN winner END AS other FROM d WHERE action = 'conflict')
SELECT id, winner, loser, coalesce(other IN (SELECT id FROM d), false) AS in_batch, CASE WHEN winner IS NULL OR loser IS NULL THEN 'incomplete' WHEN winner = loser THEN 'same' WHEN other IS NULL THEN 'not-its-own' WHEN other NOT IN (SELECT id FROM records) AND other NOT IN (SELECT id FROM d) THEN 'unknown' END AS rejected FROM c""")
def k8_conflict_pairs(spark, sf):
    said, rows = decisions(spark, sf)
    return O.conflict_pairs(said, rows)


@Q.add(f"""WITH {RECORDS}, {DECISIONS}, u AS (SELECT id, priority AS attempts, seq % 3 AS used FROM records), f AS (SELECT target, 'm-' || arg_min(id, seq) AS new FROM cl GROUP BY target)
SELECT coalesce(f.new, u.id) AS id, CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(used) AS BIGINT) AS used FROM u LEFT JOIN f ON u.id = f.target GROUP BY 1""")
def k8_usage_rekeyed(spark, sf):
    from memlake.operators.analytics import rekey

    said, rows = decisions(spark, sf)
    return rekey(rows.select("id", F.col("priority").alias("attempts"), (F.col("seq") % 3).alias("used")), O.usage_moves(said, rows))


@Q.add(f"WITH {RECORDS}, s AS (SELECT id, CASE WHEN seq % 2 = 0 THEN 'current' ELSE 'historical' END AS stored, {STATE} AS state FROM records) SELECT id, state FROM s WHERE state <> stored")
def k9_reclassify(spark, sf):
    rows = filters.with_state(records(spark, sf), NOW)
    return rows.where(F.col("state") != F.when(F.col("seq") % 2 == 0, "current").otherwise("historical")).select("id", "state")


@Q.add(f"WITH {RECORDS} SELECT id, created_ms FROM records WHERE len(tags) = 0 AND retired_reason IS NULL AND seq % 6 <> 1 ORDER BY created_ms, id LIMIT 80")
def k10_pending_orphans(spark, sf):
    return filters.browse(records(spark, sf), untagged=True).where("seq % 6 <> 1").orderBy("created_ms", "id").limit(80).select("id", "created_ms")


@Q.add(f"WITH {RECORDS}, x AS (SELECT id, CASE WHEN seq % 3 = 0 THEN 'Work' WHEN seq % 3 = 1 THEN wing ELSE 'kitchen' END AS legacy FROM records) SELECT CASE WHEN lower(legacy) IN ('work','relationships','learning','creative','home','health','finance','journey','general') THEN lower(legacy) END AS wing, legacy, count(*) AS n FROM x GROUP BY 1, 2")
def k11_wing_migration(spark, sf):
    legacy = F.when(F.col("seq") % 3 == 0, "Work").when(F.col("seq") % 3 == 1, F.col("wing")).otherwise("kitchen")
    rows = records(spark, sf).select(legacy.alias("legacy")).withColumn("wing", F.when(F.lower("legacy").isin(*C.WINGS, C.FALLBACK_WING), F.lower("legacy")))
    return rows.groupBy("wing", "legacy").agg(F.count(F.lit(1)).alias("n"))


MEMBERS = "mem AS (SELECT 'm' || (seq // 4) AS survivor, seq, seq % 4 = 0 AS is_self, tags, wing, valid_from_ms, valid_to_ms, persistence FROM records)"


def members(spark, sf):
    return records(spark, sf).select(F.concat(F.lit("m"), F.floor(F.col("seq") / 4).cast("string")).alias("survivor"), "seq", (F.col("seq") % 4 == 0).alias("is_self"), "tags", "wing", "valid_from_ms", "valid_to_ms", "persistence")


@Q.add(f"""WITH {RECORDS}, {MEMBERS}, t AS (SELECT survivor, u.t, min((NOT is_self, seq, u.o)) AS o FROM mem, unnest(tags) WITH ORDINALITY AS u(t, o) GROUP BY 1, 2), g AS (SELECT survivor, array_to_string(list(t ORDER BY o)[1:6], ',') AS tags FROM t GROUP BY 1),
w AS (SELECT survivor, max(wing) FILTER (is_self) AS mine, count(DISTINCT wing) FILTER (NOT is_self) AS n, min(wing) FILTER (NOT is_self) AS one FROM mem GROUP BY 1)
SELECT w.survivor, coalesce(tags, '') AS tags, coalesce(mine, CASE WHEN n = 1 THEN one END) AS wing FROM w LEFT JOIN g ON w.survivor = g.survivor""")
def g2_merge_axes(spark, sf):
    return merges.merge_axes(members(spark, sf)).withColumn("tags", F.array_join("tags", ","))


@Q.add(f"""WITH {RECORDS}, {MEMBERS} SELECT survivor, min(valid_from_ms) AS valid_from_ms, CASE WHEN bool_or(valid_to_ms IS NULL) THEN NULL ELSE max(valid_to_ms) END AS valid_to_ms, arg_min(persistence, (NOT is_self, seq)) FILTER (persistence IS NOT NULL) AS persistence FROM mem GROUP BY survivor""")
def g3_merge_temporal(spark, sf):
    return merges.merge_temporal(members(spark, sf))


@Q.add(f"""WITH {RECORDS}, x AS (SELECT id, tags, list_transform(tags, lambda t: CASE WHEN t IN ('t1', 't2') THEN 't3' WHEN t = 'area1/x' THEN 'area2/x' ELSE t END) AS n FROM records) SELECT id, array_to_string(n, ',') AS tags, n <> tags AS changed FROM x""")
def g4_rewrite_tag(spark, sf):
    return merges.rewrite_tags(records(spark, sf), {"t1": "t2", "t2": "t3", "area1/x": "area2/x"}).withColumn("tags", F.array_join("tags", ","))


@Q.add(f"WITH {RECORDS} SELECT scene AS query_id, id FROM records WHERE seq % 3 <> 0")
def g5_minus_seen(spark, sf):
    rows = records(spark, sf).select(F.col("scene").alias("query_id"), "id", "seq")
    return merges.minus_seen(rows.drop("seq"), rows.where("seq % 3 = 0").drop("seq"))


@Q.add(f"WITH {RECORDS} SELECT id, CASE WHEN seq % 10 = 0 AND seq % 4 <> 0 THEN priority + 1 ELSE priority END AS priority FROM records")
def g6_restore_selected(spark, sf):
    rows = records(spark, sf)
    old = rows.where("seq % 4 <> 0").select("id", (F.col("priority") + 1).alias("priority"))
    return merges.restore_selected(rows.select("id", "priority"), old, rows.where("seq % 10 = 0").select("id"))[0]


@Q.add(f"WITH {RECORDS} SELECT id, priority, 'a' AS side FROM records WHERE seq % 50 = 0 UNION ALL SELECT id, priority + 1, 'b' FROM records WHERE seq % 50 = 0 UNION ALL SELECT id, priority, 'a' FROM records WHERE seq % 77 = 0 AND seq % 50 <> 0")
def g7_verify_snapshot(spark, sf):
    rows = records(spark, sf)
    changed = rows.where("seq % 77 <> 0 or seq % 50 = 0").select("id", F.when(F.col("seq") % 50 == 0, F.col("priority") + 1).otherwise(F.col("priority")).alias("priority"))
    return merges.snapshot_difference(rows.select("id", "priority"), changed)


@Q.add(f"""WITH {RECORDS}, r AS (SELECT id, seq, CASE WHEN seq % 4 = 0 AND retired_reason IS NULL THEN 'manual' WHEN seq % 4 = 1 THEN NULL ELSE retired_reason END AS retired_reason FROM records) SELECT id, retired_reason FROM r WHERE NOT (retired_reason IS NOT NULL AND seq % 5 = 0)""")
def g8_retire_restore_purge(spark, sf):
    rows = records(spark, sf)
    changes = rows.where("seq % 4 in (0, 1)").select("id", F.when(F.col("seq") % 4 == 0, "retire").otherwise("restore").alias("action"), F.lit("manual").alias("reason"))
    now = merges.retire(rows, changes)
    wanted = now.where("seq % 5 = 0")
    return merges.purge_checked(now, wanted, merges.record_digest(wanted)).select("id", "retired_reason")


@Q.add()
def a5_snapshot_manifest(spark, sf):
    return merges.snapshot_manifest("records", records(spark, sf)).union(merges.snapshot_manifest("messages", messages(spark, sf)))


@Q.add(rf"""WITH {RECORDS} SELECT id, sha256(trim(regexp_replace(replace(replace(nfc_normalize(content), 'ﬁ', 'fi'), chr(8203), ''), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS key FROM records""")
def h3_dedupe_key(spark, sf):
    return O.dedupe_key(records(spark, sf)).select("id", F.sha2("key", 256).alias("key"))


@Q.add(rf"""WITH {RECORDS}, h AS (SELECT id, substr(sha256({KEY.format('content')}), 1, 16) AS hash FROM records) SELECT id, hash, 'mp_' || substr(sha256('main|' || hash), 1, 16) AS bundle_id FROM h""")
def h5_bundle_ids(spark, sf):
    rows = O.dedupe_key(records(spark, sf))
    hashed = F.substring(F.sha2(F.lower("key"), 256), 1, 16)
    return rows.select("id", hashed.alias("hash")).withColumn("bundle_id", F.concat(F.lit("mp_"), F.substring(F.sha2(F.concat(F.lit("main|"), "hash"), 256), 1, 16)))


@Q.add(f"WITH {RECORDS} SELECT id, CAST(greatest(0, least(100, coalesce(round(CASE WHEN seq % 8 = 0 THEN NULL ELSE (priority - 20) * 1.7 END), 50))) AS INT) AS priority, CASE WHEN persistence IN ('p','s','o','t') THEN persistence END AS persistence FROM records")
def h16_clamped(spark, sf):
    raw = F.when(F.col("seq") % 8 != 0, (F.col("priority") - 20) * F.lit(1.7))
    kept = F.when(F.col("persistence").isin("p", "s", "o", "t"), F.col("persistence"))
    return records(spark, sf).select("id", F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(F.round(raw), F.lit(50)))).cast("int").alias("priority"), kept.alias("persistence"))


@Q.add(f"WITH {RECORDS} SELECT scene, max(greatest(coalesce(valid_to_ms, 0), coalesce(valid_from_ms, 0), updated_ms, created_ms)) AS anchor_ms FROM records GROUP BY scene")
def h18_evidence_anchor(spark, sf):
    latest = F.array_max(F.array("valid_to_ms", "valid_from_ms", "updated_ms", "created_ms"))
    return records(spark, sf).groupBy("scene").agg(F.max(latest).alias("anchor_ms"))
