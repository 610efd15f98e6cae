"""Queries of benchmark reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.operators import evaluation as E
from memlake.operators import retrieval as O
from memlake.operators.shared import checkpoint
from memlake.plans.registry import Queries
from memlake.plans.retrieval import GOLD, PROBES, bm25_sql, gold, hits_with_text, probes
from memlake.sources import runs as R
from memlake.sources.derived import RECORDS, pick, read, records

Q = Queries()


@Q.add(f"""WITH {RECORDS}, {PROBES}, {GOLD}, {bm25_sql('f', 'records', 'probes', 5)}, l AS (SELECT f.query_id, left(r.content, 400) AS line FROM f JOIN records r ON f.id = r.id), m AS (SELECT l.query_id, line, bool_or(contains(line, gold)) AS good, bool_or(contains(line, left(gold, 12))) AS stale FROM l JOIN gold USING (query_id) GROUP BY 1, 2),
e AS (SELECT query_id, count(*) AS lines, count(*) FILTER (good) AS good, bool_or(stale) AS stale FROM m GROUP BY 1)
SELECT CAST(sum(lines) AS BIGINT) AS lines, round(sum(good) / sum(lines), 6) AS by_line, round(avg(good / lines), 6) AS by_probe, count(*) FILTER (stale) AS stale_probes FROM e""")
def m2_injection_precision(spark, sf):
    lines = hits_with_text(spark, sf).select("query_id", F.left("content", F.lit(400)).alias("line"))
    return E.injection_precision(lines, gold(spark, sf).withColumn("stale", F.left("gold", F.lit(12))))


def flood_sql(n: int, level: int) -> str:
    return f"""x{level} AS (SELECT id, content FROM records UNION ALL SELECT 'n' || id, array_to_string(list_reverse(string_split(content, ' ')), ' ') FROM records WHERE seq < {n}), {bm25_sql(f'f{level}', f'x{level}', 'probes', 5)},
m{level} AS (SELECT {level} AS level, g.query_id, g.kind, min(rank) FILTER (contains(r.content, g.gold)) AS best FROM gold g LEFT JOIN f{level} f ON f.query_id = g.query_id LEFT JOIN x{level} r ON f.id = r.id GROUP BY 2, 3)"""


LEVELS = (0, 100, 1000)


@Q.add(f"""WITH {RECORDS}, {PROBES}, {GOLD}, {', '.join(flood_sql(n, k) for k, n in enumerate(LEVELS))}, m AS ({' UNION ALL '.join(f'SELECT * FROM m{k}' for k in range(len(LEVELS)))}),
r AS (SELECT level, coalesce(kind, 'all') AS kind, count(*) AS probes, round(avg(CASE WHEN best IS NULL THEN 0 ELSE 1 END), 6) AS recall, round(avg(coalesce(1 / best, 0)), 6) AS mrr FROM m GROUP BY GROUPING SETS ((level, kind), (level)))
SELECT level, kind, probes, recall, mrr, round(recall - first_value(recall) OVER (PARTITION BY kind ORDER BY level), 6) AS delta FROM r""")
def m3_flood_curve(spark, sf):
    """Recall as unrelated records are added, made of the corpus's own words: one run for each level, and the change to the first."""
    from pyspark.sql import Window as W

    rows = records(spark, sf).select("id", "seq", "content")
    backwards = F.array_join(F.reverse(F.split(F.col("content"), " ")), " ")
    found = []
    for level, n in enumerate(LEVELS):
        flooded = rows.select("id", "content").union(rows.where(F.col("seq") < n).select(F.concat(F.lit("n"), "id"), backwards))
        hits = O.bm25(probes(spark, sf), flooded, 5).join(flooded, "id")
        found.append(E.recall_and_mrr(hits, gold(spark, sf)).withColumn("level", F.lit(level)))
    every = found[0].unionByName(found[1]).unionByName(found[2])
    return every.withColumn("delta", F.round(F.col("recall") - F.first("recall").over(W.partitionBy("kind").orderBy("level")), 6))


def results(spark, sf):
    e, k = read(spark, sf, "events"), F.col("event_id")
    kinds = F.array(*map(F.lit, ("extraction", "update", "abstention", "temporal")))
    return e.select(
        F.when(k % 2 == 0, "on").otherwise("off").alias("arm"),
        F.element_at(kinds, (k % 4 + 1).cast("int")).alias("kind"),
        (F.col("value") > 20).alias("hit"),
        F.concat(F.lit("s"), (F.col("user_id") % 20).cast("string")).alias("scenario"),
        (F.col("user_id") % 20).alias("ord"),
        (k % 3).alias("contamination"),
        k.alias("k"),
        "value",
        "event_type",
        "props",
    )


RESULTS = "results AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'on' ELSE 'off' END AS arm, (['extraction','update','abstention','temporal'])[CAST(event_id % 4 AS INT) + 1] AS kind, value > 20 AS hit, 's' || (user_id % 20) AS scenario, user_id % 20 AS ord, event_id % 3 AS contamination, event_id AS k, value, event_type, props FROM events)"


@Q.add(f"WITH {RESULTS} SELECT arm, kind, count(*) FILTER (hit) AS hits, count(*) AS probes, round(avg(CAST(hit AS INT)), 6) AS rate FROM results GROUP BY 1, 2")
def m4_accuracy(spark, sf):
    return E.accuracy(results(spark, sf))


@Q.add(f"WITH {RESULTS} SELECT arm, count(*) FILTER (kind = 'abstention' AND NOT hit) AS abstention_failures, count(*) FILTER (kind = 'update' AND hit) AS update_hits, count(*) FILTER (kind = 'update') AS updates FROM results GROUP BY 1")
def m4_abstention(spark, sf):
    return E.abstention(results(spark, sf))


@Q.add(f"WITH {RESULTS} SELECT arm, count(*) AS runs, round(avg(k % 11), 6) AS turns, round(avg(k % 17), 6) AS steps, round(avg(1000 + k % 500), 6) AS input_tokens, round(avg(k % 90), 6) AS output_tokens, round(sum(k % 800) / sum(1000 + k % 500), 6) AS cache_rate FROM results GROUP BY 1")
def m5_efficiency(spark, sf):
    k = F.col("k")
    return E.efficiency(results(spark, sf).select("arm", (k % 11).alias("turns"), (k % 17).alias("steps"), (k % 500 + 1000).alias("input_tokens"), (k % 90).alias("output_tokens"), (k % 800).alias("cached_tokens")))


@Q.add(f"""WITH {RESULTS}, t AS (SELECT CASE WHEN k % 3 = 0 THEN 0 ELSE k % 900 END AS c, value * 10 AS ms, 1000 + k % 500 AS i FROM results)
SELECT round(avg(ms) FILTER (c > 0), 6) AS injected_ms, round(avg(ms) FILTER (c <= 0), 6) AS plain_ms, round(avg(c / 4 / i) FILTER (c > 0), 6) AS share, count(*) FILTER (c > 0) AS injected FROM t""")
def m6_latency_split(spark, sf):
    k = F.col("k")
    return E.latency_split(results(spark, sf).select(F.when(k % 3 == 0, 0).otherwise(k % 900).alias("injected_chars"), (F.col("value") * 10).alias("first_ms"), (k % 500 + 1000).alias("input_tokens")))


@Q.add(f"WITH {RESULTS} SELECT layer, CAST(sum(k % 5) AS BIGINT) AS calls, CAST(sum(k % 2) AS BIGINT) AS failures, CAST(sum(k % 100) AS BIGINT) AS tokens FROM (SELECT k, unnest(CASE WHEN k % 4 = 0 THEN ['l1', 'l2', 'l3'] ELSE ['l1'] END) AS layer FROM results) GROUP BY 1")
def m7_usage_ledger(spark, sf):
    k = F.col("k")
    u = F.struct((k % 5).alias("calls"), (k % 2).alias("failures"), (k % 100).alias("tokens"))
    layers = F.when(k % 4 == 0, F.create_map(F.lit("l1"), u, F.lit("l2"), u, F.lit("l3"), u)).otherwise(F.create_map(F.lit("l1"), u))
    return E.usage_by_layer(results(spark, sf).select(layers.alias("layers")))


@Q.add(f"""WITH {RESULTS}, p AS (SELECT kind, props AS injected, ['k', CAST(k % 100 AS VARCHAR)] AS tokens, k % 5 = 0 AS by_tool, hit FROM results), f AS (SELECT *, contains(injected, tokens[1]) AND contains(injected, tokens[2]) AS found FROM p)
SELECT kind, count(*) AS probes, count(*) FILTER (found) AS found, count(*) FILTER (NOT found AND by_tool AND hit) AS rescued FROM f GROUP BY 1""")
def m8_injected_recall(spark, sf):
    k = F.col("k")
    return E.injected_recall(results(spark, sf).select("kind", F.col("props").alias("injected"), F.array(F.lit("k"), (k % 100).cast("string")).alias("tokens"), (k % 5 == 0).alias("by_tool"), "hit"))


@Q.add(f"""WITH {RESULTS}, o AS (SELECT scenario, min(ord) AS ord FROM results GROUP BY 1), b AS (SELECT scenario, CAST(ceil(row_number() OVER (ORDER BY ord, scenario) * 3 / count(*) OVER ()) AS BIGINT) AS bucket FROM o)
SELECT bucket, count(*) AS probes, round(avg(CAST(hit AS INT)), 6) AS rate, CAST(sum(contamination) AS BIGINT) AS contamination FROM results JOIN b USING (scenario) GROUP BY 1""")
def m9_position_analysis(spark, sf):
    return E.by_position(results(spark, sf))


@Q.add(f"""WITH {RESULTS}, a AS (SELECT kind, avg(CAST(hit AS INT)) AS r FROM results WHERE arm = 'off' AND kind <> 'temporal' GROUP BY 1), b AS (SELECT kind, avg(CAST(hit AND k % 7 <> 0 AS INT)) AS r FROM results WHERE arm = 'on' OR kind = 'temporal' GROUP BY 1)
SELECT coalesce(a.kind, b.kind) AS kind, round(b.r - a.r, 6) AS delta, CASE WHEN a.r IS NULL OR b.r IS NULL THEN 'missing' WHEN abs(round(b.r - a.r, 6)) <= 0.05 THEN 'noise' WHEN b.r > a.r THEN 'better' ELSE 'worse' END AS verdict FROM a FULL JOIN b ON a.kind = b.kind""")
def m10_run_compare(spark, sf):
    rows = results(spark, sf)
    return E.compare_runs(rows.where("arm = 'off' and kind <> 'temporal'"), rows.where("arm = 'on' or kind = 'temporal'").withColumn("hit", F.col("hit") & (F.col("k") % 7 != 0)))


@Q.add(f"""WITH {RECORDS}, c AS (SELECT id FROM records WHERE seq % 4 = 0 OR seq % 9 = 0), j AS (SELECT id FROM records WHERE seq % 2 = 0 UNION ALL SELECT id FROM records WHERE seq % 6 = 0)
SELECT (SELECT count(*) FROM j WHERE id IN (SELECT id FROM c)) AS calls, count(*) AS changed, round((SELECT count(*) FROM j WHERE id IN (SELECT id FROM c)) / count(*), 6) AS ratio FROM c""")
def m11_write_amplification(spark, sf):
    rows = records(spark, sf)
    after = rows.select("id", "version", F.md5("id").alias("digest"))
    before = rows.where("seq % 9 <> 0").select("id", F.when(F.col("seq") % 4 == 0, "x").otherwise(F.md5("id")).alias("digest"))
    jobs = rows.where("seq % 2 = 0").select("id").union(rows.where("seq % 6 = 0").select("id"))
    return E.write_amplification(jobs, before, after.select("id", "digest"))


@Q.add(f"""WITH {RESULTS} SELECT event_type AS phase, arm, CAST(sum(1000 + k % 500) AS BIGINT) AS "in", CAST(sum(k % 800) AS BIGINT) AS cached, CAST(sum(k % 90) AS BIGINT) AS out, CAST(sum(k % 17) AS BIGINT) AS steps, round(sum(k % 800) / sum(1000 + k % 500), 6) AS cache_rate FROM results WHERE k % 13 <> 0 GROUP BY 1, 2""")
def m12_token_summary(spark, sf):
    k = F.col("k")
    line = F.format_string("12:00 phase=%s arm=%s in=%d cached=%d out=%d steps=%d", "event_type", "arm", k % 500 + 1000, k % 800, k % 90, k % 17)
    return E.token_summary(results(spark, sf).select(F.when(k % 13 == 0, F.lit("noise in=3")).otherwise(line).alias("line")))


@Q.add("""WITH s AS (SELECT 'u' || user_id AS session_id, event_id AS seq, 1000 + event_id % 500 AS i, event_id % 800 AS c, event_id * 3 AS x FROM events) SELECT session_id, seq, i - c AS uncached, round((i - c) / i, 6) AS miss_rate, x - coalesce(lag(x) OVER (PARTITION BY session_id ORDER BY seq), 0) AS added_chars FROM s""")
def m13_step_cache(spark, sf):
    k = F.col("event_id")
    return E.step_cache(read(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), k.alias("seq"), (k % 500 + 1000).alias("input_tokens"), (k % 800).alias("cached_tokens"), (k * 3).alias("context_chars")))


@Q.add(f"WITH {RESULTS} SELECT scenario AS suite, count(*) FILTER (k % 3 = 0 AND hit) AS positives, count(*) FILTER (k % 3 <> 0 AND hit) AS leaks, round(avg(CAST((k % 3 = 0) = hit AS INT)), 6) AS rate FROM results GROUP BY 1")
def m14_lifecycle_report(spark, sf):
    return E.lifecycle(results(spark, sf).select(F.col("scenario").alias("suite"), (F.col("k") % 3 == 0).alias("expected"), F.col("hit").alias("seen")))


#: Runs as files: two arms, four repetitions each, of which one is damaged and one isn't there; probes are passages of the benchmark, with two gold strings of them and one of none.
NESTED = """items AS (SELECT item_id AS k, text, CASE WHEN item_id % 2 = 0 THEN 'A' ELSE 'B' END AS arm, 'rep-' || (item_id // 2 % 4 + 1) AS rep, (['extraction', 'multi-hop', 'update', 'abstention'])[CAST(item_id % 4 AS INT) + 1] AS type FROM benchmark),
asked_of AS (SELECT 'run-' || arm || '/' || rep || '/' || k AS pid, * FROM items WHERE NOT (arm = 'A' AND rep = 'rep-3') AND NOT (arm = 'B' AND rep = 'rep-4'))"""


def run_texts(spark, sf):
    """(path, text) of result files made from the benchmark's passages."""
    k = F.col("item_id")
    item = read(spark, sf, "benchmark").select(k.alias("k"), "text", F.when(k % 2 == 0, "A").otherwise("B").alias("arm"), F.concat(F.lit("rep-"), (F.floor(k / 2) % 4 + 1).cast("string")).alias("rep"), pick(("extraction", "multi-hop", "update", "abstention"), k % 4).alias("type"))
    gold = F.when(F.col("type") != "abstention", F.array(F.left("text", F.lit(40)), F.substring("text", 41, 30), F.concat(F.lit("nowhere "), F.col("k").cast("string"))))
    probe = F.struct(F.col("k").cast("string").alias("id"), "type", F.col("text").alias("q"), gold.alias("gold"), (F.col("k") % 3 == 0).alias("hit"), F.struct(F.array(F.left("text", F.lit(90))).alias("lines")).alias("recall"))
    talk = F.struct(F.concat(F.lit("s"), F.col("k").cast("string")).alias("id"), F.lit("dialog").alias("kind"), F.array(probe).alias("probes"), F.lit(None).cast("array<struct<name: string, ok: boolean>>").alias("checks"))
    work = F.struct(F.concat(F.lit("w"), F.col("k").cast("string")).alias("id"), F.lit("workflow").alias("kind"), F.array(probe).alias("probes"), F.array(F.struct(F.lit("builds").alias("name"), (F.col("k") % 5 != 0).alias("ok"))).alias("checks"))
    files = item.groupBy("arm", "rep").agg(F.flatten(F.array_sort(F.collect_list(F.array(talk, work)))).alias("scenarios"))
    whole = F.to_json(F.struct("arm", F.struct(F.lit("off").alias("extMode")).alias("environment"), "scenarios"))
    damaged = (F.col("arm") == "A") & (F.col("rep") == "rep-3")
    text = F.when(damaged, F.left(whole, F.length(whole) - 9)).otherwise(whole)
    return files.where("not (arm = 'B' and rep = 'rep-4')").select(F.concat(F.lit("/bench/run-"), "arm", F.lit("/"), "rep", F.lit("/result.json")).alias("path"), text.alias("text"))


def scanned(spark, sf):
    expected = read(spark, sf, "benchmark").select(F.explode(F.array(F.lit("A"), F.lit("B"))).alias("arm"), F.concat(F.lit("rep-"), (F.floor(F.col("item_id") / 2) % 4 + 1).cast("string")).alias("rep")).distinct()
    return R.scan_runs(run_texts(spark, sf), expected.select(F.concat(F.lit("run-"), "arm").alias("run"), "rep"))


@Q.add(f"""WITH {NESTED}, e AS (SELECT DISTINCT 'run-' || arm AS run, 'rep-' || (item_id // 2 % 4 + 1) AS rep FROM benchmark, (VALUES ('A'), ('B')) a(arm)), n AS (SELECT 'run-' || arm AS run, rep, count(*) AS probes FROM items GROUP BY 1, 2)
SELECT e.run, e.rep, CASE WHEN (e.run, e.rep) = ('run-A', 'rep-3') AND n.run IS NOT NULL THEN 'damaged' WHEN (e.run, e.rep) = ('run-B', 'rep-4') OR n.run IS NULL THEN 'missing' ELSE 'read' END AS told, CASE WHEN (e.run, e.rep) NOT IN (('run-A', 'rep-3'), ('run-B', 'rep-4')) THEN coalesce(probes, 0) ELSE 0 END AS probes FROM e LEFT JOIN n ON n.run = e.run AND n.rep = e.rep""")
def a10_probe_scan(spark, sf):
    """What a folder of runs gives: files that are read, with their probes, and those that are damaged or missing."""
    runs, faults = scanned(spark, sf)
    counts = R.probes(runs).groupBy("run", "rep").agg(F.count(F.lit(1)).alias("probes"))
    good = runs.select("run", "rep").join(counts, ["run", "rep"], "left").select("run", "rep", F.lit("read").alias("told"), F.coalesce("probes", F.lit(0).cast("long")).alias("probes"))
    return good.union(faults.select("run", "rep", "fault", F.lit(0).cast("long")))


@Q.add(f"""WITH {RECORDS}, {NESTED}, wanted AS (SELECT pid, type, text, unnest([left(text, 40), substr(text, 41, 30), 'nowhere ' || k]) AS want, unnest([1, 2, 3]) AS g FROM asked_of WHERE type <> 'abstention' AND arm = 'A'), ask AS (SELECT pid AS query_id, text AS query FROM asked_of WHERE type <> 'abstention' AND arm = 'A'), {bm25_sql('f', 'records', 'ask', 15)},
t AS (SELECT query_id, id, rank, score / (1 + score) AS s, max(score / (1 + score)) OVER (PARTITION BY query_id) AS m, count(*) OVER (PARTITION BY query_id) AS n FROM f), h AS (SELECT * FROM t WHERE (s >= 0.3 OR (m < 0.3 AND n <= 5)) AND rank <= 5),
o AS (SELECT w.pid, count(DISTINCT g) AS found, min(rank) AS first FROM wanted w JOIN h ON h.query_id = w.pid JOIN records r ON r.id = h.id WHERE contains(r.content, want) GROUP BY w.pid)
SELECT coalesce(type, 'all') AS type, count(*) AS probes, count(found) AS hits, round(count(found) / count(*), 6) AS recall, round(avg(coalesce(found / 3, 0)), 6) AS coverage, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM asked_of a LEFT JOIN o ON o.pid = a.pid WHERE type <> 'abstention' AND arm = 'A' GROUP BY ROLLUP (type)""")
def m1_recall_table(spark, sf):
    """Recall, gold coverage and reciprocal rank by type of the probes that runs with a memory asked, read from their nested results."""
    asked = R.probes(scanned(spark, sf)[0].where("arm = 'A'"))
    return E.recall_table(asked, records(spark, sf))


@Q.add(f"WITH {NESTED} SELECT arm, 'builds' AS name, count(*) FILTER (k % 5 <> 0) AS passed, count(*) AS checks FROM asked_of GROUP BY arm")
def m4_workflow_checks(spark, sf):
    return E.check_table(R.checks(scanned(spark, sf)[0]))


@Q.add(f"""WITH {NESTED} SELECT type AS kind, count(*) AS probes, count(*) FILTER (contains(left(text, 90), left(text, 40)) OR contains(left(text, 90), substr(text, 41, 30)) OR contains(left(text, 90), 'nowhere ' || k)) AS found FROM asked_of WHERE type <> 'abstention' GROUP BY 1""")
def m8_injected_gold(spark, sf):
    """Probes of which a gold string is in the lines that were injected, from nested results."""
    asked = R.probes(scanned(spark, sf)[0]).where(F.size("gold") > 0)
    found = F.exists("gold", lambda g: F.exists("lines", lambda line: F.contains(line, g)))
    return asked.groupBy(F.col("type").alias("kind")).agg(F.count(F.lit(1)).alias("probes"), F.count_if(found).alias("found"))


@Q.add(f"""WITH {NESTED}, t AS (SELECT type, count(*) FILTER (arm = 'A' AND k % 3 = 0) AS old_hits, count(*) FILTER (arm = 'A') AS old_probes, count(*) FILTER (arm = 'B' AND k % 3 = 0) AS new_hits, count(*) FILTER (arm = 'B') AS new_probes FROM asked_of GROUP BY type),
r AS (SELECT *, round(new_hits / greatest(new_probes, 1) - old_hits / greatest(old_probes, 1), 6) AS delta, new_hits / greatest(new_probes, 1) < old_hits / greatest(old_probes, 1) - 0.01 AS fell FROM t),
s AS (SELECT sum(old_hits)::BIGINT AS old_hits, sum(old_probes)::BIGINT AS old_probes, sum(new_hits)::BIGINT AS new_hits, sum(new_probes)::BIGINT AS new_probes, bool_or(fell) AS fell FROM r), a AS (SELECT *, round(new_hits / greatest(new_probes, 1) - old_hits / greatest(old_probes, 1), 6) AS delta FROM s)
SELECT type, old_hits, old_probes, new_hits, new_probes, delta, NULL AS verdict FROM r UNION ALL SELECT 'all', old_hits, old_probes, new_hits, new_probes, delta, CASE WHEN delta > 0.05 AND NOT fell THEN 'better' WHEN delta < -0.05 THEN 'worse' ELSE 'noise' END FROM a""")
def m10_run_report(spark, sf):
    """The two runs' probes compared by type, with the verdict that their environments allow."""
    runs = checkpoint(scanned(spark, sf)[0])
    env = {r["run"]: r["env"] for r in runs.groupBy("run").agg(F.min_by("env_key", "rep").alias("env")).where("run in ('run-A', 'run-B')").collect()}
    asked = R.probes(runs)
    return E.compare_report(asked.where("run = 'run-A'"), asked.where("run = 'run-B'"), env.get("run-A"), env.get("run-B"))
