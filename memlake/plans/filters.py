"""Queries of projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import columns as C
from memlake.operators import filters as O
from memlake.operators.spans import as_of_join
from memlake.plans.registry import Queries
from memlake.sources.derived import DAY, MESSAGES, NOW, RECORDS, messages, read, records

Q = Queries()

CHAT = ", ".join(f"'{t}'" for t in C.CHAT_TYPES)
WORK = ", ".join(f"'{t}'" for t in C.WORK_TYPES)
FAMILY = f"coalesce(CASE WHEN extracted_family IN ('chat','work') THEN extracted_family END, CASE WHEN type IN ({CHAT}) THEN 'chat' WHEN type IN ({WORK}) THEN 'work' END, CASE WHEN type LIKE 'work%' THEN 'work' ELSE 'chat' END)"
STATE = f"""CASE WHEN retired_reason IN ('manual','obsolete') THEN 'retired' WHEN retired_reason IS NOT NULL THEN 'superseded'
  WHEN persistence IS NULL THEN CASE WHEN valid_to_ms > 0 AND valid_to_ms <= {NOW} THEN 'expired_suspect' ELSE 'current' END
  WHEN persistence = 'o' THEN CASE WHEN valid_to_ms IS NULL OR valid_to_ms <= 0 OR valid_to_ms > {NOW} THEN 'current' WHEN valid_to_source = 'evidence' THEN 'expired' ELSE 'expired_suspect' END
  ELSE 'historical' END"""
KEY = r"lower(trim(regexp_replace({0}, '[ \t\n\x0B\f\r\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}]+', ' ', 'g')))"


def family():
    return C.resolve_family(F.lit(None).cast("string"), F.col("extracted_family"), F.col("type"))


@Q.add(f"""WITH {RECORDS}, f AS (SELECT *, {FAMILY} AS family FROM records)
SELECT id, updated_ms FROM f WHERE family = 'work' AND wing IN ('work','general') AND len(tags) > 0 AND retired_reason IS NULL AND ext_key IS NULL
  AND (scope = 'global' OR (workspace_id <> '' AND workspace_id = 'w1')) ORDER BY updated_ms DESC, id LIMIT 50""")
def b1_browse_records(spark, sf):
    rows = records(spark, sf).withColumn("family", family())
    found = O.browse(rows, family="work", wings=("work", "general"), external=False, workspace="w1").where(F.size("tags") > 0)
    return O.page(found, 50).select("id", "updated_ms")


@Q.add(f"WITH {RECORDS} SELECT id, scope = 'global' OR coalesce(workspace_id <> '' AND workspace_id = 'w2', false) AS visible FROM records")
def b2_scope_visible(spark, sf):
    return records(spark, sf).select("id", C.scope_visible(F.col("scope"), F.col("workspace_id"), F.lit("w2")).alias("visible"))


@Q.add(f"""WITH {RECORDS}, f AS (SELECT *, {FAMILY} AS family FROM records), w AS (
  SELECT id, workspace_id, coalesce(CASE WHEN seq % 10 = 0 THEN 'workspace' END, CASE WHEN family = 'work' THEN 'workspace' ELSE 'global' END) AS wanted FROM f)
SELECT id, CASE WHEN wanted = 'workspace' AND coalesce(workspace_id <> '', false) THEN 'workspace' ELSE 'global' END AS scope,
  CASE WHEN wanted = 'workspace' AND coalesce(workspace_id <> '', false) THEN workspace_id END AS workspace_id FROM w""")
def b3_resolve_scope(spark, sf):
    explicit = F.when(F.col("seq") % 10 == 0, "workspace")
    return records(spark, sf).select("id", C.resolve_scope(F.lit("workspace"), family(), F.col("workspace_id"), explicit).alias("s")).select("id", "s.*")


@Q.add(f"WITH {RECORDS} SELECT id, {FAMILY} AS family FROM records")
def b4_resolve_family(spark, sf):
    return records(spark, sf).select("id", family().alias("family"))


@Q.add(f"""WITH {RECORDS} SELECT id, CASE WHEN type IN ('work_fact','work_artifact','persona') THEN 'facts' WHEN type IN ('episodic','work_task') THEN 'events'
  WHEN type = 'work_method' THEN 'discoveries' WHEN type = 'instruction' THEN 'preferences' END AS hall FROM records""")
def b5_cognitive_hall(spark, sf):
    return records(spark, sf).select("id", C.cognitive_hall(F.col("type")).alias("hall"))


@Q.add(f"WITH {RECORDS} SELECT id, retired_reason IS NOT NULL AS retired FROM records")
def b6_is_retired(spark, sf):
    return records(spark, sf).select("id", C.is_retired(F.col("retired_reason")).alias("retired"))


@Q.add(f"WITH {RECORDS} SELECT id, {STATE} AS state FROM records")
def b7_validity_state(spark, sf):
    return O.with_state(records(spark, sf), NOW).select("id", "state")


@Q.add(f"""WITH {RECORDS}, s AS (SELECT *, {STATE} AS state FROM records)
SELECT id, 'now' AS gate FROM s WHERE retired_reason IS NULL AND state <> 'expired'
UNION ALL SELECT id, 'past' AS gate FROM s WHERE retired_reason IS NULL AND coalesce(valid_from_ms, created_ms) <= {NOW - 20 * DAY} AND (valid_to_ms IS NULL OR valid_to_ms > {NOW - 20 * DAY})""")
def b8_validity_gate(spark, sf):
    rows = records(spark, sf)
    now, past = O.validity_gate(rows, NOW), O.validity_gate(rows, NOW, at=NOW - 20 * DAY)
    return now.select("id", F.lit("now").alias("gate")).union(past.select("id", F.lit("past").alias("gate")))


@Q.add(f"""WITH {RECORDS}, t AS (SELECT {NOW} - CAST(i AS BIGINT) * {7 * DAY} AS at_ms FROM range(12) r(i))
SELECT at_ms AS at, count(*) AS n, sum(seq) AS ids FROM t JOIN records ON retired_reason IS NULL AND coalesce(valid_from_ms, created_ms) <= at_ms AND (valid_to_ms IS NULL OR at_ms < valid_to_ms) GROUP BY at_ms""")
def b8_as_of_join(spark, sf):
    rows = records(spark, sf)
    times = spark.range(12).select((F.lit(NOW) - F.col("id") * 7 * DAY).alias("at"))
    found = as_of_join(rows, times, 7 * DAY)
    return found.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.sum(F.substring("id", 2, 20).cast("long")).alias("ids"))


@Q.add(f"""WITH {RECORDS}, s AS (SELECT *, {STATE} AS state FROM records), c AS (SELECT 'r' || item_id * 3 AS id FROM benchmark UNION ALL SELECT 'x' || item_id FROM benchmark)
SELECT c.id, CASE WHEN state = 'expired' THEN 'expired' WHEN state IN ('retired','superseded') THEN 'exited' WHEN state = 'expired_suspect' THEN 'suspect' ELSE 'keep' END AS fate FROM c LEFT JOIN s ON c.id = s.id""")
def b9_inject_filter(spark, sf):
    items = read(spark, sf, "benchmark")
    hits = items.select(F.concat(F.lit("r"), (F.col("item_id") * 3).cast("string")).alias("id")).union(items.select(F.concat(F.lit("x"), F.col("item_id").cast("string"))))
    return O.inject_filter(hits, records(spark, sf), NOW)


@Q.add(f"""WITH {MESSAGES}, a AS (SELECT DISTINCT 's' || conv_id AS session_id, CAST(turn AS INT) AS turn FROM conversations WHERE turn % 2 = 1)
SELECT m.id, m.session_id, m.turn, m.step FROM messages m JOIN a ON m.session_id = a.session_id AND m.turn = a.turn""")
def b10_fetch_by_anchor(spark, sf):
    rows = messages(spark, sf)
    anchors = rows.where("n % 2 = 1").select("session_id", F.col("n").cast("int").alias("turn")).distinct()
    return rows.join(anchors, ["session_id", "turn"]).select("id", "session_id", "turn", "step")


@Q.add(f"WITH {RECORDS} SELECT id, wing FROM records WHERE CASE WHEN coalesce(wing <> '', false) THEN wing IN ('health') OR wing = 'general' ELSE false END")
def b11_wing_lock(spark, sf):
    return O.wing_lock(records(spark, sf), ["health"], unlabeled=False, general=True).select("id", "wing")


@Q.add(f"""WITH {RECORDS}, h AS (SELECT id, {KEY.format("content")} AS hay FROM records), r(ord, path, a, n) AS (VALUES
  (1, '/w/one', ['licensed', 'merci'], ['token']), (2, '/w/two', ['token', 'und'], CAST([] AS VARCHAR[])), (3, '/w/three', ['the'], ['qui'])),
m AS (SELECT id, ord, path FROM h JOIN r ON hay <> '' AND len(list_filter(a, lambda w: contains(hay, w))) > 0 AND len(list_filter(n, lambda w: contains(hay, w))) = 0)
SELECT id, arg_min(path, ord) AS workspace FROM m GROUP BY id""")
def b12_route_by_content(spark, sf):
    rules = spark.createDataFrame([(1, "/w/one", ["licensed", "merci"], ["token"]), (2, "/w/two", ["token", "und"], []), (3, "/w/three", ["the"], ["qui"])], "ord int, path string, any_of array<string>, none_of array<string>")
    return O.route_by_content(records(spark, sf), rules)


@Q.add(f"""WITH {MESSAGES}, x AS (SELECT id, CASE WHEN n % 5 = 0 THEN '/help ' || text WHEN n % 5 = 1 THEN '[2026-01-01 10:00] ' || text || chr(10) || chr(10) || chr(10) || 'x' WHEN n % 5 = 2 THEN '<user-persona>a</user-persona>' || text ELSE text END AS t FROM messages)
SELECT id, md5(trim(regexp_replace(regexp_replace(regexp_replace(t, '(?s)<user-persona>.*?</user-persona>', '', 'g'), '(?m)^\\[[\\w\\d\\-:+ ]+\\]\\s*', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'))) AS clean_md5 FROM x WHERE trim(t) <> '' AND t NOT LIKE '/%'""".replace("\\\\", "\\"))
def b13_capture_filter(spark, sf):
    text = F.when(F.col("n") % 5 == 0, F.concat(F.lit("/help "), "text")).when(F.col("n") % 5 == 1, F.concat(F.lit("[2026-01-01 10:00] "), "text", F.lit("\n\n\nx"))).when(F.col("n") % 5 == 2, F.concat(F.lit("<user-persona>a</user-persona>"), "text")).otherwise(F.col("text"))
    rows = messages(spark, sf).select("id", text.alias("t"))
    return rows.where(C.capturable(F.col("t"))).select("id", F.md5(C.sanitized(F.col("t"))).alias("clean_md5"))


@Q.add(f"""WITH {RECORDS}, f AS (SELECT *, {FAMILY} AS family FROM records), w AS (
  SELECT id, scene, priority / 100.0 AS score, CASE WHEN coalesce(family = 'work' AND repo_key <> '' AND repo_key <> 'repo1' AND NOT coalesce(applicability = 'cross-project', false), false) THEN 0.2 ELSE 1.0 END AS weight FROM f)
SELECT id, CAST(weight AS DOUBLE) AS weight, row_number() OVER (PARTITION BY scene ORDER BY CAST(score AS DOUBLE) * weight DESC, id) AS place FROM w""")
def b14_repo_fence(spark, sf):
    from pyspark.sql import Window as W

    weight = C.fence_weight(family(), F.col("repo_key"), F.col("applicability"), F.lit("repo1"), 0.2)
    rows = records(spark, sf).select("id", "scene", (F.col("priority") / 100.0).alias("score"), weight.alias("weight"))
    return rows.select("id", "weight", F.row_number().over(W.partitionBy("scene").orderBy((F.col("score") * F.col("weight")).desc(), "id")).alias("place"))


@Q.add(f"""WITH {RECORDS}, {MESSAGES}, c AS (SELECT (SELECT count(*) FROM messages WHERE role <> 'system') AS source_rows, (SELECT count(*) FROM records) AS db_rows)
SELECT source_rows, db_rows, round(source_rows / db_rows, 6) AS ratio, CASE WHEN db_rows = 0 OR source_rows > 0 THEN 'allow' ELSE 'block' END AS decision FROM c""")
def b15_rebuild_gate(spark, sf):
    source = messages(spark, sf).where("role <> 'system'").agg(F.count(F.lit(1)).alias("source_rows"))
    db = records(spark, sf).agg(F.count(F.lit(1)).alias("db_rows"))
    both = source.join(F.broadcast(db))
    return both.select("source_rows", "db_rows", F.round(F.col("source_rows") / F.col("db_rows"), 6).alias("ratio"), F.when((F.col("db_rows") == 0) | (F.col("source_rows") > 0), "allow").otherwise("block").alias("decision"))


@Q.add(f"""WITH {RECORDS}, w AS (SELECT id, list_distinct(regexp_extract_all(lower(content), '[a-z0-9][a-z0-9_-]+')) AS t FROM records)
SELECT id, len(t) AS n_tokens, md5(array_to_string(list_sort(t), ' ')) AS tokens_md5 FROM w""")
def h1_tokens(spark, sf):
    rows = records(spark, sf).select("id", C.tokens(F.col("content")).alias("t"))
    return rows.select("id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("tokens_md5"))


@Q.add(f"""WITH {RECORDS}, t AS (SELECT id, CASE seq % 4 WHEN 1 THEN replace(content, ' ', chr(12288)) WHEN 2 THEN chr(160) || replace(content, ' ', ' ' || chr(8195)) ELSE content END AS content FROM records)
SELECT id, sha256({KEY.format('content')}) AS digest FROM t""")
def h4_content_digest(spark, sf):
    """Digests of contents, of which half are written with other spaces."""
    seq = F.col("seq") % 4
    wide = F.when(seq == 1, F.replace("content", F.lit(" "), F.lit("\u3000"))).when(seq == 2, F.concat(F.lit("\xa0"), F.replace("content", F.lit(" "), F.lit(" \u2003")))).otherwise(F.col("content"))
    return records(spark, sf).select("id", C.content_digest(wide).alias("digest"))


@Q.add(f"WITH {RECORDS} SELECT id, sha256('inputs/v1' || chr(10) || length(id) || ':' || id || chr(10) || length(scene) || ':' || scene || chr(10)) AS digest FROM records")
def h6_input_digest(spark, sf):
    return records(spark, sf).select("id", C.input_digest(F.array("id", "scene")).alias("digest"))


@Q.add(f"""WITH {RECORDS}, r AS (SELECT id, CASE WHEN seq % 9 = 0 THEN NULL ELSE CAST(seq % 7 - 4 AS DOUBLE) END AS rank FROM records)
SELECT id, round(CASE WHEN rank IS NULL THEN 0.001 WHEN rank < 0 THEN -rank / (1 - rank) ELSE 1 / (1 + rank) END, 9) AS score FROM r""")
def h7_rank_score(spark, sf):
    rank = F.when(F.col("seq") % 9 != 0, (F.col("seq") % 7 - 4).cast("double"))
    return records(spark, sf).select("id", F.round(C.rank_score(rank), 9).alias("score"))


@Q.add(f"WITH {RECORDS} SELECT id, round(greatest(0.2, pow(0.5, greatest(0, {NOW} - updated_ms) / {DAY}.0 / 30)), 9) AS aging FROM records")
def h9_aging(spark, sf):
    return records(spark, sf).select("id", F.round(C.decay_weight(F.col("updated_ms"), F.lit(NOW), 30, 0.2), 9).alias("aging"))


@Q.add(f"""WITH {RECORDS}, x AS (SELECT id, [' ' || upper(tags[1]) || ' ', tags[2], tags[1], 'bad tag', lang] AS raw FROM records WHERE len(tags) > 0),
e AS (SELECT id, u.t, u.ord FROM x, unnest(list_transform(raw, lambda t: lower(trim(t)))) WITH ORDINALITY AS u(t, ord))
SELECT id, array_to_string(list(t ORDER BY ord)[1:3], ',') AS tags FROM (SELECT id, t, min(ord) AS ord FROM e WHERE regexp_full_match(t, '[a-z0-9][a-z0-9-]{{0,31}}(/[a-z0-9][a-z0-9-]{{0,31}})?') GROUP BY id, t) GROUP BY id""")
def h10_norm_tags(spark, sf):
    raw = F.array(F.concat(F.lit(" "), F.upper(F.col("tags")[0]), F.lit(" ")), F.col("tags")[1], F.col("tags")[0], F.lit("bad tag"), F.col("lang"))
    return records(spark, sf).where(F.size("tags") > 0).select("id", F.array_join(C.norm_tags(raw), ",").alias("tags"))


@Q.add("""WITH a AS (SELECT vec_id, embedding FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.embedding AS x, b.embedding AS y FROM a JOIN a b ON b.vec_id = a.vec_id + 1)
SELECT a, b, round(list_sum(list_transform(list_zip(x, y), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(x, lambda z: CAST(z AS DOUBLE) * z))) * sqrt(list_sum(list_transform(y, lambda z: CAST(z AS DOUBLE) * z)))), 6) AS cosine FROM p""")
def h15_cosine(spark, sf):
    a = read(spark, sf, "embeddings").select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    b = a.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("x").alias("y"))
    return a.join(b, "a").select("a", "b", F.round(C.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@Q.add("""WITH g AS (SELECT a.item_id AS a, b.item_id AS b, lower(trim(a.text)) AS x, lower(trim(b.text)) AS y FROM benchmark a JOIN benchmark b ON a.item_id < b.item_id AND b.item_id - a.item_id <= 3),
s AS (SELECT a, b, list_distinct(list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3))) AS x3, list_distinct(list_transform(range(1, length(y) - 1), lambda i: substr(y, i, 3))) AS y3,
  list_distinct(list_transform(range(1, length(x)), lambda i: substr(x, i, 2))) AS x2, list_distinct(list_transform(range(1, length(y)), lambda i: substr(y, i, 2))) AS y2
  FROM (SELECT a, b, regexp_replace(x, '\\s+', ' ', 'g') AS x, regexp_replace(y, '\\s+', ' ', 'g') AS y FROM g))
SELECT a, b, round(greatest(len(list_intersect(x3, y3)) / (len(x3) + len(y3) - len(list_intersect(x3, y3))), 2 * len(list_intersect(x2, y2)) / (len(x2) + len(y2))), 4) AS score FROM s""".replace("\\\\", "\\"))
def h17_gram_score(spark, sf):
    left = read(spark, sf, "benchmark").select(F.col("item_id").alias("a"), F.col("text").alias("x"))
    right = left.select(F.col("a").alias("b"), F.col("x").alias("y")).withColumn("a", F.explode(F.sequence(F.col("b") - 3, F.col("b") - 1)))
    both = left.join(right, "a").select("a", "b", *(C.grams(F.col(c), n).alias(f"{c}{n}") for c in "xy" for n in (2, 3)))
    shared3, shared2 = F.size(F.array_intersect("x3", "y3")), F.size(F.array_intersect("x2", "y2"))
    jaccard = shared3 / (F.size("x3") + F.size("y3") - shared3)
    return both.select("a", "b", F.round(F.greatest(jaccard, 2 * shared2 / (F.size("x2") + F.size("y2"))), 4).alias("score"))
