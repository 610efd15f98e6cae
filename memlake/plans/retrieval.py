"""Queries of retrieval and of its evaluation."""

from __future__ import annotations


from pyspark.sql import functions as F

from memlake.functions import columns as C
from memlake.operators import evaluation as E
from memlake.operators import filters, ranking, recall
from memlake.operators import retrieval as O
from memlake.operators.shared import checkpoint
from memlake.plans.filters import FAMILY, KEY, STATE, family
from memlake.plans.registry import Queries
from memlake.sources.derived import DAY, MESSAGES, NOW, RECORDS, messages, read, records

Q = Queries()

TOK = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9_-]+'))"


def bm25_sql(name: str, rows: str, queries: str, k: int) -> str:
    """CTEs that end in `name` (query_id, id, score, rank); rows has (id, content), queries (query_id, query)."""
    return f"""{name}_s AS (SELECT id, {TOK.format('content')} AS t FROM {rows}), {name}_z AS (SELECT id, t, len(t) AS n FROM {name}_s WHERE len(t) > 0),
{name}_g AS (SELECT count(*) AS n, avg(n) AS mean FROM {name}_z), {name}_p AS (SELECT id, unnest(t) AS token, n AS length FROM {name}_z), {name}_q AS (SELECT query_id, unnest({TOK.format('query')}) AS token FROM {queries}),
{name}_d AS (SELECT token, count(*) AS df FROM {name}_p GROUP BY token),
{name}_r AS (SELECT query_id, id, round(sum(ln(1 + (g.n - df + 0.5) / (df + 0.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * length / mean))), 6) AS score FROM {name}_q JOIN {name}_d USING (token) JOIN {name}_p USING (token), {name}_g g GROUP BY query_id, id),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {name}_r WHERE score > 0) WHERE rank <= {k})"""


PROBES = "probes AS (SELECT CAST(item_id AS VARCHAR) AS query_id, text AS query FROM benchmark)"


def probes(spark, sf):
    return read(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))


@Q.add(f"WITH {RECORDS}, t AS (SELECT unnest({TOK.format('content')}) AS token FROM records WHERE retired_reason IS NULL) SELECT token, count(*) AS df FROM t GROUP BY token")
def i1_build_text_index(spark, sf):
    return O.text_index(records(spark, sf))[1]


@Q.add(f"WITH {RECORDS}, {PROBES}, live AS (SELECT * FROM records WHERE retired_reason IS NULL AND (scope = 'global' OR workspace_id = 'w1') AND {FAMILY} = 'chat'), {bm25_sql('f', 'live', 'probes', 10)} SELECT query_id, id, round(score / (1 + score), 6) AS score, rank FROM f")
def i2_text_search(spark, sf):
    seen = records(spark, sf).where("retired_reason is null").where(C.scope_visible(F.col("scope"), F.col("workspace_id"), F.lit("w1"))).where(family() == "chat")
    found = O.bm25(probes(spark, sf), seen, 10, stop_words=O.STOP_WORDS)
    return found.select("query_id", "id", F.round(C.rank_score(-F.col("score")), 6).alias("score"), "rank")


@Q.add(f"WITH {RECORDS}, {PROBES}, {bm25_sql('f', 'records', 'probes', 5)} SELECT query_id, id, score, rank FROM f")
def i3_bm25_search(spark, sf):
    return O.bm25(probes(spark, sf), records(spark, sf), 5)


@Q.add(f"WITH {MESSAGES}, m AS (SELECT id, text AS content FROM messages), q AS (SELECT 'q' || c_custkey AS query_id, c_mktsegment || ' the and of ' || c_name AS query FROM customer WHERE c_custkey % 20 = 0), {bm25_sql('f', 'm', 'q', 5)} SELECT query_id, id, score, rank FROM f")
def i4_message_search(spark, sf):
    asked = read(spark, sf, "customer").where("c_custkey % 20 = 0").select(F.concat(F.lit("q"), F.col("c_custkey").cast("string")).alias("query_id"), F.concat("c_mktsegment", F.lit(" the and of "), "c_name").alias("query"))
    return O.bm25(asked, messages(spark, sf), 5, text_col="text")


COS = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
LEN = "sqrt(list_sum(list_transform(x.embedding, lambda z: CAST(z AS DOUBLE) * z)))"


def vector_sql(name: str, queries: str, rows: str, k: int) -> str:
    return f"""{name}_r AS (SELECT a.query_id, b.id, round({COS} / (a.size * b.size), 6) AS score FROM (SELECT *, {LEN} AS size FROM {queries} x) a, (SELECT *, {LEN} AS size FROM {rows} x) b),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {name}_r) WHERE rank <= {k})"""


VECTORS = "vectors AS (SELECT 'r' || vec_id AS id, embedding FROM embeddings)"


def vectors(spark, sf):
    return read(spark, sf, "embeddings").select(F.concat(F.lit("r"), F.col("vec_id").cast("string")).alias("id"), "embedding")


@Q.add(f"WITH {VECTORS}, q AS (SELECT CAST(vec_id AS VARCHAR) AS query_id, embedding FROM embeddings WHERE vec_id % 20 = 0), {vector_sql('v', 'q', 'vectors', 10)} SELECT query_id, id, score, rank FROM v")
def i5_vector_search(spark, sf):
    asked = read(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").cast("string").alias("query_id"), "embedding")
    return O.vector_search(asked, vectors(spark, sf), 10)


def lanes_sql(queries: str, asked: str) -> str:
    """CTEs from live records and a table of queries and of their vectors to `fts`, `vec`, `rec`, `lanes` and `fused`."""
    return f"""livev AS (SELECT v.* FROM vectors v JOIN live ON live.id = v.id), {bm25_sql('fts', 'live', queries, 15)}, {vector_sql('vec', asked, 'livev', 15)},
found_ids AS (SELECT query_id, id FROM fts UNION SELECT query_id, id FROM vec), aged AS (SELECT query_id, b.id, round(greatest(0.5, pow(0.5, greatest(0, {NOW} - updated_ms) / {DAY}.0 / 30)), 9) AS score FROM found_ids b JOIN records r ON b.id = r.id),
rec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM aged) WHERE rank <= 15),
lanes AS (SELECT query_id, id, rank, 0 AS lane, 'fts' AS name FROM fts UNION ALL SELECT query_id, id, rank, 1, 'vec' FROM vec UNION ALL SELECT query_id, id, rank, 2, 'recency' FROM rec),
merged AS (SELECT query_id, id, round(sum(1 / (60 + rank)) * 61 / 3, 9) AS score, array_to_string(list(name ORDER BY lane), ',') AS lanes, min((lane, rank)) AS first FROM lanes GROUP BY 1, 2),
fused AS (SELECT query_id, id, score, lanes, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, id) AS rank FROM merged)"""


LIVE = "live AS (SELECT * FROM records WHERE retired_reason IS NULL)"
LANES = f"{RECORDS}, {PROBES}, {VECTORS}, {LIVE}, qv AS (SELECT CAST(item_id AS VARCHAR) AS query_id, embedding FROM benchmark JOIN embeddings ON item_id = vec_id), {lanes_sql('probes', 'qv')}"


def lanes_of(spark, sf, queries, asked):
    """The live records, and for queries (query_id, query) with vectors (query_id, embedding) the text, vector and recency lanes."""
    live = records(spark, sf).where("retired_reason is null")
    fts = checkpoint(O.bm25(queries, live, 15))
    vec = checkpoint(O.vector_search(asked, vectors(spark, sf).join(live.select("id"), "id", "left_semi"), 15))
    return live, fts, vec, O.recency_lane([fts, vec], live, NOW, 30, 15)


def lanes(spark, sf):
    of_probe = read(spark, sf, "benchmark").select(F.col("item_id").alias("k")).join(read(spark, sf, "embeddings"), F.col("k") == F.col("vec_id"))
    return lanes_of(spark, sf, probes(spark, sf), of_probe.select(F.col("k").cast("string").alias("query_id"), "embedding"))


def fused(spark, sf, k):
    live, fts, vec, recent = lanes(spark, sf)
    return live, O.fuse({"fts": fts, "vec": vec, "recency": recent}, k)


@Q.add(f"WITH {LANES} SELECT query_id, id, score, lanes, rank FROM fused WHERE rank <= 10")
def i6_hybrid_search(spark, sf):
    return fused(spark, sf, 10)[1].select("query_id", "id", "score", "lanes", "rank")


@Q.add(f"WITH {LANES} SELECT query_id, id, score, rank FROM rec")
def i7_recency_lane(spark, sf):
    return lanes(spark, sf)[3]


@Q.add(f"""WITH {LANES}, t AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS m, count(*) OVER (PARTITION BY query_id) AS n FROM fts) SELECT query_id, id, score FROM t WHERE score >= 12 OR (m < 12 AND n <= 15)""")
def i10_threshold(spark, sf):
    return O.threshold(lanes(spark, sf)[1], 12.0, 15).select("query_id", "id", "score")


@Q.add(f"WITH {LANES}, v AS (SELECT query_id, id FROM vec WHERE rank <= 5 AND CAST(query_id AS INT) % 2 = 0) SELECT query_id, id FROM v UNION ALL SELECT query_id, id FROM fts WHERE rank <= 10 AND query_id NOT IN (SELECT query_id FROM v)")
def i11_dedupe_candidates(spark, sf):
    _, fts, vec, _ = lanes(spark, sf)
    near = vec.where("rank <= 5 and cast(query_id as int) % 2 = 0").select("query_id", "id")
    return O.first_lane_with_hits(near, fts.where("rank <= 10").select("query_id", "id"))


@Q.add(f"""WITH {LANES}, s AS (SELECT *, {STATE} AS state, {FAMILY} AS family FROM records), h AS (SELECT f.query_id, f.id, f.score, f.rank, s.state, CASE WHEN coalesce(family = 'work' AND repo_key <> '' AND repo_key <> 'repo1' AND NOT coalesce(applicability = 'cross-project', false), false) THEN 0.2 ELSE 1.0 END AS w FROM fused f JOIN s ON f.id = s.id WHERE f.rank <= 15)
SELECT query_id, id, state, row_number() OVER (PARTITION BY query_id ORDER BY round(score * CAST(w AS DOUBLE), 9) DESC, rank) AS place FROM h WHERE state <> 'expired'""")
def i12_search_with_validity(spark, sf):
    live, hits = fused(spark, sf, 15)
    shown = filters.validity_gate(live, NOW).withColumn("w", C.fence_weight(family(), F.col("repo_key"), F.col("applicability"), F.lit("repo1"), 0.2)).select("id", "state", "w")
    return ranking.reordered(hits.join(shown, "id"), F.round(F.col("score") * F.col("w"), 9).desc()).select("query_id", "id", "state", "place")


TALK = f"{MESSAGES}, recent AS (SELECT session_id, text, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms DESC, id DESC) AS back FROM messages), turns AS (SELECT session_id AS query_id, right(array_to_string(list(text ORDER BY back DESC), chr(10)), 2000) AS query FROM recent WHERE back <= 8 GROUP BY session_id)"


WEIGHTS = {"work": 0.75, "health": 0.4}
RECALL = f"""WITH {RECORDS}, {TALK}, {VECTORS}, {LIVE}, tv AS (SELECT 's' || vec_id AS query_id, embedding FROM embeddings WHERE vec_id IN (SELECT conv_id FROM conversations)), {lanes_sql('turns', 'tv')},
h AS (SELECT f.query_id, f.id, f.score, f.rank, r.content, r.wing, r.tags, r.seq, {STATE} AS state, {FAMILY} AS family, repo_key, applicability, CAST(substr(f.query_id, 2) AS BIGINT) % 7 = 0 AS locked FROM fused f JOIN records r ON f.id = r.id WHERE f.rank <= 15),
a1 AS (SELECT h.*, q.query, row_number() OVER (PARTITION BY h.query_id ORDER BY CASE WHEN locked THEN 1.0 ELSE CASE wing WHEN 'work' THEN 0.75 WHEN 'health' THEN 0.4 ELSE 1.0 END END DESC, CASE WHEN locked THEN 0.0 ELSE score END DESC, rank) AS p1 FROM h JOIN turns q ON h.query_id = q.query_id WHERE NOT locked OR coalesce(wing = '', true) OR wing = 'work'),
a2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score * CAST(CASE WHEN coalesce(family = 'work' AND repo_key <> '' AND repo_key <> 'repo1' AND NOT coalesce(applicability = 'cross-project', false), false) THEN 0.2 ELSE 1.0 END AS DOUBLE), 9) DESC, p1) AS p2 FROM a1),
a3 AS (SELECT *, (SELECT coalesce(max(len(list_intersect(list_distinct(regexp_extract_all(lower(query), '[0-9a-z]{{2,}}')), list_distinct(regexp_extract_all(lower(u.p), '[0-9a-z]{{2,}}'))))), 0) FROM unnest(tags) u(p)) AS m FROM a2),
a4 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY m DESC, p2) AS p3 FROM a3),
a5 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE CASE WHEN seq % 3 = 0 THEN seq % 7 - 1 END WHEN 5 THEN 1.0 WHEN 4 THEN 0.5 WHEN 2 THEN -0.4 WHEN 1 THEN -0.7 WHEN 0 THEN -1.0 ELSE 0 END DESC, p3) AS p4 FROM a4),
scoped AS (SELECT query_id, id, p4 AS rank, seq, content, CASE WHEN length(content) <= 300 THEN content ELSE rtrim(substr(content, 1, 292)) || '...(cut)' END AS line FROM a5 WHERE state <> 'expired'), fresh AS (SELECT * FROM scoped WHERE seq % 10 <> 0),
b AS (SELECT *, 1000 - coalesce(sum(length(line) + 1) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM fresh),
v AS (SELECT *, sum(CASE WHEN length(line) > room THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS overs FROM b),
inj AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, CAST(least(length(line), room) >= length(line) AS BOOLEAN) AS whole FROM v WHERE overs = 0 OR (overs = 1 AND length(line) > room AND room >= 40))"""


def recalled(spark, sf):
    conv = F.substring("query_id", 2, 20).cast("long")
    turns = checkpoint(recall.recall_query(messages(spark, sf)))
    of_turn = read(spark, sf, "embeddings").select(F.concat(F.lit("s"), F.col("vec_id").cast("string")).alias("query_id"), "embedding").join(turns.select("query_id"), "query_id", "left_semi")
    live, fts, vec, recent = lanes_of(spark, sf, turns, of_turn)
    hits = O.fuse({"fts": fts, "vec": vec, "recency": recent}, 15).select("query_id", "id", "score", "rank")
    marked = live.withColumn("mark", F.when(F.col("seq") % 3 == 0, F.col("seq") % 7 - 1))
    locks = turns.where(conv % 7 == 0).select("query_id", F.array(F.lit("work")).alias("wings"), F.lit(True).alias("unlabeled"), F.lit(False).alias("general"))
    seen = hits.join(live.where("seq % 10 = 0").select("id"), "id", "left_semi").select("query_id", "id")
    return recall.recall(turns, hits, marked, locks, seen, NOW, recall.Settings(WEIGHTS, "repo1"))


@Q.add(f"{RECALL} SELECT query_id, id, rank, whole FROM inj")
def i13_recall_pipeline(spark, sf):
    return recalled(spark, sf)[0].select("query_id", "id", "rank", "whole")


@Q.add(f"""{RECALL}, n AS (SELECT q.query_id, (SELECT count(*) FROM scoped s WHERE s.query_id = q.query_id) AS hits, (SELECT count(*) FROM fresh s WHERE s.query_id = q.query_id) AS fresh, (SELECT count(*) FROM inj s WHERE s.query_id = q.query_id) AS injected FROM turns q)
SELECT query_id, hits, hits - fresh AS suppressed, injected, CASE WHEN injected > 0 THEN 'injected' WHEN hits > 0 THEN 'suppressed' ELSE 'none' END AS outcome FROM n""")
def i13_recall_trace(spark, sf):
    return recalled(spark, sf)[1]


GOLD = "gold AS (SELECT CAST(item_id AS VARCHAR) AS query_id, left(text, 60) AS gold, CASE WHEN item_id % 3 = 0 THEN 'extraction' WHEN item_id % 3 = 1 THEN 'multi-hop' ELSE 'update' END AS kind FROM benchmark)"


def gold(spark, sf):
    k = F.col("item_id") % 3
    return read(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.left("text", F.lit(60)).alias("gold"), F.when(k == 0, "extraction").when(k == 1, "multi-hop").otherwise("update").alias("kind"))


def hits_with_text(spark, sf):
    rows = records(spark, sf)
    return O.bm25(probes(spark, sf), rows, 5).join(rows.select("id", "content"), "id")


@Q.add(f"WITH {RECORDS}, {PROBES}, {GOLD}, {bm25_sql('f', 'records', 'probes', 5)} SELECT f.query_id, f.rank, bool_or(contains(r.content, g.gold)) AS match FROM f JOIN records r ON f.id = r.id JOIN gold g ON f.query_id = g.query_id GROUP BY 1, 2")
def c14_gold_probe_match(spark, sf):
    return E.gold_match(hits_with_text(spark, sf), gold(spark, sf)).groupBy("query_id", "rank").agg(F.bool_or("match").alias("match"))


@Q.add(f"""WITH {RECORDS}, {PROBES}, {GOLD}, {bm25_sql('f', 'records', 'probes', 5)}, m AS (SELECT g.query_id, g.kind, min(rank) FILTER (contains(r.content, g.gold)) AS best FROM gold g LEFT JOIN f ON f.query_id = g.query_id LEFT JOIN records r ON f.id = r.id GROUP BY 1, 2)
SELECT coalesce(kind, 'all') AS kind, count(*) AS probes, round(avg(CASE WHEN best IS NULL THEN 0 ELSE 1 END), 6) AS recall, round(avg(coalesce(1 / best, 0)), 6) AS mrr FROM m GROUP BY ROLLUP (kind)""")
def m1_recall_at_k(spark, sf):
    return E.recall_and_mrr(hits_with_text(spark, sf), gold(spark, sf))


@Q.add(f"WITH {LANES} SELECT query_id, id, array_to_string(list(name ORDER BY lane), ',') AS lanes FROM lanes GROUP BY 1, 2")
def g1_lane_union(spark, sf):
    _, fts, vec, recent = lanes(spark, sf)
    return O.fuse({"fts": fts, "vec": vec, "recency": recent}, 1_000_000).select("query_id", "id", "lanes")


@Q.add(f"""WITH {RECORDS}, {PROBES}, {bm25_sql('f', 'records', 'probes', 10)}, h AS (SELECT f.query_id, f.id, 'p' || (r.seq % 3) AS provider, {KEY.format('r.content')} AS key, f.rank AS r0 FROM f JOIN records r ON f.id = r.id), q AS (SELECT *, row_number() OVER (PARTITION BY query_id, provider ORDER BY r0) AS rank FROM h),
a AS (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY rank, provider) AS again FROM q), d AS (SELECT query_id, id, provider, row_number() OVER (PARTITION BY query_id, provider ORDER BY rank) AS rank FROM a WHERE again = 1), p AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank, provider) AS place FROM d)
SELECT query_id, id, place FROM p WHERE place <= 6""")
def i9_external_lane(spark, sf):
    from pyspark.sql import Window as W

    rows = records(spark, sf)
    found = O.bm25(probes(spark, sf), rows, 10).join(rows.select("id", "content", F.concat(F.lit("p"), (F.col("seq") % 3).cast("string")).alias("provider")), "id")
    own = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "provider").orderBy("rank")))
    return ranking.interleave(own, 6).select("query_id", "id", "place")
