"""Queries of the entity graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import columns as C
from memlake.operators import asof as A
from memlake.operators import graph as O
from memlake.operators.retrieval import vector_search
from memlake.operators.shared import stored
from memlake.plans.registry import Queries
from memlake.plans.retrieval import vector_sql
from memlake.sources.derived import DAY, NOW, RECORDS, epoch_ms, read, records

Q = Queries()
CAUSAL = ("supplies_first", "caused_by")


def nodes(spark, sf):
    def kind(name, key, label, type_, tags, state):
        k = F.col(key)
        status = F.when(k % 19 == 0, "archived").when(k % 7 == 0, "disputed").when(k % 23 == 0, "superseded").otherwise("active")
        updated = F.lit(NOW) - (k % 60) * DAY
        return read(spark, sf, name).select(
            F.concat(F.lit(type_[0]), k.cast("string")).alias("id"), label.alias("name"), F.lit(type_).alias("type"), tags.alias("tags"), state.alias("state"), F.lit("").alias("aliases"), F.lit("").alias("facts"), F.lit("").alias("relations"),
            status.alias("status"), updated.alias("updated_ms"), (updated - (k % 500) * DAY).alias("created_ms"))

    none = F.lit("")
    return O.union_all(
        [
            kind("customer", "c_custkey", F.col("c_name"), "customer", F.lower("c_mktsegment"), none),
            kind("supplier", "s_suppkey", F.col("s_name"), "supplier", none, none),
            kind("part", "p_partkey", F.col("p_name"), "part", F.lower("p_type"), F.lower("p_brand")),
            kind("nation", "n_nationkey", F.col("n_name"), "nation", none, none),
        ]
    )


def node_sql(table, key, label, type_, tags="''", state="''"):
    return f"SELECT '{type_[0]}' || {key} AS id, {label} AS name, '{type_}' AS type, {tags} AS tags, {state} AS state, CASE WHEN {key} % 19 = 0 THEN 'archived' WHEN {key} % 7 = 0 THEN 'disputed' WHEN {key} % 23 = 0 THEN 'superseded' ELSE 'active' END AS status, {NOW} - ({key} % 60) * {DAY} AS updated_ms, {NOW} - ({key} % 60) * {DAY} - ({key} % 500) * {DAY} AS created_ms FROM {table}"


NODES = "nodes AS (" + " UNION ALL ".join([node_sql("customer", "c_custkey", "c_name", "customer", "lower(c_mktsegment)"), node_sql("supplier", "s_suppkey", "s_name", "supplier"), node_sql("part", "p_partkey", "p_name", "part", "lower(p_type)", "lower(p_brand)"), node_sql("nation", "n_nationkey", "n_name", "nation")]) + ")"


def edges(spark, sf):
    lines = read(spark, sf, "lineitem")
    # groups by numbers, which take less of a task's memory than the texts made from them
    groups = lines.groupBy("l_suppkey", "l_partkey", F.coalesce(F.col("l_linenumber") == 1, F.lit(False)).alias("first")).agg(F.max(F.col("l_returnflag") == "R").alias("r"), epoch_ms(F.min("l_shipdate")).alias("from_ms"), epoch_ms(F.max("l_shipdate")).alias("last_ms"))
    supply = groups.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("from_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("to_id"), F.when(F.col("first"), "supplies_first").otherwise("supplies").alias("relation"), "r", "from_ms", (F.col("last_ms") + (F.col("l_partkey") % 400) * DAY).alias("to_ms"))
    place = lambda t, key, n: read(spark, sf, t).select(F.concat(F.lit(t[0]), F.col(key).cast("string")).alias("from_id"), F.concat(F.lit("n"), F.col(n).cast("string")).alias("to_id"), F.lit("located_in").alias("relation"), F.lit(False).alias("r"), F.lit(None).cast("long").alias("from_ms"), F.lit(None).cast("long").alias("to_ms"))
    every = O.union_all([supply, place("customer", "c_custkey", "c_nationkey"), place("supplier", "s_suppkey", "s_nationkey")])
    return every.select(F.concat_ws("/", "from_id", "relation", "to_id").alias("id"), "from_id", "to_id", "relation", F.when(F.col("r"), "superseded").otherwise("active").alias("status"), "from_ms", F.when(F.col("r"), F.col("to_ms")).alias("to_ms"))


EDGES = f"""edges AS (SELECT f || '/' || relation || '/' || t AS id, f AS from_id, t AS to_id, relation, CASE WHEN r THEN 'superseded' ELSE 'active' END AS status, vf, CASE WHEN r THEN vt END AS vt FROM (
  SELECT 's' || l_suppkey AS f, 'p' || l_partkey AS t, CASE WHEN l_linenumber = 1 THEN 'supplies_first' ELSE 'supplies' END AS relation, bool_or(l_returnflag = 'R') AS r, epoch_us(min(l_shipdate)) // 1000 AS vf, epoch_us(max(l_shipdate)) // 1000 + max(l_partkey % 400) * {DAY} AS vt FROM lineitem GROUP BY 1, 2, 3
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'located_in', false, NULL, NULL FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'located_in', false, NULL, NULL FROM supplier)),
ways AS (SELECT from_id AS a, to_id AS b, relation FROM edges WHERE status = 'active' UNION ALL SELECT to_id, from_id, relation FROM edges WHERE status = 'active'),
vis AS (SELECT * FROM nodes WHERE status IN ('active', 'disputed'))"""
DEG = "deg AS (SELECT id, count(*) AS degree, count(*) FILTER (relation IN ('supplies_first', 'caused_by')) AS causal FROM (SELECT unnest([from_id, to_id]) AS id, relation FROM edges WHERE status = 'active' AND from_id IN (SELECT id FROM vis) AND to_id IN (SELECT id FROM vis)) GROUP BY id)"
SOURCES = "sources AS (SELECT id, 'r' || ((CAST(substr(id, 2) AS BIGINT) * m) % 1200) AS record_id, pos FROM nodes, (VALUES (3, 0), (7, 1)) x(m, pos))"


def sources(spark, sf):
    k = F.substring("id", 2, 20).cast("long")
    each = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(pos).alias("pos")) for m, pos in ((3, 0), (7, 1))))
    return nodes(spark, sf).select("id", F.explode(each).alias("x")).select("id", F.concat(F.lit("r"), ((k * F.col("x.m")) % 1200).cast("string")).alias("record_id"), "x.pos")


EPOCH_1996 = 820_454_400_000


def facts(spark, sf):
    rows = read(spark, sf, "part")
    k = F.col("p_partkey")
    since = F.lit(EPOCH_1996) + (k % 2000) * DAY
    return rows.select(F.concat(F.lit("p"), k.cast("string")).alias("id"), F.concat(F.lit("r"), ((k * 11) % 1200).cast("string")).alias("record_id"), F.lit(0).alias("pos"), F.when(k % 3 == 0, "superseded").otherwise("active").alias("status"), F.concat(F.lit("size_"), F.col("p_size").cast("string")).alias("text"), since.alias("from_ms"), F.when(k % 5 != 0, since + (k % 900) * DAY).alias("to_ms"))


FACTS = f"facts AS (SELECT 'p' || p_partkey AS id, 'r' || ((p_partkey * 11) % 1200) AS record_id, 0 AS pos, CASE WHEN p_partkey % 3 = 0 THEN 'superseded' ELSE 'active' END AS status, 'size_' || p_size AS text, {EPOCH_1996} + (p_partkey % 2000) * {DAY} AS vf, CASE WHEN p_partkey % 5 <> 0 THEN {EPOCH_1996} + (p_partkey % 2000) * {DAY} + (p_partkey % 900) * {DAY} END AS vt FROM part)"
TOK = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9_-]+'))"
#: Questions: every twentieth part asks for its name, the customer and the supplier of its number and a nation, two of three times for a time in the past.
ASKED_SQL = f"asked AS (SELECT 'q' || p_partkey AS query_id, p_name || ' ' || lpad(p_partkey::VARCHAR, 9, '0') || ' nation_' || (p_partkey % 25) || ' size_' || p_size || CASE WHEN p_partkey % 200 = 0 THEN ' supplies_first' ELSE '' END AS query, CASE WHEN p_partkey % 60 = 20 THEN {NOW} - (p_partkey % 300) * {DAY} WHEN p_partkey % 60 = 40 THEN {EPOCH_1996} + (p_partkey % 1500) * {DAY} END AS at_ms FROM part WHERE p_partkey % 20 = 0)"


def asked(spark, sf):
    k = F.col("p_partkey")
    text = F.concat("p_name", F.lit(" "), F.lpad(k.cast("string"), 9, "0"), F.lit(" nation_"), (k % 25).cast("string"), F.lit(" size_"), F.col("p_size").cast("string"), F.when(k % 200 == 0, " supplies_first").otherwise(""))
    at = F.when(k % 60 == 20, F.lit(NOW) - (k % 300) * DAY).when(k % 60 == 40, F.lit(EPOCH_1996) + (k % 1500) * DAY)
    return read(spark, sf, "part").where(k % 20 == 0).select(F.concat(F.lit("q"), k.cast("string")).alias("query_id"), text.alias("query"), at.alias("at_ms"))


def found(spark, sf, links):
    return A.search(asked(spark, sf), nodes(spark, sf), facts(spark, sf), links)


#: What holds for a query: active rows, and superseded ones in whose span its time lies.
HELD = "({0}.status = 'active' OR ({0}.status = 'superseded' AND at_ms IS NOT NULL AND ({0}.vf IS NULL OR {0}.vf <= at_ms) AND ({0}.vt IS NULL OR at_ms < {0}.vt)))"
SEARCH = f"""qt AS (SELECT query_id, at_ms, unnest({TOK.format('query')}) AS token FROM asked),
hit0 AS (SELECT query_id, id, field, w, token FROM (SELECT id, unnest(['name', 'tags', 'state', 'type']) AS field, unnest([6, 5, 4, 2]) AS w, unnest([{TOK.format('name')}, {TOK.format('tags')}, {TOK.format('state')}, {TOK.format('type')}]) AS t FROM vis) n JOIN qt ON list_contains(t, token)
  UNION SELECT query_id, f.id, 'facts', 4, token FROM (SELECT facts.*, unnest({TOK.format('text')}) AS token FROM facts SEMI JOIN vis ON vis.id = facts.id) f JOIN qt USING (token) WHERE {HELD.format('f')}
  UNION SELECT query_id, e.id, 'relations', 3, token FROM (SELECT unnest([from_id, to_id]) AS id, status, vf, vt, unnest([{TOK.format('relation')}, {TOK.format('relation')}]) AS t FROM edges) e JOIN qt ON list_contains(t, token) SEMI JOIN vis ON vis.id = e.id WHERE {HELD.format('e')}),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, updated_ms DESC, id) AS rank FROM (SELECT query_id, hit0.id, sum(w) AS score, any_value(updated_ms) AS updated_ms, list_sort(list(DISTINCT field)) AS fields FROM hit0 JOIN vis ON vis.id = hit0.id GROUP BY 1, 2) WHERE fields <> ['relations']) WHERE rank <= 10)"""
#: Records of hits (a table of query_id, id, rank) at the queries' times: places of direct ones, then of those of neighbours.
EXPAND = f"""d AS (SELECT query_id, record_id, min((rank, part, pos)) AS o FROM (SELECT query_id, record_id, rank, 0 AS part, pos FROM {{0}} JOIN sources USING (id) UNION ALL SELECT query_id, record_id, rank, 1, pos FROM {{0}} JOIN asked USING (query_id) JOIN facts USING (id) WHERE {HELD.format('facts')}) GROUP BY 1, 2),
near AS (SELECT DISTINCT query_id, at_ms, other FROM {{0}} h JOIN asked USING (query_id) JOIN (SELECT from_id AS id, to_id AS other, status, vf, vt FROM edges UNION ALL SELECT to_id, from_id, status, vf, vt FROM edges) e ON e.id = h.id WHERE {HELD.format('e')}),
r AS (SELECT query_id, record_id, min((-updated_ms, other, pos)) AS o FROM near JOIN nodes n ON n.id = other JOIN sources s ON s.id = other WHERE (n.status IN ('active', 'disputed') OR (n.status = 'superseded' AND created_ms <= at_ms AND at_ms < updated_ms)) AND (query_id, other) NOT IN (SELECT (query_id, id) FROM {{0}}) AND (query_id, record_id) NOT IN (SELECT (query_id, record_id) FROM d) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o) AS k FROM r), p AS (SELECT query_id, record_id, row_number() OVER (PARTITION BY query_id ORDER BY o) AS place FROM d UNION ALL SELECT k.query_id, record_id, k + coalesce(n, 0) FROM k LEFT JOIN (SELECT query_id, count(*) AS n FROM d GROUP BY 1) USING (query_id) WHERE k <= 64)"""


@Q.add(f"WITH {NODES}, {EDGES}, {FACTS}, {ASKED_SQL}, {SEARCH} SELECT query_id, id, CAST(score AS BIGINT) AS score, array_to_string(fields, ',') AS fields, rank FROM hits")
def j1_node_search(spark, sf):
    links = stored(edges(spark, sf).drop("id"))
    return found(spark, sf, links).select("query_id", "id", "score", F.array_join("fields", ",").alias("fields"), "rank")


@Q.add(f"""WITH {ASKED_SQL}, c AS (SELECT 't' || p_partkey AS id, p_name AS name, p_type || ' of ' || p_brand AS definition, p_type AS category, p_partkey AS updated_ms FROM part),
s AS (SELECT query_id, n.id, sum(w) AS score, max(updated_ms) AS u FROM (SELECT id, updated_ms, unnest([6, 5, 3]) AS w, unnest([name, definition, category]) AS f FROM c) n, (SELECT query_id, unnest({TOK.format('query')}) AS token FROM asked) q WHERE list_contains({TOK.format('f')}, token) GROUP BY 1, 2)
SELECT query_id, id, CAST(score AS BIGINT) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, u DESC, id) AS rank FROM s) WHERE rank <= 10""")
def j2_concept_search(spark, sf):
    concepts = read(spark, sf, "part").select(F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.concat("p_type", F.lit(" of "), "p_brand").alias("definition"), F.col("p_type").alias("category"), F.lit("").alias("aliases"), F.lit("").alias("facts"), F.col("p_partkey").alias("updated_ms"))
    return O.field_search(asked(spark, sf), concepts, O.CONCEPT_WEIGHTS, 10, None).select("query_id", "id", "score", "rank")


@Q.add(f"WITH {NODES}, {EDGES}, {SOURCES}, {FACTS}, {ASKED_SQL}, {SEARCH}, {EXPAND.format('hits')} SELECT query_id, record_id, place FROM p")
def j3_expand_to_records(spark, sf):
    links = stored(edges(spark, sf).drop("id"))
    return A.expand(found(spark, sf, links), asked(spark, sf), nodes(spark, sf), links, sources(spark, sf), facts(spark, sf))


@Q.add(f"WITH {NODES}, {EDGES}, {DEG} SELECT * FROM deg")
def j4_degrees(spark, sf):
    return O.degrees(nodes(spark, sf), edges(spark, sf), CAUSAL)


@Q.add(f"""WITH {NODES}, {EDGES}, {DEG}, n AS (SELECT a AS center, b AS id, relation, row_number() OVER (PARTITION BY a ORDER BY relation IN ('supplies_first', 'caused_by') DESC, coalesce(degree, 0) DESC, updated_ms DESC, b, relation) AS place
  FROM ways JOIN vis ON vis.id = b LEFT JOIN deg ON deg.id = b WHERE a LIKE 's%') SELECT * FROM n WHERE place <= 10""")
def j5_ego_neighbors(spark, sf):
    centers = nodes(spark, sf).where("type = 'supplier'").select("id")
    return O.neighbors(centers, nodes(spark, sf), edges(spark, sf), CAUSAL, 10)


@Q.add(f"""WITH RECURSIVE {NODES}, {EDGES}, {DEG}, k AS (SELECT v.id, degree + 2 * causal AS score, row_number() OVER (ORDER BY degree + 2 * causal DESC, causal DESC, updated_ms DESC, v.id) AS k FROM vis v JOIN deg d ON d.id = v.id), nb AS (SELECT a, list(DISTINCT b) AS near FROM ways GROUP BY a),
r(k, taken) AS (SELECT 0::BIGINT, []::VARCHAR[] UNION ALL SELECT k.k, CASE WHEN list_has_any(near, taken) THEN taken ELSE list_append(taken, k.id) END FROM r JOIN k ON k.k = r.k + 1 JOIN nb ON nb.a = k.id WHERE len(taken) < 6),
c AS (SELECT unnest(taken) AS id, unnest(range(1, len(taken) + 1)) AS place FROM r ORDER BY k DESC LIMIT 6) SELECT CAST(place AS INT) AS place, c.id, score FROM c JOIN k ON k.id = c.id""")
def j6_seed_selection(spark, sf):
    return O.seeds(nodes(spark, sf), edges(spark, sf), CAUSAL, 6, ("causal", "updated_ms"))


@Q.add(f"""WITH {NODES}, {EDGES}, {SOURCES}, w AS (SELECT 'r' || (item_id * 3) AS record_id FROM benchmark), z AS (SELECT DISTINCT record_id, id FROM w JOIN sources USING (record_id) WHERE id IN (SELECT id FROM vis)),
o AS (SELECT DISTINCT record_id, b AS id FROM z JOIN ways ON z.id = a WHERE b IN (SELECT id FROM vis) AND (record_id, b) NOT IN (SELECT (record_id, id) FROM z)),
t AS (SELECT DISTINCT record_id, b AS id FROM o JOIN ways ON o.id = a WHERE b IN (SELECT id FROM vis) AND (record_id, b) NOT IN (SELECT (record_id, id) FROM z UNION ALL SELECT (record_id, id) FROM o))
SELECT record_id, id, 0 AS hop FROM z UNION ALL SELECT record_id, id, 1 FROM o UNION ALL SELECT record_id, id, 2 FROM t""")
def j8_record_links(spark, sf):
    wanted = read(spark, sf, "benchmark").select(F.concat(F.lit("r"), (F.col("item_id") * 3).cast("string")).alias("record_id"))
    return O.record_links(wanted, nodes(spark, sf), edges(spark, sf), sources(spark, sf))


def related_entities(spark, sf):
    """What `O.related_entities` gives for the records of the benchmark, and the active edges."""
    wanted = read(spark, sf, "benchmark").select(F.concat(F.lit("r"), (F.col("item_id") * 3).cast("string")).alias("record_id"))
    links = stored(edges(spark, sf).where("status = 'active'").select("from_id", "to_id", "relation", "status"))
    return *O.related_entities(wanted, nodes(spark, sf), links, sources(spark, sf), CAUSAL), links


RELATED = f"""w AS (SELECT 'r' || (item_id * 3) AS record_id FROM benchmark), inf AS (SELECT v.id, updated_ms, coalesce(degree, 0) AS degree FROM vis v LEFT JOIN deg d ON d.id = v.id),
en AS (SELECT record_id, id, degree, row_number() OVER (PARTITION BY record_id ORDER BY degree DESC, updated_ms DESC, id) AS place FROM (SELECT DISTINCT record_id, id FROM w JOIN sources USING (record_id)) JOIN inf USING (id)),
l1 AS (SELECT e.record_id, b AS id, relation, a AS via, 1 AS hop, e.place FROM en e JOIN ways ON a = e.id SEMI JOIN vis ON vis.id = b ANTI JOIN en x ON x.record_id = e.record_id AND x.id = b),
f1 AS (SELECT record_id, id, row_number() OVER (PARTITION BY record_id ORDER BY p, id) AS place FROM (SELECT record_id, id, min(place) AS p FROM l1 GROUP BY 1, 2)),
l2 AS (SELECT e.record_id, b AS id, relation, a AS via, 2 AS hop, e.place FROM f1 e JOIN ways ON a = e.id SEMI JOIN vis ON vis.id = b ANTI JOIN en x ON x.record_id = e.record_id AND x.id = b),
f2 AS (SELECT record_id, id, row_number() OVER (PARTITION BY record_id ORDER BY p, id) AS place FROM (SELECT record_id, id, min(place) AS p FROM l2 ANTI JOIN f1 ON f1.record_id = l2.record_id AND f1.id = l2.id GROUP BY 1, 2))"""


@Q.add(f"""WITH {NODES}, {EDGES}, {DEG}, {SOURCES}, {RELATED}, n AS (SELECT record_id, l.id, relation, relation IN ('supplies_first', 'caused_by') AS causal, via, hop, degree, row_number() OVER (PARTITION BY record_id ORDER BY relation IN ('supplies_first', 'caused_by') DESC, hop, degree DESC, updated_ms, l.id, via, relation) AS place FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) l JOIN inf ON inf.id = l.id) SELECT * FROM n WHERE place <= 60""")
def j8_record_neighbours(spark, sf):
    seen, entities, links = related_entities(spark, sf)
    return O.related_neighbours(entities, seen, links, CAUSAL)


@Q.add(f"""WITH {NODES}, {EDGES}, {DEG}, {SOURCES}, {RELATED}, p AS (SELECT record_id, id, 0 AS hop, place FROM en UNION ALL SELECT record_id, id, 1, place FROM f1 UNION ALL SELECT record_id, id, 2, place FROM f2),
q AS (SELECT p.record_id, s.record_id AS related, min((hop, place, pos)) AS o FROM p JOIN sources s ON s.id = p.id WHERE s.record_id <> p.record_id GROUP BY 1, 2) SELECT record_id, related, place FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY o) AS place FROM q) WHERE place <= 60""")
def j8_related_records(spark, sf):
    seen, entities, links = related_entities(spark, sf)
    return O.related_records(entities, seen, links, sources(spark, sf))


@Q.add(f"""WITH {NODES}, {EDGES}, z AS (SELECT 's1' AS id), o AS (SELECT DISTINCT b AS id FROM ways WHERE a = 's1' AND b <> 's1' AND b IN (SELECT id FROM vis)),
t AS (SELECT DISTINCT b AS id FROM ways JOIN o ON a = o.id WHERE b IN (SELECT id FROM vis) AND b <> 's1' AND b NOT IN (SELECT id FROM o)),
h AS (SELECT DISTINCT b AS id FROM ways JOIN t ON a = t.id WHERE b IN (SELECT id FROM vis) AND b <> 's1' AND b NOT IN (SELECT id FROM o) AND b NOT IN (SELECT id FROM t))
SELECT * FROM (SELECT id, 0 AS depth FROM z UNION ALL SELECT id, 1 FROM o UNION ALL SELECT id, 2 FROM t UNION ALL SELECT id, 3 FROM h) ORDER BY depth, id LIMIT 300""")
def j9_k_hop_ego(spark, sf):
    return O.ego("s1", nodes(spark, sf), edges(spark, sf), 3, 300)


@Q.add(f"""WITH {NODES}, {EDGES}, z AS (SELECT 's1' AS id), o AS (SELECT DISTINCT b AS id FROM ways WHERE a = 's1' AND b <> 's1' AND b IN (SELECT id FROM vis)),
t AS (SELECT DISTINCT b AS id FROM ways JOIN o ON a = o.id WHERE b IN (SELECT id FROM vis) AND b <> 's1' AND b NOT IN (SELECT id FROM o)),
h AS (SELECT DISTINCT b AS id FROM ways JOIN t ON a = t.id WHERE b IN (SELECT id FROM vis) AND b <> 's1' AND b NOT IN (SELECT id FROM o) AND b NOT IN (SELECT id FROM t))
SELECT least(count(*), 300) AS shown, greatest(count(*) - 300, 0) AS cut FROM (SELECT id FROM z UNION ALL SELECT id FROM o UNION ALL SELECT id FROM t UNION ALL SELECT id FROM h)""")
def j9_ego_counts(spark, sf):
    return O.ego_counts("s1", nodes(spark, sf), edges(spark, sf), 3, 300)


@Q.add(f"""WITH {NODES}, {EDGES}, s AS (SELECT id FROM vis WHERE pow(0.5, greatest(0, {NOW} - updated_ms) / {DAY}.0 / 30) >= 0.3 ORDER BY id LIMIT 1500)
SELECT id FROM edges WHERE status = 'active' AND from_id IN (SELECT id FROM s) AND to_id IN (SELECT id FROM s) ORDER BY id LIMIT 3000""")
def j10_full_view(spark, sf):
    return O.full_view(nodes(spark, sf), edges(spark, sf), NOW, least=0.3)[1].select("id")


@Q.add(f"""WITH {RECORDS}, {NODES}, {SOURCES}, m AS (SELECT DISTINCT s.id, s.record_id, updated_ms, scene, wing FROM (SELECT id, record_id FROM sources) s JOIN (SELECT id AS record_id, updated_ms, scene, wing FROM records) r USING (record_id)),
sc AS (SELECT id, arg_min(scene, (-n, scene)) AS scene FROM (SELECT id, scene, count(*) AS n FROM m GROUP BY 1, 2) GROUP BY id), wi AS (SELECT id, arg_min(wing, (-n, wing)) AS wing FROM (SELECT id, wing, count(*) AS n FROM m WHERE wing IS NOT NULL GROUP BY 1, 2) GROUP BY id)
SELECT m.id, max(updated_ms) AS latest_ms, any_value(sc.scene) AS scene, any_value(wi.wing) AS wing FROM m LEFT JOIN sc ON m.id = sc.id LEFT JOIN wi ON m.id = wi.id GROUP BY m.id""")
def j11_node_source_meta(spark, sf):
    return O.source_meta(sources(spark, sf), records(spark, sf))


def order_facts(spark, sf):
    o = read(spark, sf, "orders")
    return o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("node"), F.substring("o_orderpriority", 1, 1).alias("key"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "P", "disputed").otherwise("active").alias("status"), epoch_ms(F.col("o_orderdate")).alias("valid_from_ms"), F.when(F.col("o_orderkey") % 9 == 0, epoch_ms(F.col("o_orderdate")) + DAY).alias("valid_to_ms"))


@Q.add(f"""WITH f AS (SELECT 'c' || o_custkey AS node, substr(o_orderpriority, 1, 1) AS key, o_orderkey AS seq, CASE WHEN o_orderstatus = 'P' THEN 'disputed' ELSE 'active' END AS status, (epoch_us(o_orderdate) // 1000) AS vf, CASE WHEN o_orderkey % 9 = 0 THEN (epoch_us(o_orderdate) // 1000) + {DAY} END AS vt FROM orders),
l AS (SELECT *, lead(vf) OVER w AS nf, lead(seq) OVER w AS ns FROM f WINDOW w AS (PARTITION BY node, key ORDER BY seq))
SELECT node, key, seq, CASE WHEN status = 'active' AND ns IS NOT NULL THEN 'superseded' ELSE status END AS status, vf AS valid_from_ms, CASE WHEN status = 'active' AND ns IS NOT NULL THEN coalesce(vt, nf) ELSE vt END AS valid_to_ms FROM l""")
def j12_fact_history(spark, sf):
    return O.fact_history(order_facts(spark, sf))


@Q.add(f"""WITH f AS (SELECT 'c' || o_custkey AS node, substr(o_orderpriority, 1, 1) AS key, o_orderstatus AS value, o_orderkey AS seq, CASE WHEN o_orderkey % 9 = 0 THEN 'disputed' ELSE 'active' END AS status FROM orders),
l AS (SELECT node, key, arg_max(value, seq) AS value FROM f WHERE status = 'active' GROUP BY 1, 2) SELECT node, string_agg(key || ': ' || value, chr(10) ORDER BY key || ': ' || value) AS state FROM l GROUP BY node""")
def j12_state_text(spark, sf):
    o = read(spark, sf, "orders")
    rows = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("node"), F.substring("o_orderpriority", 1, 1).alias("key"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 9 == 0, "disputed").otherwise("active").alias("status"))
    return O.state_text(rows)


@Q.add("""WITH e AS (SELECT 'c' || o_custkey AS from_id, 'status' AS relation, o_orderstatus AS to_id, o_orderkey AS seq, (epoch_us(o_orderdate) // 1000) AS vf FROM orders),
c AS (SELECT *, CASE WHEN lag(to_id) OVER w = to_id THEN 0 ELSE 1 END AS ch FROM e WINDOW w AS (PARTITION BY from_id, relation ORDER BY seq)), i AS (SELECT *, sum(ch) OVER (PARTITION BY from_id, relation ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM c),
r AS (SELECT from_id, relation, island, to_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n, arg_min(vf, seq) AS vf FROM i GROUP BY 1, 2, 3, 4)
SELECT from_id, relation, to_id, first_seq, last_seq, n, CASE WHEN lead(island) OVER w IS NULL THEN 'active' ELSE 'superseded' END AS status, lead(vf) OVER w AS valid_to_ms FROM r WINDOW w AS (PARTITION BY from_id, relation ORDER BY island)""")
def j14_edge_history(spark, sf):
    o = read(spark, sf, "orders")
    return O.edge_history(o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("from_id"), F.lit("status").alias("relation"), F.col("o_orderstatus").alias("to_id"), F.col("o_orderkey").alias("seq"), epoch_ms(F.col("o_orderdate")).alias("valid_from_ms")))


@Q.add(f"""WITH {RECORDS}, {NODES}, {SOURCES}, s AS (SELECT s.id, bool_and(r.id IS NULL) AS gone, bool_and(coalesce(r.retired_reason IS NOT NULL, true) OR r.id IS NULL) AS exited, bool_and(r.id IS NOT NULL AND r.retired_reason IS NULL) AS live, bool_or(r.id IS NOT NULL AND r.seq % 23 = 0) AS disputed FROM (SELECT DISTINCT id, record_id FROM sources) s LEFT JOIN records r ON s.record_id = r.id GROUP BY s.id)
SELECT n.id, CASE WHEN n.status IN ('active', 'disputed') AND (gone OR exited) THEN 'archived' WHEN n.status = 'archived' AND live THEN 'active' WHEN n.status = 'active' AND disputed THEN 'disputed' WHEN n.status = 'disputed' AND NOT disputed THEN 'active' ELSE n.status END AS status FROM nodes n LEFT JOIN s ON n.id = s.id""")
def j15_j16_j17_propagation(spark, sf):
    rows = records(spark, sf).withColumn("disputed", F.col("seq") % 23 == 0)
    return O.propagate(nodes(spark, sf), sources(spark, sf), rows)


@Q.add(f"""WITH {RECORDS}, o AS (SELECT * FROM records WHERE NOT (seq % 3 = 0 AND version = 1) ORDER BY priority DESC, updated_ms, id LIMIT 200) SELECT id, (row_number() OVER (ORDER BY priority DESC, updated_ms, id) - 1) // 8 AS batch FROM o""")
def j19_projection_backlog(spark, sf):
    rows = records(spark, sf)
    return O.backlog(rows, rows.where("seq % 3 = 0").select("id", F.lit(1).alias("version")), 8, 200)


@Q.add(f"WITH {RECORDS}, {NODES}, {SOURCES} SELECT id, record_id, pos FROM sources WHERE record_id NOT IN (SELECT id FROM records WHERE retired_reason = 'manual')")
def j20_forget_records(spark, sf):
    gone = records(spark, sf).where("retired_reason = 'manual'").select(F.col("id").alias("record_id"))
    return sources(spark, sf).join(gone, "record_id", "left_anti").select("id", "record_id", "pos")


@Q.add(f"""WITH {NODES}, {EDGES}, l AS (SELECT from_id, from_id || ' —[' || relation || ']→ ' || to_id AS line FROM edges WHERE status = 'active'), k AS (SELECT from_id, line, row_number() OVER (PARTITION BY from_id ORDER BY line) AS n FROM l)
SELECT from_id, line FROM k WHERE n <= 5 UNION ALL SELECT id, name FROM vis WHERE id NOT IN (SELECT from_id FROM edges WHERE status = 'active') AND id NOT IN (SELECT to_id FROM edges WHERE status = 'active')""")
def d27_graph_hints(spark, sf):
    return O.hints(nodes(spark, sf), edges(spark, sf), 5)


SCORED = f"{DEG}, sc AS (SELECT v.id, v.updated_ms, coalesce(degree, 0) + 2 * coalesce(causal, 0) AS score FROM vis v LEFT JOIN deg d ON v.id = d.id), l1 AS (SELECT id, score, 'skeleton' AS layer FROM sc ORDER BY score DESC, id LIMIT 120), l2 AS (SELECT id, score, 'fresh' AS layer FROM sc WHERE id NOT IN (SELECT id FROM l1) ORDER BY updated_ms DESC, id LIMIT 40), l3 AS (SELECT id, score, 'tail' AS layer FROM sc WHERE id NOT IN (SELECT id FROM l1) AND id NOT IN (SELECT id FROM l2) ORDER BY score DESC, id LIMIT 40), ch AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)"


@Q.add(f"WITH {NODES}, {EDGES}, {SCORED} SELECT id, layer FROM ch")
def j7_explorer_sample(spark, sf):
    return O.explorer_sample(nodes(spark, sf), edges(spark, sf), CAUSAL, 200, 300)[0]


@Q.add(f"WITH {NODES}, {EDGES}, {SCORED} SELECT e.id, relation FROM edges e JOIN ch a ON from_id = a.id JOIN ch b ON to_id = b.id WHERE status = 'active' ORDER BY relation IN ('supplies_first', 'caused_by') DESC, a.score + b.score DESC, e.id LIMIT 300")
def j7_explorer_edges(spark, sf):
    return O.explorer_sample(nodes(spark, sf), edges(spark, sf), CAUSAL, 200, 300)[1]


@Q.add(f"""WITH {NODES}, a AS (SELECT DISTINCT unnest({TOK.format("p_type || ' nation_3 red'")}) AS token FROM part), k AS (SELECT DISTINCT id, unnest([regexp_replace(lower(name), '[ _-]+', '', 'g'), regexp_replace(lower(tags), '[ _-]+', '', 'g')]) AS key FROM nodes),
f AS (SELECT key, min(id) AS first FROM k WHERE key <> '' GROUP BY 1), cov AS (SELECT DISTINCT id FROM k JOIN f USING (key) WHERE id <> first), l AS (SELECT * FROM nodes WHERE id NOT IN (SELECT id FROM cov)),
r AS (SELECT id, updated_ms, len(list_intersect({TOK.format("name || ' ' || tags || ' ' || state")}, (SELECT list(token) FROM a))) > 0 AS related FROM l) SELECT id, related FROM r ORDER BY related DESC, updated_ms DESC, id LIMIT 60""")
def f7_context_nodes(spark, sf):
    texts = read(spark, sf, "part").select(F.concat("p_type", F.lit(" nation_3 red")).alias("text"))
    return O.context_nodes(texts, nodes(spark, sf), 60)


SEEDED = f"""v0 AS (SELECT 'q' || vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 20 = 0 AND 'q' || vec_id IN (SELECT query_id FROM asked)), v1 AS (SELECT 'p' || vec_id AS id, embedding FROM embeddings WHERE 'p' || vec_id IN (SELECT id FROM vis)), {vector_sql('nearest', 'v0', 'v1', 3)},
seeded AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY lane, rank) AS rank FROM (SELECT query_id, id, 0 AS lane, rank FROM hits UNION ALL SELECT query_id, id, 1, rank FROM nearest WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM hits)))"""


@Q.add(f"""WITH {RECORDS}, {NODES}, {EDGES}, {SOURCES}, {FACTS}, {ASKED_SQL}, {SEARCH}, {SEEDED}, {EXPAND.format('seeded')}
SELECT query_id, record_id, place FROM p JOIN records r ON p.record_id = r.id WHERE r.retired_reason IS NULL AND (r.scope = 'global' OR coalesce(r.workspace_id = 'w1', false))""")
def i8_graph_lane(spark, sf):
    seen_nodes = O.visible(nodes(spark, sf))
    e, questions = read(spark, sf, "embeddings"), asked(spark, sf)
    asked_vectors = e.where("vec_id % 20 = 0").select(F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("query_id"), "embedding").join(questions.select("query_id"), "query_id", "left_semi")
    of_nodes = e.select(F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("id"), "embedding").join(seen_nodes.select("id"), "id", "left_semi")
    links = stored(edges(spark, sf).drop("id"))
    hits = O.with_seeds(found(spark, sf, links).select("query_id", "id", "rank"), vector_search(asked_vectors, of_nodes, 3))
    found_ids = A.expand(hits, questions, nodes(spark, sf), links, sources(spark, sf), facts(spark, sf))
    seen = records(spark, sf).where("retired_reason is null").where(C.scope_visible(F.col("scope"), F.col("workspace_id"), F.lit("w1"))).select(F.col("id").alias("record_id"))
    return found_ids.join(seen, "record_id").select("query_id", "record_id", "place")
