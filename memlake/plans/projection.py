"""Queries of names, and of what is proposed to and kept up in the entity graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import names as N
from memlake.operators import graph as G
from memlake.operators import projection as P
from memlake.operators import sweep as S
from memlake.plans.registry import Queries
from memlake.sources.derived import NOW, RECORDS, epoch_ms, pick, read, records

Q = Queries()
#: Fixed words and the tests of names as SQL; names here have no white space but spaces.
ROLE_SQL = "[" + ", ".join(f"'{w}'" for w in N.ROLE_WORDS) + "]"
TYPE_SQL = "[" + ", ".join(f"'{t}'" for t in N.NODE_TYPES) + "]"
KEYS_SQL = "[" + ", ".join(f"'{k}'" for k in (*N.FACT_KEYS, N.UNRULED)) + "]"
SYNONYM_SQL = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in N.FACT_SYNONYMS.items()) + " ELSE {0} END"
NAME_KEY = "coalesce(nullif(regexp_replace(lower({0}), '[ _-]+', '', 'g'), ''), {0})"


def matches(text: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, '{p}')" for p in patterns) + ")"


def path_sql(n: str) -> str:
    return f"(NOT {matches(f'trim({n})', N.NO_PATHS)} AND {matches(f'trim({n})', N.PATHS)})"


def descriptive_sql(n: str) -> str:
    return f"(length(trim({n})) > {N.LONGEST_NAME} OR {matches(f'trim({n})', N.DESCRIBING)} OR (regexp_matches(trim({n}), '{N.MEASURE}') AND regexp_matches(trim({n}), '{N.MOVES}')))"


def role_sql(n: str) -> str:
    low = f"lower(trim({n}))"
    about = lambda rest: f"(len(list_filter({ROLE_SQL}, lambda v: contains(regexp_replace({rest}, '[^\\p{{L}}\\p{{N}}]', '', 'g'), lower(v)))) > 0 OR NOT regexp_matches(regexp_replace({rest}, '[^\\p{{L}}\\p{{N}}]', '', 'g'), '[a-z0-9]'))"
    at_end = f"(starts_with({low}, lower(w)) AND {about(f'substr({low}, length(w) + 1)')}) OR (ends_with({low}, lower(w)) AND {about(f'substr({low}, 1, length({low}) - length(w))')})"
    return f"({low} <> '' AND NOT contains({low}, '@') AND len(list_filter({ROLE_SQL}, lambda w: length({low}) >= length(w) AND length({low}) - length(w) <= {N.LONGEST_REST} AND ({at_end}))) > 0)"


def base_sql(n: str) -> str:
    return f"CASE WHEN regexp_matches(trim({n}), '^.+@[^@]*$') THEN trim(regexp_replace(trim({n}), '@[^@]*$', '')) ELSE trim({n}) END"


def qualifier_sql(n: str) -> str:
    return f"coalesce(trim(regexp_extract(trim({n}), '^.+@([^@]*)$', 1)), '')"


def shaped_sql(a: str, own: str) -> str:
    return f"trim({a}) <> '' AND NOT {path_sql(a)} AND NOT {descriptive_sql(a)} AND {NAME_KEY.format(a)} <> {NAME_KEY.format(own)}"


def category_sql(n: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({n}), '{p}') THEN '{c}'" for c, p in N.CATEGORIES) + " ELSE 'other' END"


def odd_names(spark, sf):
    """(id, name): names of parts as people write them: spellings, qualifiers, paths, readings and roles; and addresses of pages."""
    k, name = F.col("p_partkey"), F.col("p_name")
    role = pick(N.ROLE_WORDS, F.floor(k / 12) % len(N.ROLE_WORDS))
    shapes = [
        name, F.replace(F.upper(name), F.lit(" "), F.lit("_")), F.concat(name, F.lit(" @"), "p_brand"), F.concat(F.lit("@"), F.replace(name, F.lit(" "), F.lit("-"))), F.concat(F.lit("src/"), F.replace(name, F.lit(" "), F.lit("/")), F.lit(".ts")),
        F.concat(name, F.lit(" 排 #"), k.cast("string")), role, F.concat(F.lit("自动化"), role), F.concat(role, F.col("p_size").cast("string")), F.concat(F.lit("压缩"), name), F.concat(name, F.lit("@ ")), F.concat(F.lit("C:\\"), name),
    ]
    chosen = F.element_at(F.array(*shapes), (k % 12).cast("int") + 1)
    pages = read(spark, sf, "pages").select(F.concat(F.lit("g"), F.col("page_id").cast("string")).alias("id"), F.col("url").alias("name"))
    return read(spark, sf, "part").select(F.concat(F.lit("p"), k.cast("string")).alias("id"), chosen.alias("name")).union(pages)


ODD = f"""odd AS (SELECT 'p' || p_partkey AS id, (CASE p_partkey % 12 WHEN 0 THEN p_name WHEN 1 THEN replace(upper(p_name), ' ', '_') WHEN 2 THEN p_name || ' @' || p_brand WHEN 3 THEN '@' || replace(p_name, ' ', '-')
  WHEN 4 THEN 'src/' || replace(p_name, ' ', '/') || '.ts' WHEN 5 THEN p_name || ' 排 #' || p_partkey WHEN 6 THEN role WHEN 7 THEN '自动化' || role WHEN 8 THEN role || p_size WHEN 9 THEN '压缩' || p_name WHEN 10 THEN p_name || '@ ' ELSE 'C:\\' || p_name END) AS name
  FROM (SELECT *, ({ROLE_SQL})[CAST((p_partkey // 12) % {len(N.ROLE_WORDS)} AS INT) + 1] AS role FROM part) UNION ALL SELECT 'g' || page_id, url FROM pages)"""


@Q.add(f"""WITH {ODD}, b AS (SELECT id, name, {base_sql('name')} AS base, {qualifier_sql('name')} AS qualifier FROM odd)
SELECT id, {NAME_KEY.format('base')} AS key, CASE WHEN qualifier = '' THEN '' ELSE {NAME_KEY.format('qualifier')} END AS qualifier, CASE WHEN {path_sql('name')} THEN 'path' WHEN {role_sql('name')} THEN 'role' WHEN {descriptive_sql('name')} THEN 'descriptive' ELSE 'proper' END AS kind,
  trim(name) <> '' AND NOT {path_sql('name')} AND NOT {descriptive_sql('name')} AS alias, {category_sql('name')} AS category FROM b""")
def h12_entity_name(spark, sf):
    name = F.col("name")
    return odd_names(spark, sf).select("id", N.name_key(N.base_of(name)).alias("key"), N.qualifier_key(name).alias("qualifier"), N.name_kind(name).alias("kind"), N.alias_shaped(name).alias("alias"), N.concept_category(name).alias("category"))


@Q.add(f"""WITH RECURSIVE p AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS type, p_name || CASE WHEN p_partkey % 4 = 0 THEN '@eu' WHEN p_partkey % 4 = 1 THEN '@us' ELSE '' END AS own, p_type || ' ' || p_size || CASE WHEN p_partkey % 3 = 0 THEN '@eu' WHEN p_partkey % 3 = 1 THEN '@us' ELSE '' END AS alias FROM part),
k AS (SELECT id, type, {qualifier_sql('own')} AS q, {base_sql('own')} AS own, {qualifier_sql('alias')} AS aq, {base_sql('alias')} AS alias FROM p),
n AS (SELECT id, type || chr(1) || q || chr(1) || {NAME_KEY.format('own')} AS key FROM k UNION SELECT id, type || chr(1) || q || chr(1) || {NAME_KEY.format('alias')} FROM k WHERE q = aq),
l AS (SELECT DISTINCT a.id AS a, b.id AS b FROM n a JOIN n b ON a.key = b.key), r(id, other) AS (SELECT id, id FROM n UNION SELECT r.id, l.b FROM r JOIN l ON r.other = l.a) SELECT id, min(other) AS entity FROM r GROUP BY id""")
def j13_entity_resolution(spark, sf):
    """Parts whose names and types are written in several ways and qualified, within their brands."""
    part, k = read(spark, sf, "part"), F.col("p_partkey")
    at = lambda c, of: F.concat(c, F.when(k % of == 0, "@eu").when(k % of == 1, "@US").otherwise(""))
    own = part.select(k.cast("string").alias("id"), F.col("p_brand").alias("type"), at(F.replace("p_name", F.lit(" "), F.lit("-")), 4).alias("name"), F.lit(True).alias("own"))
    alias = part.select(k.cast("string").alias("id"), F.col("p_brand").alias("type"), at(F.concat(F.upper("p_type"), F.lit("_"), F.col("p_size").cast("string")), 3).alias("name"), F.lit(False).alias("own"))
    return G.resolve_entities(own.union(alias))


RELATIONS, KEYS = ("使用", "属于", "依赖"), ("当前状态", "定位", "代号", "版本")


def proposed(spark, sf):
    """(stored, proposals): parts of every tenth id are stored nodes, the others proposals; facts and edges come from lines of orders."""
    part, k = read(spark, sf, "part"), F.col("p_partkey")
    key = k.cast("string")
    plain = F.when(k % 97 == 0, "用户").when(k % 89 == 0, "src/a/b.ts").otherwise(F.concat(F.when(k % 3 == 0, F.replace(F.upper("p_name"), F.lit(" "), F.lit("_"))).otherwise(F.col("p_name")), F.lit("-"), (k % 5).cast("string")))
    at = F.when(k % 4 == 0, F.concat(F.lit("@"), "p_brand")).otherwise("")
    name = F.concat(plain, at)
    aliases = F.when(k % 3 == 1, F.array(F.concat("p_type", F.lit(" "), F.col("p_size").cast("string"), at), F.concat(F.lit("src/"), "p_type", F.lit(".ts")), F.upper(name)))
    sources = F.array(F.concat(F.lit("r"), (k % 1200).cast("string")))
    shape = [pick(N.NODE_TYPES, k % 6).alias("type"), name.alias("name"), aliases.alias("aliases"), F.array(F.lower("p_type")).alias("tags"), sources.alias("sources"), F.when(k % 20 == 0, "archived").when(k % 7 == 0, "disputed").otherwise("active").alias("status"), ((k % 11).cast("double") / 10).alias("confidence")]
    old = part.where("p_partkey % 10 = 0")
    new = part.where("p_partkey % 10 <> 0")
    nodes = old.select(F.concat(F.lit("n"), key).alias("id"), *shape)
    node_p = new.select(key.alias("ref"), k.alias("seq"), *shape, F.col("p_brand").alias("state"))
    idea = F.concat("p_type", F.when(k % 2 == 0, "压缩").otherwise("-规范"), (k % 40).cast("string"))
    ideas = [idea.alias("name"), F.when(k % 5 == 0, "Pattern").otherwise("?").alias("category"), F.when(k % 13 != 0, F.concat("p_type", F.lit(" of "), "p_brand")).alias("definition"), F.when(k % 3 == 1, F.array(F.concat("p_name", (k % 300).cast("string")))).alias("aliases"), sources.alias("sources"), F.lit("active").alias("status")]
    concepts = old.select(F.concat(F.lit("i"), key).alias("id"), *ideas)
    concept_p = new.select(F.concat(F.lit("i"), key).alias("ref"), k.alias("seq"), *ideas)
    of_line = ("l_orderkey", "l_linenumber", "l_partkey")  # dealt before they are grouped: hardly two rows are of one line
    line = read(spark, sf, "lineitem").repartition(*of_line).groupBy(*of_line).agg(*(F.max(c).alias(c) for c in ("l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate")))
    at_line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    facts = line.where("l_partkey % 10 = 0").select(F.concat(F.lit("f"), at_line.cast("string"), F.lit("-"), F.col("l_partkey").cast("string")).alias("id"), F.concat(F.lit("n"), F.col("l_partkey").cast("string")).alias("node"), F.lit("状态").alias("key"), F.col("l_linestatus").alias("value"), F.lit("active").alias("status"), epoch_ms(F.col("l_shipdate")).alias("valid_from_ms"), F.lit(-1).alias("seq"), F.col("l_orderkey").cast("int").alias("pos"))
    fact_p = line.where("l_partkey % 10 <> 0").select(F.col("l_partkey").cast("string").alias("ref"), at_line.cast("int").alias("pos"), pick(KEYS, F.col("l_orderkey") % 4).alias("key"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("value"), F.when(F.col("l_linenumber") == 7, F.array(F.lit("r999999"))).alias("sources"))
    edge_p = line.where("l_linenumber < 4").select(
        F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey").alias("ref"), F.col("l_orderkey").alias("seq"),
        F.col("l_partkey").cast("string").alias("from_ref"), F.col("l_suppkey").cast("string").alias("to_ref"), pick(RELATIONS, F.col("l_linenumber") % 3).alias("relation"), F.when(F.col("l_returnflag") == "R", "disputed").otherwise("active").alias("status"), epoch_ms(F.col("l_shipdate")).alias("valid_from_ms"),
        F.array(F.concat(F.lit("r"), (F.col("l_suppkey") % 1000).cast("string"))).alias("sources"))
    return P.Graph(nodes, concepts, facts, None), P.Graph(node_p, concept_p, fact_p, edge_p)


def projected(spark, sf):
    r = records(spark, sf)
    return P.Projection(*proposed(spark, sf), r.select("id", F.greatest("valid_to_ms", "valid_from_ms", "created_ms").alias("anchor_ms")), NOW)


PART_NAME = "(CASE WHEN p_partkey % 97 = 0 THEN '用户' WHEN p_partkey % 89 = 0 THEN 'src/a/b.ts' ELSE CASE WHEN p_partkey % 3 = 0 THEN replace(upper(p_name), ' ', '_') ELSE p_name END || '-' || (p_partkey % 5) END || CASE WHEN p_partkey % 4 = 0 THEN '@' || p_brand ELSE '' END)"
PART_IDEA = "(p_type || CASE WHEN p_partkey % 2 = 0 THEN '压缩' ELSE '-规范' END || (p_partkey % 40))"
LINES = "line AS (SELECT l_orderkey, l_linenumber, l_partkey, max(l_suppkey) AS l_suppkey, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus, max(l_shipdate) AS l_shipdate FROM lineitem GROUP BY 1, 2, 3)"
#: Who is who: rows (key, new, seq, id, ...) of what is stored and what is admitted, and the entity of each, by the least key in reach.
ENTITIES = "k AS (SELECT key, type, base, CASE WHEN q = '' THEN '' ELSE {q} END AS q FROM (SELECT key, type, {base} AS base, {qualifier} AS q FROM every)), n AS (SELECT key, type || chr(1) || q || chr(1) || {nk} AS spelling FROM k UNION SELECT e.key, e.type || chr(1) || k.q || chr(1) || {ak} FROM (SELECT key, type, unnest(aliases) AS alias FROM every) e JOIN k USING (key) WHERE CASE WHEN {aq} = '' THEN '' ELSE {aqk} END = k.q), l AS (SELECT DISTINCT a.key AS a, b.key AS b FROM n a JOIN n b USING (spelling)), r(key, other) AS (SELECT key, key FROM every UNION SELECT r.key, l.b FROM r JOIN l ON r.other = l.a), ent AS (SELECT key, min(other) AS entity FROM r GROUP BY key)".format(
    q=NAME_KEY.format("q"), base=base_sql("name"), qualifier=qualifier_sql("name"), nk=NAME_KEY.format("base"), ak=NAME_KEY.format(base_sql("alias")), aq=qualifier_sql("alias"), aqk=NAME_KEY.format(qualifier_sql("alias"))
)
NODE_ROWS = f"""raw AS (SELECT p_partkey AS k, {TYPE_SQL}[CAST(p_partkey % 6 AS INT) + 1] AS type, {PART_NAME} AS name, CASE WHEN p_partkey % 3 = 1 THEN [p_type || ' ' || p_size || CASE WHEN p_partkey % 4 = 0 THEN '@' || p_brand ELSE '' END] ELSE CAST([] AS VARCHAR[]) END AS aliases,
    CASE WHEN p_partkey % 3 = 1 THEN ['src/' || p_type || '.ts', upper({PART_NAME})] ELSE CAST([] AS VARCHAR[]) END AS more, lower(p_type) AS tag, 'r' || (p_partkey % 1200) AS source, CASE WHEN p_partkey % 20 = 0 THEN 'archived' WHEN p_partkey % 7 = 0 THEN 'disputed' ELSE 'active' END AS status, (p_partkey % 11)::DOUBLE / 10 AS confidence, p_brand FROM part),
faulty AS (SELECT raw.*, CASE WHEN rec.id IS NULL THEN 'sources' WHEN type = 'place' AND {path_sql('name')} THEN 'path' WHEN type IN ('person', 'organization') AND {qualifier_sql('name')} = '' AND {role_sql('name')} THEN 'role' END AS fault, anchor FROM raw LEFT JOIN (SELECT id, greatest(valid_to_ms, valid_from_ms, created_ms) AS anchor FROM records) rec ON rec.id = source),
every AS (SELECT 'nn' || k AS key, 'n' || k AS id, 0 AS new, -1 AS seq, type, name, list_concat(aliases, more) AS aliases, [tag] AS tags, source, status, confidence FROM raw WHERE k % 10 = 0
  UNION ALL SELECT 'p' || k, 'new-' || k, 1, k, type, name, list_filter(aliases, lambda a: {shaped_sql('a', 'name')}), CASE WHEN type = 'tool' AND {path_sql('name')} THEN [tag, '路径'] ELSE [tag] END, source, status, confidence FROM faulty WHERE k % 10 <> 0 AND fault IS NULL)"""
#: Each row with its entity's id and name. A stored row comes before proposals, and of several the least by its key.
MEMBERS = "m AS (SELECT every.*, entity, first_value(id) OVER w AS own_id, first_value(name) OVER w AS own FROM every JOIN ent USING (key) WINDOW w AS (PARTITION BY entity ORDER BY new, CASE WHEN new = 0 THEN key END, seq, key ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
TEXT_LIST = "coalesce(array_to_string(list(value ORDER BY o), ','), '')"


def folded_list(name: str, rows: str, keep: str, most: int) -> str:
    """A list of each entity: each value once, at its first (min) or last (max) place, and the first or the latest ones."""
    down = " DESC" if keep == "max" else ""
    return f"{name} AS (SELECT own_id, array_to_string(list(value ORDER BY o), ',') AS list FROM (SELECT *, row_number() OVER (PARTITION BY own_id ORDER BY o{down}) AS place FROM (SELECT own_id, value, {keep}(o) AS o FROM ({rows}) GROUP BY 1, 2)) WHERE place <= {most} GROUP BY own_id)"


FACT_ROWS = f"""fact_p AS (SELECT CAST(l_partkey AS VARCHAR) AS ref, l_orderkey * 8 + l_linenumber AS pos, (['当前状态', '定位', '代号', '版本'])[CAST(l_orderkey % 4 AS INT) + 1] AS key, l_returnflag || l_linenumber AS value, l_linenumber = 7 AS bad FROM line WHERE l_partkey % 10 <> 0
  UNION ALL SELECT CAST(k AS VARCHAR), -1, '状态', p_brand, false FROM raw WHERE k % 10 <> 0),
fact_all AS (SELECT ref || '/' || pos AS id, own_id AS node, {SYNONYM_SQL.format('f.key')} AS key, value, status, anchor AS valid_from_ms, m.confidence, m.source, m.seq, pos FROM fact_p f JOIN m ON m.key = 'p' || ref JOIN (SELECT k, anchor FROM faulty) a ON a.k = m.seq WHERE NOT bad
  UNION ALL SELECT 'f' || (l_orderkey * 8 + l_linenumber) || '-' || l_partkey, coalesce(own_id, 'n' || l_partkey), '状态', l_linestatus, 'active', epoch_us(l_shipdate) // 1000, NULL, NULL, -1, l_orderkey FROM line LEFT JOIN m ON m.id = 'n' || l_partkey WHERE l_partkey % 10 = 0),
fact_done AS (SELECT id, node, key, value, CASE WHEN status = 'active' AND nxt IS NOT NULL THEN 'superseded' ELSE status END AS status, valid_from_ms, CASE WHEN status = 'active' AND nxt IS NOT NULL THEN nf END AS valid_to_ms, confidence, source, seq, pos
  FROM (SELECT *, CASE WHEN has_new THEN lead(id) OVER w END AS nxt, lead(valid_from_ms) OVER w AS nf FROM (SELECT *, bool_or(seq >= 0) OVER (PARTITION BY node, key) AS has_new FROM fact_all) WINDOW w AS (PARTITION BY node, key ORDER BY seq, pos, id)))"""


@Q.add(f"""WITH RECURSIVE {RECORDS}, {LINES}, {NODE_ROWS}, {ENTITIES}, {MEMBERS}, {FACT_ROWS},
{folded_list('al', f"SELECT own_id, value, o FROM (SELECT own_id, own, name AS value, (0, new, seq, key, -1) AS o FROM m UNION ALL SELECT own_id, own, aliases[i], (1, new, seq, key, i) FROM m, range(1, 4) x(i) WHERE i <= len(aliases)) WHERE {NAME_KEY.format('value')} <> {NAME_KEY.format('own')}", 'min', P.ALIAS_CAP)},
{folded_list('tg', "SELECT own_id, tags[i] AS value, (new, seq, key, i) AS o FROM m, range(1, 3) x(i) WHERE i <= len(tags)", 'min', 12)},
{folded_list('so', "SELECT own_id, source AS value, (new, seq, key) AS o FROM m", 'max', P.SOURCE_CAP)},
st AS (SELECT own_id, arg_max(status, (new, seq, key)) AS status, arg_max(confidence, (new, seq, key)) AS confidence, max(seq) AS seq, arg_max(status, (new, seq, key)) FILTER (status <> 'active') AS barred, any_value(own) AS name, any_value(type) AS type FROM m GROUP BY own_id),
un AS (SELECT DISTINCT node AS own_id FROM fact_done WHERE NOT list_contains({KEYS_SQL}, key))
SELECT st.own_id AS id, type, name, coalesce(al.list, '') AS aliases, tg.list || CASE WHEN un.own_id IS NULL THEN '' ELSE ',未规范' END AS tags, so.list AS sources, CASE WHEN barred = 'archived' AND status = 'active' THEN 'archived' ELSE status END AS status, confidence, CAST(seq AS BIGINT) AS seq
FROM st LEFT JOIN al USING (own_id) JOIN tg USING (own_id) JOIN so USING (own_id) LEFT JOIN un USING (own_id)""")
def j12_apply_nodes(spark, sf):
    done = projected(spark, sf).nodes
    return done.select("id", "type", "name", *(F.array_join(c, ",").alias(c) for c in ("aliases", "tags", "sources")), "status", "confidence", "seq")


@Q.add(f"""WITH RECURSIVE {RECORDS}, {LINES}, {NODE_ROWS}, {ENTITIES}, {MEMBERS}, {FACT_ROWS} SELECT id, node, key, value, status, CAST(valid_from_ms AS BIGINT) AS valid_from_ms, CAST(valid_to_ms AS BIGINT) AS valid_to_ms, confidence, coalesce(source, '') AS sources FROM fact_done""")
def j12_apply_facts(spark, sf):
    done = projected(spark, sf).facts
    return done.select("id", "node", "key", "value", "status", "valid_from_ms", "valid_to_ms", "confidence", F.coalesce(F.array_join("sources", ","), F.lit("")).alias("sources"))


@Q.add(f"""WITH RECURSIVE {RECORDS}, {LINES}, {NODE_ROWS}, {ENTITIES}, {MEMBERS},
e AS (SELECT 'new-' || l_orderkey || '/' || l_linenumber || '/' || l_partkey AS id, f.own_id AS from_id, t.own_id AS to_id, (['使用', '属于', '依赖'])[CAST(l_linenumber % 3 AS INT) + 1] AS relation, CASE WHEN l_returnflag = 'R' THEN 'disputed' ELSE 'active' END AS status, epoch_us(l_shipdate) // 1000 AS vf, 'r' || (l_suppkey % 1000) AS source, l_orderkey AS seq
  FROM line JOIN m f ON f.key = 'p' || l_partkey JOIN m t ON t.key = 'p' || l_suppkey WHERE l_linenumber < 4 AND f.own_id <> t.own_id AND 'r' || (l_suppkey % 1000) IN (SELECT id FROM records)),
c AS (SELECT *, CASE WHEN lag(to_id) OVER w = to_id THEN 0 ELSE 1 END AS ch FROM e WINDOW w AS (PARTITION BY from_id, relation ORDER BY seq, id)), i AS (SELECT *, sum(ch) OVER (PARTITION BY from_id, relation ORDER BY seq, id ROWS UNBOUNDED PRECEDING) AS run FROM c),
b AS (SELECT from_id, relation, run - 1 AS run, arg_min(vf, (seq, id)) AS next_from FROM i GROUP BY 1, 2, 3),
g AS (SELECT from_id, relation, to_id, status, CASE WHEN status = 'active' THEN run ELSE -1 END AS run, arg_min(id, (seq, id)) AS id, arg_min(vf, (seq, id)) AS vf, max(seq) AS seq, min(seq) AS first_seq FROM i GROUP BY 1, 2, 3, 4, 5),
s AS (SELECT from_id, relation, to_id, status, run, array_to_string(list(source ORDER BY o), ',') AS sources FROM (SELECT *, row_number() OVER (PARTITION BY from_id, relation, to_id, status, run ORDER BY o DESC) AS place FROM (SELECT from_id, relation, to_id, status, CASE WHEN status = 'active' THEN run ELSE -1 END AS run, source, max((seq, id)) AS o FROM i GROUP BY 1, 2, 3, 4, 5, 6)) WHERE place <= 128 GROUP BY 1, 2, 3, 4, 5)
SELECT g.id, from_id, to_id, relation, CASE WHEN status = 'active' AND next_from IS NOT NULL THEN 'superseded' ELSE status END AS status, CAST(vf AS BIGINT) AS valid_from_ms, CASE WHEN status = 'active' THEN CAST(next_from AS BIGINT) END AS valid_to_ms, sources, first_seq, seq FROM g LEFT JOIN b USING (from_id, relation, run) JOIN s USING (from_id, relation, to_id, status, run)""")
def j12_apply_edges(spark, sf):
    done = projected(spark, sf).edges
    return done.select("id", "from_id", "to_id", "relation", "status", "valid_from_ms", "valid_to_ms", F.array_join("sources", ",").alias("sources"), "first_seq", "seq")


@Q.add(f"""WITH RECURSIVE {RECORDS}, raw AS (SELECT p_partkey AS k, {PART_IDEA} AS name, CASE WHEN p_partkey % 5 = 0 THEN 'Pattern' ELSE '?' END AS stated, CASE WHEN p_partkey % 13 <> 0 THEN p_type || ' of ' || p_brand END AS definition, CASE WHEN p_partkey % 3 = 1 THEN [p_name || (p_partkey % 300)] ELSE CAST([] AS VARCHAR[]) END AS aliases, 'r' || (p_partkey % 1200) AS source FROM part),
every AS (SELECT 'ni' || k AS key, 'i' || k AS id, 0 AS new, -1 AS seq, '' AS type, name, stated AS category, definition, aliases, source FROM raw WHERE k % 10 = 0
  UNION ALL SELECT 'pi' || k, 'new-i' || k, 1, k, '', name, CASE WHEN stated = 'Pattern' THEN 'pattern' ELSE {category_sql('name')} END, definition, aliases, source FROM raw WHERE k % 10 <> 0 AND definition IS NOT NULL AND source IN (SELECT id FROM records)), {ENTITIES}, {MEMBERS},
{folded_list('al', f"SELECT own_id, value, o FROM (SELECT own_id, own, name AS value, (0, new, seq, key) AS o FROM m UNION ALL SELECT own_id, own, aliases[1], (1, new, seq, key) FROM m WHERE len(aliases) > 0) WHERE {NAME_KEY.format('value')} <> {NAME_KEY.format('own')}", 'min', P.ALIAS_CAP)},
{folded_list('so', "SELECT own_id, source AS value, (new, seq, key) AS o FROM m", 'max', P.SOURCE_CAP)},
st AS (SELECT own_id, any_value(own) AS name, max((new, seq, key, definition)) AS last, max(seq) AS seq, min((new, CASE WHEN new = 0 THEN key END, seq, key, category)) AS first FROM m GROUP BY own_id)
SELECT own_id AS id, name, first[5] AS category, last[4] AS definition, coalesce(al.list, '') AS aliases, so.list AS sources, CAST(seq AS BIGINT) AS seq FROM st LEFT JOIN al USING (own_id) JOIN so USING (own_id)""")
def j12_apply_concepts(spark, sf):
    done = projected(spark, sf).concepts
    return done.select("id", "name", "category", "definition", F.array_join("aliases", ",").alias("aliases"), F.array_join("sources", ",").alias("sources"), "seq")


def stock(spark, sf):
    """A stored graph to sweep: parts with role names, paths, odd aliases and keys; facts are lines of orders."""
    part, k = read(spark, sf, "part"), F.col("p_partkey")
    role = pick(N.ROLE_WORDS, F.floor(k / 6) % len(N.ROLE_WORDS))
    type_ = pick(N.NODE_TYPES, k % 6)
    path = F.concat(F.lit("E:/data/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.when(k % 3 == 0, ".md").otherwise(""))
    name = F.when(type_.isin("person", "organization") & (k % 2 == 0), role).when((type_ == "place") & (k % 4 == 0), path).otherwise(F.concat("p_name", (k % 50).cast("string")))
    aliases = F.array(F.concat("p_type", F.lit(" x")), F.concat("p_type", F.lit(" 下降")), F.concat(F.lit("./"), "p_name"), F.upper(name))
    status = F.when(k % 23 == 0, "archived").when(k % 7 == 0, "disputed").otherwise("active")
    nodes = part.select(F.concat(F.lit("p"), k.cast("string")).alias("id"), name.alias("name"), type_.alias("type"), aliases.alias("aliases"), F.array(F.lower("p_type")).alias("tags"), F.lit("").alias("state"), status.alias("status"), F.concat(F.lit("f"), (k % 2).cast("string")).alias("family"))
    line = read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.max("l_returnflag").alias("flag"), F.max("l_quantity").alias("q"))
    facts = line.select(F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("node"), F.col("l_orderkey").alias("seq"), pick(KEYS, F.col("l_linenumber") % 4).alias("key"), F.concat("flag", F.floor("q").cast("string")).alias("value"), F.when(F.col("flag") == "R", "superseded").when(F.col("flag") == "A", "disputed").otherwise("active").alias("status"))
    concepts = part.select(F.concat(F.lit("i"), k.cast("string")).alias("id"), F.concat("p_name", F.when(k % 2 == 0, "_").otherwise(" "), (k % 9).cast("string")).alias("name"), F.lower("p_type").alias("category"), aliases.alias("aliases"), status.alias("status"))
    return nodes, facts, concepts


def swept(spark, sf):
    return S.sweep(*stock(spark, sf))


STOCK = f"""stock AS (SELECT 'p' || p_partkey AS id, p_partkey AS k, CASE WHEN type IN ('person', 'organization') AND p_partkey % 2 = 0 THEN role WHEN type = 'place' AND p_partkey % 4 = 0 THEN 'E:/data/' || replace(p_name, ' ', '/') || CASE WHEN p_partkey % 3 = 0 THEN '.md' ELSE '' END ELSE p_name || (p_partkey % 50) END AS name, type, p_name, p_type,
    CASE WHEN p_partkey % 23 = 0 THEN 'archived' WHEN p_partkey % 7 = 0 THEN 'disputed' ELSE 'active' END AS status, 'f' || (p_partkey % 2) AS family FROM (SELECT *, {TYPE_SQL}[CAST(p_partkey % 6 AS INT) + 1] AS type, ({ROLE_SQL})[CAST((p_partkey // 6) % {len(N.ROLE_WORDS)} AS INT) + 1] AS role FROM part)),
fc AS (SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey AS id, 'p' || l_partkey AS node, l_orderkey AS seq, (['当前状态', '定位', '代号', '版本'])[CAST(l_linenumber % 4 AS INT) + 1] AS key, max(l_returnflag) || CAST(floor(max(l_quantity)) AS BIGINT) AS value, CASE max(l_returnflag) WHEN 'R' THEN 'superseded' WHEN 'A' THEN 'disputed' ELSE 'active' END AS status FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey),
lv AS (SELECT node AS id, count(*) AS n FROM fc WHERE status IN ('active', 'disputed') GROUP BY 1),
w AS (SELECT *, status IN ('active', 'disputed') AS seen, seen AND type IN ('person', 'organization') AND {role_sql('name')} AS role, CASE WHEN role AND coalesce(n, 0) >= 20 THEN name || '@' || family END AS wanted FROM stock LEFT JOIN lv USING (id)),
d AS (SELECT *, CASE WHEN wanted IS NULL THEN CASE WHEN role THEN 'archived' ELSE 'kept' END WHEN {NAME_KEY.format('wanted')} NOT IN (SELECT {NAME_KEY.format('name')} FROM w WHERE seen) AND row_number() OVER (PARTITION BY {NAME_KEY.format('wanted')} ORDER BY id) = 1 THEN 'qualified' ELSE 'blocked' END AS done,
  seen AND type = 'place' AND {path_sql('name')} AS is_path, regexp_extract(name, '([^/]*)$', 1) AS leaf FROM w),
o AS (SELECT *, done NOT IN ('archived', 'blocked') AND seen AS open, is_path AND NOT {path_sql('leaf')} AS moved, CASE WHEN done = 'qualified' THEN wanted WHEN is_path AND NOT {path_sql('leaf')} THEN leaf ELSE name END AS new_name FROM d),
fk AS (SELECT fc.*, coalesce(o.open, false) AND fc.status <> 'superseded' AS live, CASE WHEN coalesce(o.open, false) AND fc.status <> 'superseded' THEN {SYNONYM_SQL.format('fc.key')} ELSE fc.key END AS new_key FROM fc LEFT JOIN o ON o.id = fc.node),
st AS (SELECT node AS id, string_agg(new_key || ': ' || value, chr(10) ORDER BY seq, fk.id) AS state FROM fk WHERE status = 'active' GROUP BY node), un AS (SELECT DISTINCT node AS id FROM fk WHERE live AND NOT list_contains({KEYS_SQL}, new_key)),
done AS (SELECT o.id, new_name AS name, o.type, CASE WHEN open THEN list_filter([p_type || ' x', p_type || ' 下降', './' || p_name, upper(name)], lambda a: {shaped_sql('a', 'new_name')}) ELSE [p_type || ' x', p_type || ' 下降', './' || p_name, upper(name)] END AS aliases, lower(p_type) || CASE WHEN moved THEN ',路径' ELSE '' END || CASE WHEN open AND un.id IS NOT NULL THEN ',未规范' ELSE '' END AS tags, CASE WHEN open THEN coalesce(st.state, '') ELSE '' END AS state,
  CASE WHEN done IN ('archived', 'blocked') THEN 'archived' ELSE status END AS status, done, open, seen, moved, is_path, coalesce(n, 0) AS n, un.id IS NOT NULL AS unruled FROM o LEFT JOIN st ON st.id = o.id LEFT JOIN un ON un.id = o.id)"""


@Q.add(f"WITH {STOCK} SELECT id, name, type, array_to_string(aliases, ',') AS aliases, tags, state, status, done FROM done")
def j18_graph_sweep(spark, sf):
    rows = swept(spark, sf).nodes
    return rows.select("id", "name", "type", F.array_join("aliases", ",").alias("aliases"), F.array_join("tags", ",").alias("tags"), "state", "status", "done")


@Q.add(f"""WITH {STOCK}, cn AS (SELECT {NAME_KEY.format("(part.p_name || ' ' || (p_partkey % 9))")} AS key, lower(part.p_type) AS category, list_filter([part.p_type || ' x', part.p_type || ' 下降', './' || part.p_name, upper(stock.name)], lambda a: {shaped_sql('a', "(part.p_name || ' ' || (p_partkey % 9))")}) AS kept FROM part JOIN stock ON stock.k = p_partkey WHERE p_partkey % 23 <> 0)
SELECT unnest(['scanned', 'role_archived', 'role_qualified', 'role_blocked', 'place_renamed', 'place_stuck', 'aliases_pruned', 'states_rebuilt', 'nodes_unruled', 'archived_facts', 'archived_most_facts']) AS rule,
  unnest([count(*) FILTER (seen), count(*) FILTER (done IN ('archived', 'blocked')), count(*) FILTER (done = 'qualified'), count(*) FILTER (done = 'blocked'), count(*) FILTER (moved), count(*) FILTER (is_path AND NOT moved), coalesce(sum(4 - len(aliases)), 0), count(*) FILTER (open AND state <> ''), count(*) FILTER (open AND unruled), coalesce(sum(n) FILTER (done IN ('archived', 'blocked')), 0), coalesce(max(n) FILTER (done IN ('archived', 'blocked')), 0)])::BIGINT AS n FROM done
UNION ALL SELECT 'facts_renamed', count(*) FILTER (new_key <> key) FROM fk UNION ALL SELECT 'concept_aliases_pruned', sum(4 - len(kept))::BIGINT FROM cn UNION ALL SELECT 'concept_duplicates', sum(m - 1)::BIGINT FROM (SELECT count(*) AS m FROM cn GROUP BY key, category)""")
def j18_sweep_report(spark, sf):
    return swept(spark, sf).report


@Q.add(f"WITH {STOCK} SELECT new_key AS key, new_key <> key AS changed, count(*) AS n FROM fk GROUP BY 1, 2")
def h13_fact_keys(spark, sf):
    return swept(spark, sf).renamed.groupBy(F.col("new_key").alias("key"), F.col("renamed").alias("changed")).agg(F.count(F.lit(1)).alias("n"))
