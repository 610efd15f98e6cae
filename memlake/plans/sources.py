"""Queries of sources, sinks and redaction."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from memlake.operators import dedupe, redaction
from memlake.operators.shared import checkpoint
from memlake.plans.registry import Queries
from memlake.sources import bundle as B
from memlake.sources import snapshots
from memlake.sources.derived import DAY, MESSAGES, NOW, RECORDS, messages, read, records

Q = Queries()


@Q.add(f"WITH {MESSAGES} SELECT id, coalesce(session_id, 'default') AS session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms, id) AS place FROM messages WHERE role IN ('user', 'assistant') AND trim(text) <> ''")
def a1_scan_messages(spark, sf):
    return B.clean_messages(messages(spark, sf)).select("id", "session_id", "place")


@Q.add("WITH l AS (SELECT 'r' || o_custkey AS id, 'f' || (o_orderkey // 1000) AS file, o_orderkey % 1000 AS seq, o_orderstatus AS status FROM orders) SELECT id, arg_max(file, (file, seq)) AS file, arg_max(seq, (file, seq)) AS seq, arg_max(status, (file, seq)) AS status FROM l GROUP BY id")
def a2_scan_fact_log(spark, sf):
    k = F.col("o_orderkey")
    return B.last_per_id(read(spark, sf, "orders").select(F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("id"), F.concat(F.lit("f"), F.floor(k / 1000).cast("string")).alias("file"), (k % 1000).alias("seq"), F.col("o_orderstatus").alias("status")))


def bundles(spark, sf):
    """A bundle for each conversation: a row for each of its turns; some have faults."""
    k = F.col("conv_id")
    text = F.replace(F.replace(F.regexp_replace("text", "[|]", "/"), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    row = F.concat_ws("|", F.lit("wf"), F.lit("2026-01-02"), F.when(F.col("turn") % 2 == 0, "2026-01-01").otherwise("2026-01-03"), F.lit("2026-01-02"), F.when(F.col("turn") % 3 == 0, "2026-01-01").otherwise("-"), F.lit("o"), F.when((k % 9 == 0) & (F.col("turn") == 1), "7").otherwise("1"), F.lit("?"), F.lit("a:b"), F.concat(text, F.lit("|end")))
    rows = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", row.alias("row")))).alias("r"), F.count(F.lit(1)).alias("n"))
    declared = F.when(k % 7 == 0, F.col("n") + 1).otherwise(F.col("n"))
    return rows.select(F.concat(F.lit("b"), k.cast("string")).alias("path"), F.concat(F.lit("#bundle v1.1\n#count="), declared.cast("string"), F.lit("\n"), F.array_join(F.transform("r", lambda x: x["row"]), "\n")).alias("text"))


BAD = "bad AS (SELECT conv_id FROM conversations GROUP BY conv_id HAVING conv_id % 7 = 0 OR (conv_id % 9 = 0 AND max(turn) >= 1) OR count(DISTINCT replace(text, '|', '/')) < count(*))"


@Q.add(f"""WITH {BAD} SELECT 'b' || conv_id AS path, turn + 2 AS seq, 'work_fact' AS type, 'a:b' AS tags, CASE WHEN turn % 2 = 0 THEN '2026-01-02' ELSE '2026-01-03' END AS updated, CASE WHEN turn % 3 = 0 THEN '2026-01-02' ELSE '-' END AS vt, md5(replace(text, '|', '/') || '|end') AS content_md5 FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM bad)""")
def a3_load_bundle(spark, sf):
    good, _ = B.load_bundle(bundles(spark, sf))
    return good.select("path", F.col("seq").cast("long").alias("seq"), "type", F.array_join("tags", ",").alias("tags"), "updated", "vt", F.md5("content").alias("content_md5"))


@Q.add("SELECT event_id AS seq, (epoch_us(ts) // 1000) AS ts_ms FROM events WHERE event_type = 'click' ORDER BY 2 DESC, 1 DESC LIMIT 100")
def a4_scan_journal_tail(spark, sf):
    from memlake.sources.derived import epoch_ms

    return B.tail(read(spark, sf, "events").select(F.col("event_id").alias("seq"), epoch_ms(F.col("ts")).alias("ts_ms"), F.col("event_type").alias("kind")), 100, "click").select("seq", "ts_ms")


QUOTED = r"""CASE WHEN regexp_matches({0}, '[",\r\n]') THEN '"' || replace({0}, '"', '""') || '"' ELSE {0} END"""


@Q.add(rf"""WITH {RECORDS}, rooms AS (SELECT 'rooms' AS kind, t AS o1, '' AS o2, t || ',' || count(*) AS line FROM (SELECT unnest(tags) AS t FROM records) GROUP BY t),
orphans AS (SELECT 'orphans' AS kind, '' AS o1, id AS o2, id || ',' || scene || ',' || {QUOTED.format('content')} AS line FROM records WHERE len(tags) = 0), tagged AS (SELECT 'tag' AS kind, '' AS o1, id AS o2, id || ',' || scene || ',' || {QUOTED.format('content')} || ',' || priority AS line FROM records WHERE list_contains(tags, 't3')),
every AS (SELECT * FROM rooms UNION ALL SELECT * FROM orphans UNION ALL SELECT * FROM tagged), k AS (SELECT kind, line, row_number() OVER (PARTITION BY kind ORDER BY o1, o2) AS place, count(*) OVER (PARTITION BY kind) > 200 AS truncated FROM every)
SELECT kind, CAST(place AS INT) AS place, md5(line) AS line_md5, truncated FROM k WHERE place <= 200""")
def a6_csv_export(spark, sf):
    """Rooms with their counts, records without a tag, and those of one tag: at most 200 lines each, and whether there are more."""
    rows = records(spark, sf)
    rooms = rows.select(F.explode("tags").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    content = [F.col("id"), F.col("scene"), F.col("content")]
    kinds = {
        "rooms": B.csv_export(rooms, [F.col("t"), F.col("n")], [F.col("t")], 200),
        "orphans": B.csv_export(rows.where(F.size("tags") == 0), content, [F.col("id")], 200),
        "tag": B.csv_export(rows.where(F.array_contains("tags", "t3")), [*content, F.col("priority")], [F.col("id")], 200),
    }
    parts = [lines.select(F.lit(kind).alias("kind"), "place", F.md5("line").alias("line_md5"), "truncated") for kind, lines in kinds.items()]
    return parts[0].union(parts[1]).union(parts[2])


@Q.add(f"""WITH {RECORDS} SELECT type || '/' || id || '.md' || CASE WHEN retired_reason IS NOT NULL THEN '.disabled' ELSE '' END AS rel_path, md5('---' || chr(10) || 'type: ' || type || chr(10) || 'priority: ' || priority || chr(10) || '---' || chr(10) || content || chr(10)) AS text_md5 FROM records""")
def a7_text_projection(spark, sf):
    return B.projection(records(spark, sf)).select("rel_path", F.md5("text").alias("text_md5"))


@Q.add()
def a8_archive_redacted(spark, sf):
    """Days of messages as they would be archived: rows, findings, and whether all rows are there, before any are purged."""
    rows = messages(spark, sf)
    clean = redaction.redact(rows)
    days = rows.select("id", F.floor(F.col("ts_ms") / 86_400_000).alias("day"))
    return days.join(clean, "id", "left").groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("kinds")).alias("findings"), F.bool_and(F.col("kinds").isNotNull()).alias("whole"))


def shared_folder(spark):
    """A new folder of the shared checkpoint folder, for what a query writes and reads again."""
    checkpoint(spark.range(0))
    return f"{spark.sparkContext.getCheckpointDir()}/written-{uuid.uuid4().hex}"


@Q.add(f"""WITH {RECORDS}, {MESSAGES} SELECT 'records' AS section, count(*) AS n, sum(seq)::BIGINT AS ids, sum(length(content))::BIGINT AS chars, sum(len(tags))::BIGINT AS more FROM records UNION ALL SELECT 'messages', count(*), sum(conv_id)::BIGINT, sum(length(text))::BIGINT, count(turn) FROM messages""")
def a5_snapshot_write(spark, sf):
    """Records and messages as a snapshot that is published, found as the last one, checked and read again."""
    root = shared_folder(spark)
    snapshots.write_snapshot({"records": records(spark, sf).limit(0)}, root, "0001", "first", NOW)
    snapshots.write_snapshot({"records": records(spark, sf), "messages": messages(spark, sf)}, root, "0002", "query", NOW)
    back = snapshots.read_snapshot(spark, root)
    told = lambda section, ids, text, more: back[section].agg(F.lit(section).alias("section"), F.count(F.lit(1)).alias("n"), F.sum(ids).alias("ids"), F.sum(F.length(text)).alias("chars"), more.cast("long").alias("more"))
    return told("records", "seq", "content", F.sum(F.size("tags"))).union(told("messages", "conv_id", "text", F.count("turn")))


@Q.add(f"""WITH {RECORDS} SELECT type, md5('---' || chr(10) || 'type: ' || type || chr(10) || 'priority: ' || priority || chr(10) || '---' || chr(10) || content || chr(10)) AS text_md5 FROM records""")
def a7_text_sink(spark, sf):
    """All records' texts, written by type, published and read again."""
    root = shared_folder(spark)
    texts = B.projection(records(spark, sf))
    snapshots.write_texts(texts.select(F.substring_index("rel_path", "/", 1).alias("type"), "text"), root, "texts")
    return snapshots.read_texts(spark, root, "texts").select("type", F.md5("text").alias("text_md5"))


@Q.add(f"""WITH {MESSAGES}, m AS (SELECT *, ts_ms // 86400000 AS day, ts_ms < {NOW - 28 * DAY} AS old FROM messages) SELECT day, count(*) FILTER (old) AS archived, count(*) FILTER (NOT old) AS kept FROM m GROUP BY day""")
def a8_archive_and_purge(spark, sf):
    """Messages of the first days go to an archive, redacted, and once that is checked they are purged."""
    root, rows = shared_folder(spark), messages(spark, sf)
    snapshots.write_archive(rows, root, "archive", NOW - 28 * DAY)
    left = snapshots.purge_archived(rows, root, "archive").select(F.floor(F.col("ts_ms") / DAY).alias("day"), F.lit(0).alias("archived"))
    held = snapshots.read_archive(spark, root, "archive").select(F.col("day").cast("long").alias("day"), F.lit(1).alias("archived"))
    return held.union(left).groupBy("day").agg(F.sum("archived").alias("archived"), F.count_if(F.col("archived") == 0).alias("kept"))


@Q.add()
def a9_source_scan_report(spark, sf):
    """Verdicts by source of what bundles would bring."""
    good, errors = B.load_bundle(bundles(spark, sf))
    rows = good.select(F.concat_ws("#", "path", F.col("seq").cast("string")).alias("id"), F.xxhash64("path", "seq").alias("seq"), "content", "path")
    existing = read(spark, sf, "benchmark").select(F.concat(F.lit("e"), F.col("item_id").cast("string")).alias("id"), F.col("text").alias("content"))
    told = dedupe.import_plan(rows.select("id", "seq", "content"), existing).join(rows.select("seq", "path"), "seq")
    report = told.groupBy("path", "verdict").agg(F.count(F.lit(1)).alias("n"))
    return report.union(errors.groupBy("path").agg(F.count(F.lit(1)).alias("n")).select("path", F.lit("error"), "n"))


@Q.add("""WITH s AS (SELECT 's' || (item_id % 9) AS scenario, CASE WHEN item_id % 11 = 0 THEN NULL ELSE 'q' || item_id END AS id, CASE WHEN item_id % 4 = 0 THEN 'm1' ELSE 'm' || item_id END AS marker, text FROM benchmark), shared AS (SELECT marker FROM s GROUP BY 1 HAVING count(DISTINCT scenario) > 1)
SELECT scenario, 'missing-id' AS rule, count(*) AS n FROM s WHERE id IS NULL GROUP BY 1 UNION ALL SELECT scenario, 'marker-not-unique', count(*) FROM s WHERE marker IN (SELECT marker FROM shared) GROUP BY 1 UNION ALL SELECT scenario, 'too-short', count(*) FROM s WHERE length(text) < 150 GROUP BY 1""")
def a11_validate_scenarios(spark, sf):
    k = F.col("item_id")
    s = read(spark, sf, "benchmark").select(F.concat(F.lit("s"), (k % 9).cast("string")).alias("scenario"), F.when(k % 11 != 0, F.concat(F.lit("q"), k.cast("string"))).alias("id"), F.when(k % 4 == 0, "m1").otherwise(F.concat(F.lit("m"), k.cast("string"))).alias("marker"), "text")
    shared = s.groupBy("marker").agg(F.countDistinct("scenario").alias("n")).where("n > 1").select("marker", F.lit(True).alias("shared"))
    rules = F.array(F.when(F.col("id").isNull(), "missing-id"), F.when(F.col("shared"), "marker-not-unique"), F.when(F.length("text") < 150, "too-short"))
    return s.join(shared, "marker", "left").select("scenario", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule")).groupBy("scenario", "rule").agg(F.count(F.lit(1)).alias("n"))


@Q.add(f"""WITH {RECORDS}, t AS (SELECT id, CASE seq % 5 WHEN 0 THEN '2026-01-0' || (seq % 9 + 1) WHEN 1 THEN '2026-01-02T03:04:0' || (seq % 10) || 'Z' WHEN 2 THEN '2026-01-02 03:0' || (seq % 10) WHEN 3 THEN '-' ELSE 'soon' END AS raw FROM records)
SELECT id, CASE WHEN length(raw) >= 10 THEN epoch_ms(CAST(replace(replace(raw, 'T', ' '), 'Z', '') AS TIMESTAMP)) END AS ms, CASE WHEN raw LIKE '%Z' THEN 'exact' WHEN length(raw) = 16 THEN 'minute' WHEN length(raw) = 10 THEN 'day' ELSE 'unknown' END AS precision FROM t""")
def h11_time_parsing(spark, sf):
    k = F.col("seq")
    raw = F.when(k % 5 == 0, F.concat(F.lit("2026-01-0"), (k % 9 + 1).cast("string"))).when(k % 5 == 1, F.concat(F.lit("2026-01-02T03:04:0"), (k % 10).cast("string"), F.lit("Z"))).when(k % 5 == 2, F.concat(F.lit("2026-01-02 03:0"), (k % 10).cast("string"))).when(k % 5 == 3, "-").otherwise("soon")
    return records(spark, sf).select("id", B.parse_time(raw).alias("t")).select("id", "t.ms", "t.precision")


@Q.add()
def h14_redaction_findings(spark, sf):
    return redaction.findings(redaction.redact(read(spark, sf, "documents"), "doc_id"))


@Q.add(f"""WITH {RECORDS}, e AS (SELECT id, content FROM records), v AS (SELECT 'r' || (item_id * 9) AS id, item_id, left(CASE WHEN item_id % 2 = 0 THEN text ELSE (SELECT content FROM records WHERE seq = item_id * 9) END, 30) AS quote FROM benchmark)
SELECT v.item_id, CASE WHEN length(trim(quote)) >= 4 AND bool_or(contains(regexp_replace(e.content, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), trim(regexp_replace(quote, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))) THEN 'grounded' ELSE 'unverifiable' END AS verdict FROM v JOIN e ON v.id = e.id GROUP BY v.item_id, quote""".replace("\\\\", "\\"))
def h19_quote_grounding(spark, sf):
    from memlake.functions.columns import squeezed

    rows = records(spark, sf).select("id", "content")
    items = read(spark, sf, "benchmark").select(F.concat(F.lit("r"), (F.col("item_id") * 9).cast("string")).alias("id"), "item_id", "text").join(rows, "id")
    quote = squeezed(F.left(F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise(F.col("content")), F.lit(30)))
    held = (F.length(quote) >= 4) & F.contains(F.regexp_replace("content", r"[ \t\n\x0B\f\r]+", " "), quote)
    return items.groupBy("item_id").agg(F.bool_or(held).alias("g")).select("item_id", F.when(F.col("g"), "grounded").otherwise("unverifiable").alias("verdict"))
