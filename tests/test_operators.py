"""Operators on small tables with edge rows: nulls, blanks, ties, single rows, empty tables."""

import random

import numpy as np
from pyspark.sql import functions as F

from memlake.functions import columns as C
from memlake.operators import analytics, dedupe, graph, joins, merges, ranking, redaction, retrieval, spans
from memlake.sources import bundle
from memlake.streaming import turns


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_validity_states(spark):
    cases = [(None, None, None, None), (None, None, 5, None), ("manual", "o", 5, None), ("merge", "o", None, None), (None, "o", 5, "evidence"), (None, "o", 5, "unknown"), (None, "o", 50, "evidence"), (None, "p", 5, "evidence"), (None, "o", 10, "evidence")]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, reason string, st string, vt long, src string")
    got = df.select("k", C.validity_state(F.col("reason"), F.col("st"), F.col("vt"), F.col("src"), F.lit(10)).alias("s")).orderBy("k").collect()
    assert [r["s"] for r in got] == ["current", "expired_suspect", "retired", "superseded", "expired", "expired_suspect", "current", "historical", "expired"]


def test_scope_and_family(spark):
    assert one(spark, C.scope_visible(F.lit("Workspace"), F.lit("a"), F.lit("a"))) is True
    assert one(spark, C.scope_visible(F.lit("workspace"), F.lit(None).cast("string"), F.lit(""))) is False
    assert one(spark, C.scope_visible(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("a"))) is True
    none = F.lit(None).cast("string")
    assert one(spark, C.resolve_family(none, F.lit("bad"), F.lit("project_rule"))) == "work"
    assert one(spark, C.resolve_family(none, none, F.lit("worked"))) == "work"
    assert one(spark, C.resolve_family(F.lit("chat"), F.lit("work"), F.lit("work_fact"))) == "chat"


def test_tokens_and_grams(spark):
    assert set(one(spark, C.tokens(F.lit("The the a-b x 漢字")))) >= {"the", "a-b", "漢字"}
    assert one(spark, C.tokens(F.lit(""))) == []
    assert one(spark, C.grams(F.lit(" Ab  c "), 3)) == ["ab ", "b c"]
    assert one(spark, C.grams(F.lit("ab"), 3)) == ["ab"] and one(spark, C.grams(F.lit("  "), 3)) == []


def test_normalisers(spark):
    tags = F.array(*map(F.lit, (" A ", "a", "b/c", "b/c/d", "bad tag", "", "x", "y")))
    assert one(spark, C.norm_tags(tags)) == ["a", "b/c", "x"]
    assert one(spark, C.norm_keywords(F.array(*map(F.lit, ("Aa", "aA", " ", "b"))))) == ["Aa", "b"]
    assert one(spark, C.norm_phrases(F.array(*map(F.lit, (" p ", "p", "q"))), 1, 2)) == ["p", "q"]
    assert one(spark, C.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    assert one(spark, C.capturable(F.lit(None).cast("string"))) is False


def test_nearest_in_window_reasons(spark):
    messages = spark.createDataFrame([("a", "s", "user", 1000), ("b", "s", "user", 900_000), ("c", "t", "user", 0), ("d", "s", "tool", 0), ("e", "s", "user", 200_000), ("f", "s", "user", -50)], "id string, session_id string, role string, ts_ms long")
    segments = spark.createDataFrame([("s", "user", 1, 0, 1500), ("s", "user", 1, 1, 1100), ("s", "user", 0, 0, 900_000), ("s", "user", 2, 0, 150_000), ("s", "user", 3, 0, 240_000)], "session_id string, role string, turn int, step int, time_ms long")
    got = {r["id"]: (r["skip"], r["turn"], r["step"]) for r in joins.nearest_in_window(messages, segments).collect()}
    assert got == {"a": (None, 1, 1), "b": ("out-of-window", None, None), "c": ("no-session", None, None), "d": ("no-role", None, None), "e": ("ambiguous-turn", None, None), "f": (None, 1, 1)}


def test_supersede_chain_stops_at_cycles(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "gone"), ("e", None), ("f", "f")], "id string, superseded_by string")
    got = {r["id"]: r["chain"] for r in joins.supersede_chain(df).collect()}
    assert got == {"a": ["b", "c"], "b": ["c", "a"], "c": ["a", "b"], "d": [], "f": []}


def test_recall_budget_first_overflow(spark):
    lines = spark.createDataFrame([("q", 1, "a" * 50), ("q", 2, "b" * 100), ("q", 3, "c"), ("r", 1, "d" * 95), ("r", 2, "e" * 20)], "query_id string, rank int, line string")
    got = {(r["query_id"], r["rank"]): r["line"] for r in ranking.recall_budget(lines, 500, 100, "~").collect()}
    assert got == {("q", 1): "a" * 50, ("q", 2): "b" * 48 + "~", ("r", 1): "d" * 95}


def test_char_chunks(spark):
    messages = spark.createDataFrame([("s", k, str(k), "x" * n) for k, n in enumerate((40, 50, 100, 1, 1))], "session_id string, ts_ms int, id string, text string")
    got = {r["id"]: r["chunk"] for r in ranking.char_chunks(messages, 100, 0).collect()}
    assert got == {"0": 0, "1": 0, "2": 1, "3": 2, "4": 2}


def test_unique_names(spark):
    stems = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "a"), ("4", ""), ("5", "a-2")], "id string, stem string")
    taken = spark.createDataFrame([("a",)], "name string")
    names = [r["name"] for r in ranking.unique_names(stems, taken).collect()]
    assert len(names) == len(set(names)) == 5 and "a" not in names and "mem-4" in names


def test_turn_brackets_and_streams_agree(spark):
    draw = random.Random(4)
    kinds = ["turn/start", "turn/end", "user/message", "assistant/message", "compaction"]
    data = []
    for k in range(300):
        kind = draw.choice(kinds)
        data.append((f"s{draw.randrange(4)}", k, kind, draw.randrange(5) if kind.startswith("turn") else None, f"p{k}"))
    events = spark.createDataFrame(data, "session_id string, seq long, type string, turn int, payload string")
    state, expected = {}, []
    for s, k, kind, turn, p in data:
        if kind == "turn/start":
            state[s] = (turn, [])
        elif kind == "turn/end" and s in state:
            steps = [sum(m[1] == "assistant/message" for m in state[s][1][: n + 1]) for n in range(len(state[s][1]))]
            expected += [(s, state[s][0], *m, step) for m, step in zip(state[s][1], steps, strict=True)]
            del state[s]
        elif kind.endswith("/message") and s in state:
            state[s][1].append((k, kind, p))
    assert rows(turns.assembled(events)) == sorted(expected, key=str)
    open_, brackets = {}, {}
    for s, k, kind, turn, _ in data:
        if kind == "turn/start":
            open_[s, turn] = k
        elif kind == "turn/end" and (s, turn) in open_:
            brackets[s, turn] = (open_.pop((s, turn)), k)
    want = [(s, t, *b) for (s, t), b in brackets.items() if t > 1 and t in sorted({u for v, u in brackets if v == s and u > 1})[-2:]]
    assert rows(ranking.turn_brackets(events, 1)) == sorted(want, key=str)


def test_streaming_turns_equal_their_twin(spark, tmp_path):
    events = spark.createDataFrame([("s", 0, "turn/start", 1, None), ("s", 1, "user/message", None, "a"), ("s", 3, "turn/end", 1, None), ("t", 4, "turn/end", 1, None), ("t", 5, "user/message", None, "b"), ("s", 6, "turn/start", 2, None), ("s", 7, "user/message", None, "c")], "session_id string, seq long, type string, turn int, payload string")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    assert rows(turns.run_to_table(turns.assemble_turns(stream))) == rows(turns.assembled(events)) == [("s", 1, 1, "user/message", "a", 0)]


def test_warmup_and_backoff(spark):
    messages = spark.createDataFrame([("s", k, f"{k:02d}") for k in range(20)], "session_id string, ts_ms int, id string")
    sizes = turns.warmup_flush(messages).groupBy("flush").count().orderBy("flush").collect()
    assert [r["count"] for r in sizes] == [1, 2, 4, 6, 6, 1]
    jobs = spark.createDataFrame([("a", 0, 0), ("b", 3, 0), ("c", 30, 0)], "id string, fails int, failed_ms long")
    assert rows(turns.next_attempts(jobs)) == [("a", 60_000, "retry"), ("b", 240_000, "retry"), ("c", 1_800_000, "dead")]


def test_bm25_and_fusion(spark):
    docs = spark.createDataFrame([("a", "red fox"), ("b", "red red dog"), ("c", None), ("d", "")], "id string, content string")
    queries = spark.createDataFrame([("q", "red fox"), ("none", "zebra"), ("blank", None)], "query_id string, query string")
    hits = retrieval.bm25(queries, docs, 5)
    assert [r["id"] for r in hits.orderBy("rank").collect()] == ["a", "b"]
    lane = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, id string, rank int")
    other = spark.createDataFrame([("q", "b", 1)], "query_id string, id string, rank int")
    fused = retrieval.fuse({"x": lane, "y": other}, 5).orderBy("rank").collect()
    assert [(r["id"], r["lanes"]) for r in fused] == [("b", "x,y"), ("a", "x")] and fused[1]["score"] == 0.5
    assert retrieval.fuse({"x": lane}, 5, wired=2).agg(F.max("score")).first()[0] == 0.5
    assert retrieval.threshold(fused_hits(spark), 0.9, 2).count() == 2


def fused_hits(spark):
    return spark.createDataFrame([("q", "a", 0.1), ("q", "b", 0.2), ("r", "a", 0.1), ("r", "b", 0.2), ("r", "c", 0.3)], "query_id string, id string, score double")


def test_vector_search_is_exact(spark):
    draw = np.random.default_rng(0)
    x = draw.standard_normal((200, 8)).astype(np.float32)
    data = [(f"v{k}", [float(t) for t in v]) for k, v in enumerate(x)] + [("zero", [0.0] * 8), ("none", None), ("nan", [float("nan")] * 8), ("short", [1.0])]
    vectors = spark.createDataFrame(data, "id string, embedding array<float>")
    queries = vectors.where("id in ('v0', 'v7')").select(F.col("id").alias("query_id"), "embedding")
    got = {(r["query_id"], r["rank"]): r["id"] for r in retrieval.vector_search(queries, vectors, 5).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    for q in (0, 7):
        assert [got[f"v{q}", r + 1] for r in range(5)] == [f"v{k}" for k in np.argsort(-(u @ u[q]))[:5]]


def test_exact_dedupe(spark):
    items = spark.createDataFrame([("a", 1, "ＡＢ  c", 1, [1]), ("b", 2, "AB c", 9, [2, 1]), ("c", 3, "  ", 0, [3]), ("d", 4, " ", 0, None), ("e", 5, None, 5, [5])], "id string, seq int, content string, priority int, timestamps array<long>")
    got = {r["id"]: (r["representative"], r["members"], r["max_priority"]) for r in dedupe.exact_dedupe(items).collect()}
    assert got == {"a": ("a", 2, 9), "b": ("a", 2, 9), "c": ("c", 1, 0), "d": ("d", 1, 0), "e": ("e", 1, 5)}


def test_leaders(spark):
    items = spark.createDataFrame([("a", 1, "b", "f", "t", [1.0, 0.0]), ("b", 2, "b", "f", "t", [1.0, 0.1]), ("c", 3, "b", "f", "t", [0.0, 1.0]), ("d", 4, "b", "f", "u", [1.0, 0.0]), ("e", 5, "b", "f", "t", None), ("z", 6, "b", "f", "t", [0.0, 0.0])], "id string, seq int, batch string, family string, type string, embedding array<float>")
    assert dict(rows(dedupe.leader_clusters(items))) == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e", "z": "z"}


def test_route_health_equals_the_loop(spark):
    draw = random.Random(1)
    calls = [("p", "m", k, k, draw.randrange(1, 99), float(draw.randrange(1, 500))) for k in range(12)]
    ema = None
    for *_, latency in calls:
        ema = latency if ema is None else 0.7 * ema + 0.3 * latency
    got = analytics.route_health(spark.createDataFrame(calls, "provider string, model string, ts_ms long, n int, chunk_chars int, latency_ms double"), 100, 10).first()
    assert abs(got["latency_ema"] - ema) < 1e-9 and got["stale"] and got["good_chunk"] == min(c[4] for c in calls)


def test_retire_is_idempotent(spark):
    records = spark.createDataFrame([("a", None), ("b", "merge"), ("c", "manual")], "id string, retired_reason string")
    changes = spark.createDataFrame([("a", "retire", "manual"), ("b", "retire", "manual"), ("c", "restore", None)], "id string, action string, reason string")
    once = merges.retire(records, changes)
    assert rows(once) == rows(merges.retire(once, changes)) == [("a", "manual"), ("b", "merge"), ("c", None)]
    assert merges.snapshot_manifest("x", records).collect() == merges.snapshot_manifest("x", records.orderBy(F.desc("id"))).collect()


def test_edge_history_islands(spark):
    edges = spark.createDataFrame([("f", "r", t, k, k * 10) for k, t in enumerate("aabba")], "from_id string, relation string, to_id string, seq int, valid_from_ms int")
    got = [(r["to_id"], r["n"], r["status"], r["valid_to_ms"]) for r in graph.edge_history(edges).orderBy("first_seq").collect()]
    assert got == [("a", 2, "superseded", 20), ("b", 2, "superseded", 40), ("a", 1, "active", None)]


def test_entities_are_transitive(spark):
    names = spark.createDataFrame([("1", "t", "A"), ("2", "t", " a "), ("2", "t", "b"), ("3", "t", "B"), ("4", "u", "b"), ("5", "t", "")], "id string, type string, name string")
    assert dict(rows(graph.resolve_entities(names))) == {"1": "1", "2": "1", "3": "1", "4": "4"}


def test_affix_pairs_against_all_pairs(spark):
    draw = random.Random(2)
    keys = sorted({"".join(draw.choice("ab") for _ in range(draw.randrange(3, 10))) for _ in range(120)})
    got = rows(analytics.affix_pairs(spark.createDataFrame([(k,) for k in keys], "name string")))
    want = [(a, b) for a in keys for b in keys if len(a) >= 4 and len(a) < len(b) <= 2 * len(a) and (b.startswith(a) or b.endswith(a))]
    assert got == sorted(want, key=str)


def test_bundle_faults(spark):
    good = "#bundle v1.1\n#count=2\nwf|2|1|3|2|o|1|?|a:b|text|with pipe\\nand line\nwf|1|1|-|-|p|0|1||other"
    files = spark.createDataFrame([("good", good), ("flag", good.replace("|0|1|", "|9|1|")), ("count", good.replace("=2", "=3")), ("none", "x"), ("short", good.replace("|other", "|o"))], "path string, text string")
    records, errors = bundle.load_bundle(files)
    got = records.orderBy("seq").collect()
    assert [(r["path"], r["content"], r["updated"], r["vt"]) for r in got] == [("good", "text|with pipe\nand line", "2", "3"), ("good", "other", "1", "-")]
    assert {(r["path"], r["fault"]) for r in errors.collect()} == {("flag", "flag"), ("count", "header"), ("none", "header"), ("none", "columns"), ("short", "short")}


def test_redaction_kinds(spark):
    text = "mail a.b@example.com tel +49 (170) 123-4567 on 2026-01-02\napi_key = 'zzz1234'\npassword: ${SECRET}\nAuthorization: Bearer abc\nid 123e4567-e89b-12d3-a456-426614174000 https://u:pw@h/x"
    got = redaction.redact(spark.createDataFrame([("a", text), ("b", None), ("c", "plain")], "id string, text string"))
    by_id = {r["id"]: r for r in got.collect()}
    assert sorted(by_id["a"]["kinds"]) == ["AUTH_TOKEN", "CREDENTIAL", "CREDENTIAL", "EMAIL", "LONG_NUMBER", "OPAQUE_ID"]
    assert "2026-01-02" in by_id["a"]["text"] and "${SECRET}" in by_id["a"]["text"] and "a.b@" not in by_id["a"]["text"]
    assert by_id["b"]["text"] is None and by_id["c"]["kinds"] == []


def test_as_of_join_both_ways(spark, monkeypatch):
    records = spark.createDataFrame([("a", None, 0, None, None), ("b", None, 5, 2, 8), ("c", "manual", 0, None, None), ("d", None, 7, None, 7)], "id string, retired_reason string, created_ms long, valid_from_ms long, valid_to_ms long")
    times = spark.createDataFrame([(t,) for t in range(-1, 12)], "at long")
    few = rows(spans.as_of_join(records, times, 3))
    assert (2, "b") in few and (8, "b") not in few and not any(i in ("c", "d") for _, i in few)
    many = spark.range(-1, 10_050).select(F.col("id").alias("at"))
    wide = spans.as_of_join(records, many, 100)
    assert [r for r in rows(wide.where("at < 12"))] == few and wide.where("id = 'a'").count() == 10_050


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id string, content string")
    none = spark.createDataFrame([], "query_id string, query string")
    assert retrieval.bm25(none, empty, 5).count() == 0
    assert redaction.redact(empty, "id", "content").count() == 0
    assert graph.resolve_entities(spark.createDataFrame([], "id string, type string, name string")).count() == 0
