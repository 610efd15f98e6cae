"""Nested results: what is read, what isn't, and the table of recall by hand."""

import json

from memlake.operators import evaluation as E
from memlake.operators import joins
from memlake.sources import runs as R


def test_files_that_can_and_cannot_be_read(spark, tmp_path):
    probe = {"id": "p", "type": "update", "q": "what", "gold": ["a", None, "b"], "hit": True, "recall": {"lines": ["x a", None]}, "extra": {"deep": [1]}}
    good = {"arm": "A", "scenarios": [{"id": "s", "kind": "dialog", "probes": [probe, {"id": "bare"}]}, {"id": "w", "kind": "workflow", "probes": [probe], "checks": [{"name": "builds", "ok": True}, {"name": "runs"}]}, {"id": "none"}]}
    texts = {"run/rep-1": json.dumps(good, indent=1), "run/rep-2": json.dumps(good)[:-5], "run/rep-3": " \n", "run/rep-4": "[1, 2]", "run/rep-5": "{}", "run/rep-6": '{"scenarios": 5}', "run/rep-7": "not json", "other/rep-10": '{"arm": "B", "scenarios": null}'}
    for name, text in texts.items():
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "result.json").write_text(text)
    (tmp_path / "stray").mkdir()
    (tmp_path / "stray" / "result.json").write_text("{}")
    (tmp_path / "run" / "rep-1" / "notes.json").write_text("{}")
    expected = spark.createDataFrame([("run", "rep-1"), ("run", "rep-2"), ("run", "rep-9"), ("run", "rep-9")], "run string, rep string")
    runs, faults = R.scan_runs(R.run_files(spark, str(tmp_path)), expected)
    assert {(r["run"], r["rep"], r["arm"], len(r["scenarios"])) for r in runs.collect()} == {("run", "rep-1", "A", 3), ("run", "rep-5", "A", 0), ("other", "rep-10", "B", 0)}
    told = sorted((r["run"].rsplit("/", 2)[-2] if "/" in r["run"] else r["run"], r["rep"], r["fault"]) for r in faults.collect())
    assert told == [("run", "rep-2", "damaged"), ("run", "rep-3", "empty"), ("run", "rep-4", "damaged"), ("run", "rep-6", "damaged"), ("run", "rep-7", "damaged"), ("run", "rep-9", "missing"), ("stray", "", "unnamed")]
    rows = sorted((r["probe_id"], r["type"], r["q"], r["gold"], r["lines"], r["hit"], r["tools"]) for r in R.probes(runs).collect())
    assert rows == [("run/rep-1/0/0", "update", "what", ["a", "b"], ["x a"], True, 0), ("run/rep-1/0/1", None, None, [], [], None, 0)]
    assert sorted((r["name"], r["ok"]) for r in R.checks(runs).collect()) == [("builds", True), ("runs", False)]
    assert [tuple(r) for r in E.check_table(R.checks(runs)).orderBy("name").collect()] == [("A", "builds", 1, 1), ("A", "runs", 0, 1)]


def test_recall_table_by_hand(spark):
    """Weak hits go if a stronger one is there, stay if they are few, and are none if they are many."""
    strong = [(f"s{k}", f"zebra quagga stripes number{k}") for k in range(3)]
    common = [(f"c{k:02d}", f"common words everywhere filler{k} " + "pad " * 3) for k in range(60)]
    records = spark.createDataFrame([*strong, *common], "id string, content string")
    probes = [
        ("p1", "a", "zebra quagga", ["stripes number0", "stripes number2", "nowhere"]),  # three hits, ranks by id
        ("p2", "a", "number1", ["stripes number1"]),
        ("p3", "a", "common", ["filler0", "filler59"]),  # 60 weak hits: more than five, so none
        ("p4", "b", "missing", ["anything"]),
        ("p5", "b", "zebra", []),  # asks for nothing
        ("p6", None, "quagga number2", ["number2", "number0"]),
    ]
    frame = spark.createDataFrame(probes, "probe_id string, type string, q string, gold array<string>")
    got = {r["type"]: tuple(r)[1:] for r in E.recall_table(frame, records).collect()}
    p1 = (2 / 3, 1.0)
    assert got["a"] == (3, 2, round(2 / 3, 6), round((p1[0] + 1 + 0) / 3, 6), round((p1[1] + 1 + 0) / 3, 6))
    assert got["b"] == (1, 0, 0.0, 0.0, 0.0) and got["none"] == (1, 1, 1.0, 1.0, 1.0)
    assert got["all"] == (5, 3, 0.6, round((p1[0] + 1 + 1) / 5, 6), round(3 / 5, 6))
    assert E.recall_table(frame.limit(0), records).collect() == []


def test_runs_are_compared_by_rule(spark):
    make = lambda rows: spark.createDataFrame([(t, h) for t, hits, n in rows for h in [True] * hits + [False] * (n - hits)], "type string, hit boolean")
    old = make([("a", 5, 10), ("b", 5, 10)])
    cases = {
        "better": make([("a", 8, 10), ("b", 5, 10)]), "noise": make([("a", 5, 10), ("b", 6, 10)]), "worse": make([("a", 2, 10), ("b", 5, 10)]), "fell": make([("a", 10, 10), ("b", 4, 10)]),
        "lacking": make([("a", 10, 10)]), "nothing": make([]),
    }
    said = {name: {r["type"]: tuple(r)[1:] for r in E.compare_report(old, new, "x", "x").collect()} for name, new in cases.items()}
    assert {name: rows["all"][-1] for name, rows in said.items()} == {"better": "better", "noise": "noise", "worse": "worse", "fell": "noise", "lacking": "noise", "nothing": "worse"}
    assert said["better"]["a"] == (5, 10, 8, 10, 0.3, None) and said["lacking"]["b"] == (5, 10, 0, 0, -0.5, None)
    assert {r["verdict"] for r in E.compare_report(old, cases["better"], "x", "y").where("type = 'all'").collect()} == {"environment"}
    text = lambda **env: (f"/r/rep-{len(env)}/result.json", json.dumps({"environment": env}))
    keys = [r["env_key"] for r in R.scan_runs(spark.createDataFrame([text(), text(model="m"), text(model="m", extMode="on", extDrivers=2), text(model="m", provider="p", scenarioFiles=["a", "b"], extSnapshot="s")], "path string, text string"))[0].orderBy("rep").collect()]
    assert keys == ["/|/||ext=off/0/", "/m|/||ext=off/0/", "/m|/||ext=on/2/", "p/m|/|a,b|ext=off/0/s"]


def test_evidence_in_either_spelling(spark):
    events = [("session-a", 1, 1, 1, "one", "user/message"), ("session-a", 2, 1, 2, "two", "tool/call"), ("session-a", 3, 1, 2, "start", "step/start"), ("session-a", 4, 1, 2, " ", "tool/result"), ("b", 1, 1, None, "bee", "assistant/message"), ("session-b", 1, 1, None, "prefixed", "user/message"), ("c", 1, 2, None, "sea", "user/message")]
    anchors = [("r1", "a", 1, None), ("r2", "session-a", 1, 2), ("r3", "b", 1, None), ("r4", "session-b", 1, None), ("r5", "session-c", 2, None), ("r6", "c", 9, None), ("r7", "d", 1, None), ("r8", " ", 1, None)]
    frame = spark.createDataFrame(anchors, "id string, session_id string, turn int, step int"), spark.createDataFrame(events, "session_id string, seq long, turn int, step int, text string, type string")
    wanted = spark.createDataFrame([(f"r{k}",) for k in range(1, 10)], "id string")
    got = {r["id"]: tuple(r)[1:] for r in joins.fetch_evidence(*frame, 200, 40_000, wanted).collect()}
    ok = lambda n, chars: (n, chars, False, None)
    assert got == {"r1": ok(2, 6), "r2": ok(1, 3), "r3": ok(1, 3), "r4": ok(1, 8), "r5": ok(1, 3), "r6": (0, 0, False, "anchor-not-found"), "r7": (0, 0, False, "session-unreadable"), "r8": (0, 0, False, "session-unreadable"), "r9": (0, 0, False, "no-anchor")}
    cut = {r["id"]: tuple(r)[1:4] for r in joins.fetch_evidence(*frame, 1, 40_000).collect()}
    assert cut["r1"] == (1, 3, True) and "r9" not in cut
