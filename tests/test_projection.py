"""Proposals folded into a graph, against a loop over them one by one; sweeps, against rules by hand."""

import random

import pytest

from memlake.operators import projection as P
from memlake.operators import sweep as S

NOW = 1000


def split(name):
    base, _, qualifier = name.strip().rpartition("@")
    return (base.strip(), qualifier.strip().lower()) if base else (name.strip(), "")


def key(name):
    return "".join(c for c in name.lower() if c not in " _-") or name


def entities(items):
    """Which of (id, type, name, aliases), in order, are one, over any chain: {id: first id}."""
    root = {i[0]: i[0] for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    seen = {}
    for ident, type_, name, aliases in items:
        q = split(name)[1]
        for spelling in [name, *aliases]:
            if split(spelling)[1] == q:
                other = seen.setdefault((type_, q, key(split(spelling)[0])), ident)
                a, b = find(other), find(ident)
                first = min(a, b, key=[i[0] for i in items].index)
                root[a] = root[b] = first
    return {i[0]: find(i[0]) for i in items}


class Loop:
    """The stored graph, and proposals applied one after the other."""

    def __init__(self):
        self.nodes, self.facts, self.edges = {}, [], []

    def apply(self, batch):
        stored = [(f"n{i}", n["type"], n["name"], n["aliases"]) for i, n in sorted(self.nodes.items())]
        items = stored + [(f"p{p['ref']}", p["type"], p["name"], p["aliases"]) for p in batch["nodes"]]
        which, refs = entities(items), {}
        for p in batch["nodes"]:
            head = which[f"p{p['ref']}"]
            ident = head[1:] if head[0] == "n" else f"new-{head[1:]}"
            node = self.nodes.setdefault(ident, {"type": p["type"], "name": p["name"], "aliases": [], "sources": [], "status": p["status"]})
            refs[p["ref"]] = ident
            node["aliases"] += [a for a in [p["name"], *p["aliases"]] if a not in node["aliases"] and key(a) != key(node["name"])]
            node["status"] = "archived" if node["status"] == "archived" and p["status"] == "active" else p["status"]
            node["sources"] = [s for s in node["sources"] if s not in p["sources"]] + p["sources"]
            facts = ([(-1, "状态", p["state"])] if p["state"] else []) + [(f["pos"], f["key"], f["value"]) for f in batch["facts"] if f["ref"] == p["ref"]]
            for pos, k, value in facts:
                k = {"当前状态": "状态"}.get(k, k)
                for old in self.facts:
                    if old["node"] == ident and old["key"] == k and old["status"] == "active":
                        old["status"], old["to"] = "superseded", old["to"] if old["to"] is not None else p["valid_from_ms"]
                self.facts.append({"id": f"{p['ref']}/{pos}", "node": ident, "key": k, "value": value, "status": p["status"], "from": p["valid_from_ms"], "to": p["valid_to_ms"]})
        for e in batch["edges"]:
            a, b = refs.get(e["from_ref"]), refs.get(e["to_ref"])
            if not a or not b or a == b:
                continue
            for old in self.edges:
                if old["status"] == "active" and (old["a"], old["r"]) == (a, e["relation"]) and old["b"] != b:
                    old["status"], old["to"] = "superseded", old["to"] if old["to"] is not None else e["valid_from_ms"]
            same = [x for x in self.edges if (x["a"], x["b"], x["r"], x["status"]) == (a, b, e["relation"], e["status"])]
            if same:
                same[0]["sources"] = [s for s in same[0]["sources"] if s not in e["sources"]] + e["sources"]
            else:
                self.edges.append({"id": f"new-{e['ref']}", "a": a, "b": b, "r": e["relation"], "status": e["status"], "from": e["valid_from_ms"], "to": e["valid_to_ms"], "sources": list(e["sources"])})

    def told(self):
        nodes = {(i, n["type"], n["name"], frozenset(n["aliases"]), tuple(n["sources"]), n["status"]) for i, n in self.nodes.items()}
        facts = {(f["id"], f["node"], f["key"], f["value"], f["status"], f["from"], f["to"]) for f in self.facts}
        return nodes, facts, {(e["id"], e["a"], e["b"], e["r"], e["status"], e["from"], e["to"], tuple(e["sources"])) for e in self.edges}


def told(graph):
    nodes = {(r["id"], r["type"], r["name"], frozenset(r["aliases"]), tuple(r["sources"]), r["status"]) for r in graph.nodes.collect()}
    facts = {(r["id"], r["node"], r["key"], r["value"], r["status"], r["valid_from_ms"], r["valid_to_ms"]) for r in graph.facts.collect()}
    return nodes, facts, {(r["id"], r["from_id"], r["to_id"], r["relation"], r["status"], r["valid_from_ms"], r["valid_to_ms"], tuple(r["sources"])) for r in graph.edges.collect()}


def batches():
    """Each batch names the entities that are there by their stored names, and adds others; no proposal joins two stored ones."""
    draw = random.Random(12)
    status = lambda: draw.choice(["active"] * 5 + ["disputed", "archived"])
    for start in (0, 40):
        nodes, facts, edges = [], [], []
        for k in range(start, start + 40):
            n = draw.randrange(12)
            name = draw.choice([f"tool {n}", f"Tool-{n}", f"TOOL_{n}", f"tool{n}@eu", f"Tool {n}@EU"])
            nodes.append({"ref": f"{k:03d}", "seq": k, "type": draw.choice(["tool", "project"]), "name": name, "aliases": [f"old {n}" + name[name.index("@") :] if "@" in name else f"old {n}"] if draw.random() < 0.3 else [], "sources": draw.sample(["r1", "r2", "r3", "r4"], 2), "status": status(), "state": draw.choice(["", "", f"s{k}"]), "valid_from_ms": 10 * k, "valid_to_ms": draw.choice([None, 5000 + k])})
            facts += [{"ref": f"{k:03d}", "pos": p, "key": draw.choice(["当前状态", "版本", "代号"]), "value": f"v{k}/{p}", "sources": None} for p in range(draw.randrange(0, 4))]
        refs = [n["ref"] for n in nodes] + ["unknown"]
        for k in range(120):
            edges.append({"ref": f"e{start + k:03d}", "seq": 1000 * start + k, "from_ref": draw.choice(refs[:8]), "to_ref": draw.choice(refs[:14] + refs[-1:]), "relation": draw.choice(["使用", "属于"]), "status": status(), "sources": draw.sample(["r1", "r2", "r3"], 1), "valid_from_ms": 7 * k, "valid_to_ms": draw.choice([None, None, 9000])})
        yield {"nodes": nodes, "facts": facts, "edges": edges}


def frames(spark, batch):
    make = lambda name, schema, missing: spark.createDataFrame([{**missing, **row} for row in batch[name]], schema).repartition(3)
    return P.Graph(make("nodes", P.NODE_PROPOSALS, {"tags": [], "confidence": None}), None, make("facts", P.FACT_PROPOSALS, {}), make("edges", P.EDGE_PROPOSALS, {"confidence": 0.5}))


def test_batches_one_by_one_and_again(spark):
    records = spark.createDataFrame([(f"r{k}", 5) for k in range(1, 5)], "id string, anchor_ms long")
    loop, stored = Loop(), P.Graph(None, None, None, None)
    for batch in batches():
        before, proposals = stored, frames(spark, batch)
        loop.apply(batch)
        stored = P.Graph(*(None if t is None else P.checkpoint(t) for t in vars(P.Projection(stored, proposals, records, NOW).graph).values()))
        assert told(stored) == loop.told()
    some = P.Graph(stored.nodes, stored.concepts, before.facts, stored.edges)  # as left by a run that has stored all but the facts
    again = P.Projection(some, proposals, records, NOW).graph
    for name in ("nodes", "facts", "edges"):
        assert sorted(map(str, getattr(again, name).collect())) == sorted(map(str, getattr(stored, name).collect()))


def test_what_is_dropped_and_marked(spark):
    records = spark.createDataFrame([("r1", 77), ("r2", None)], "id string, anchor_ms long")
    node = lambda ref, type_, name, **more: {"ref": ref, "seq": int(ref), "type": type_, "name": name, "aliases": [], "sources": ["r1"], "state": "", "status": None, "valid_from_ms": None, "valid_to_ms": None, **more}
    batch = {
        "nodes": [
            node("1", "place", "src/a/b.ts"), node("2", "tool", "src/a/b.ts", aliases=["b", "./c", "下降 了", "SRC/A/B.ts"]), node("3", "person", "用户"), node("4", "person", "用户@ACME"), node("5", "concept", "x"), node("6", "tool", " "),
            node("7", "tool", "t", sources=["r1", "r9"]), node("8", "tool", "u", sources=[]), node("9", "tool", "long " * 60, state=" a \n b ", sources=["r2"]), node("10", None, "x"),
        ],
        "facts": [{"ref": "4", "pos": 0, "key": " 定位 ", "value": "v", "sources": ["r2"]}, {"ref": "4", "pos": 1, "key": "odd", "value": "v", "sources": None}, {"ref": "4", "pos": 2, "key": "odd", "value": " ", "sources": None}, {"ref": "4", "pos": 3, "key": "k", "value": "v", "sources": []}, {"ref": "3", "pos": 0, "key": "k", "value": "v", "sources": None}],
        "edges": [{"ref": k, "seq": 1, "from_ref": a, "to_ref": b, "relation": r, "status": "active", "sources": s, "valid_from_ms": None, "valid_to_ms": None} for k, a, b, r, s in (("ok", "2", "4", " 使用 ", ["r1"]), ("loop", "2", "2", "x", ["r1"]), ("ends", "2", "3", "x", ["r1"]), ("blank", "2", "4", " ", ["r1"]), ("none", "2", "4", "x", []))],
    }
    proposals = frames(spark, batch)
    proposals.concepts = spark.createDataFrame([("c1", 1, "压缩 算法", "?", "how", ["r1"]), ("c2", 2, "压缩-算法", "spec", "how else", ["r1"]), ("c3", 3, "no definition", None, " ", ["r1"])], "ref string, seq long, name string, category string, definition string, sources array<string>")
    done = P.Projection(P.Graph(None, None, None, None), proposals, records, NOW)
    faults = {(r["kind"], r["ref"]): r["fault"] for r in done.dropped.collect()}
    assert faults == {("node", "1"): "path", ("node", "3"): "role", ("node", "5"): "type", ("node", "6"): "name", ("node", "7"): "sources", ("node", "8"): "sources", ("node", "10"): "type", ("concept", "c3"): "definition", ("fact", "4/3"): "sources", ("edge", "loop"): "loop", ("edge", "ends"): "ends", ("edge", "blank"): "relation", ("edge", "none"): "sources"}
    nodes = {r["id"]: r for r in done.nodes.collect()}
    assert set(nodes) == {"new-2", "new-4", "new-9"} and nodes["new-2"]["aliases"] == ["b"] and nodes["new-2"]["tags"] == ["路径"] and nodes["new-4"]["tags"] == ["未规范"] and len(nodes["new-9"]["name"]) == 160
    assert {(r["id"], r["key"], r["value"], r["valid_from_ms"], tuple(r["sources"])) for r in done.facts.collect()} == {("4/0", "用途", "v", 77, ("r2",)), ("4/1", "odd", "v", 77, ("r1",)), ("9/-1", "状态", "a b", NOW, ("r2",))}
    assert [(r["from_id"], r["to_id"], r["relation"], r["valid_from_ms"]) for r in done.edges.collect()] == [("new-2", "new-4", "使用", 77)]
    assert [(r["id"], r["name"], r["category"], r["definition"]) for r in done.concepts.collect()] == [("new-c1", "压缩 算法", "algorithm", "how else")]


@pytest.fixture(scope="module")
def stock(spark):
    node = lambda ident, name, type_="person", aliases=None, tags=None, state="", status="active", family="work": (ident, name, type_, aliases, tags, state, status, family)
    nodes = [
        node("n1", "助手"), node("n2", "用户", aliases=["use/r.md"]), node("n3", "团队", "organization"), node("n4", "用户@ACME"), node("n5", "王小明"), node("n7", "维护者", "tool"), node("n8", "用户", family="home"), node("n9", "助手", status="archived"),
        node("h1", "客户"), node("h2", "客户"), node("h3", "AI", family=None), node("h4", "Agent"), node("h5", "agent@work", "tool"),
        node("p1", "E:/test/rewrite/mine-plugins", "place"), node("p2", "C:\\Users\\someone\\.acme\\memory\\", "place", tags=["t"]), node("p3", "E:/a/b.md", "place"), node("p4", "杭州", "place"),
        node("a1", "ACME", "project", ["acme harness", "E:/test/acme", "需要确认排期", "ACME"], state="状态: 旧"), node("k2", "某工具", "tool", status="disputed"),
    ]
    facts = [("f1", "a1", 1, "当前状态", "进行中", "active"), ("f2", "a1", 0, "负责人", "someone", "superseded"), ("f3", "k2", 1, "门禁状态", "已过", "disputed"), ("f4", "n1", 1, "当前状态", "x", "active"), ("f5", "c1", 1, "定位", "y", "active")]
    facts += [(f"{n}-{k}", n, k, "版本", str(k), "disputed" if k % 2 else "active") for n in ("h1", "h2", "h3", "h4") for k in range(20)]
    concepts = [("c1", "压缩 算法", "algorithm", ["./x", "压缩算法", "zip"], "active"), ("c2", "压缩-算法", "algorithm", None, "active"), ("c3", "压缩算法", "algorithm", [], "archived"), ("c4", "压缩算法", "spec", [], "disputed")]
    return (
        spark.createDataFrame(nodes, "id string, name string, type string, aliases array<string>, tags array<string>, state string, status string, family string"),
        spark.createDataFrame(facts, "id string, node string, seq long, key string, value string, status string"),
        spark.createDataFrame(concepts, "id string, name string, category string, aliases array<string>, status string"),
    )


def test_sweep_by_hand(spark, stock):
    nodes, facts, concepts = stock
    swept = S.sweep(*(t.repartition(4) for t in stock))
    got = {r["id"]: r for r in swept.nodes.collect()}
    done = {i: r["done"] for i, r in got.items() if r["done"] != "kept"}
    assert done == {"n1": "archived", "n2": "archived", "n3": "archived", "n8": "archived", "h1": "qualified", "h2": "blocked", "h3": "archived", "h4": "blocked"}
    assert {i for i, r in got.items() if r["status"] == "archived"} == {"n1", "n2", "n3", "n8", "n9", "h2", "h3", "h4"}
    names = {i: r["name"] for i, r in got.items() if r["name"] != {x["id"]: x["name"] for x in nodes.collect()}[i]}
    assert names == {"h1": "客户@work", "p1": "mine-plugins", "p2": "memory"}
    assert got["p2"]["tags"] == ["t", "路径"] and got["p3"]["tags"] == [] and got["k2"]["tags"] == ["未规范"]
    assert got["a1"]["aliases"] == ["acme harness"] and got["a1"]["state"] == "状态: 进行中" and got["n2"]["aliases"] == ["use/r.md"]
    assert {r["id"]: r["key"] for r in swept.facts.where("key <> '版本'").collect()} == {"f1": "状态", "f2": "负责人", "f3": "门禁状态", "f4": "当前状态", "f5": "用途"}
    assert {r["id"]: r["aliases"] for r in swept.concepts.collect()} == {"c1": ["zip"], "c2": [], "c3": [], "c4": []}
    report = {r["rule"]: r["n"] for r in swept.report.collect()}
    assert report == {
        "scanned": 18, "role_archived": 7, "role_qualified": 1, "role_blocked": 2, "place_renamed": 2, "place_stuck": 1, "aliases_pruned": 3, "states_rebuilt": 2, "nodes_unruled": 1, "archived_facts": 61, "archived_most_facts": 20,
        "facts_renamed": 2, "concept_aliases_pruned": 2, "concept_duplicates": 1,
    }
    assert {r["id"]: r["kept"] for r in S.concept_classes(concepts).collect()} == {"c1": "c1", "c2": "c1", "c4": "c4"}


def test_a_second_sweep_changes_nothing(spark, stock):
    first = S.sweep(*stock)
    again = S.sweep(first.nodes.drop("done"), first.facts, first.concepts)
    plain = lambda df: sorted(map(str, df.drop("done").collect()))
    for name in ("nodes", "facts", "concepts"):
        assert plain(getattr(again, name)) == plain(getattr(first, name))
    report = {r["rule"]: r["n"] for r in again.report.collect()}
    assert not any(report[k] for k in ("role_archived", "role_qualified", "role_blocked", "place_renamed", "aliases_pruned", "states_rebuilt", "facts_renamed", "concept_aliases_pruned"))


def test_empty_tables(spark, stock):
    swept = S.sweep(*(t.limit(0) for t in stock))
    assert swept.nodes.collect() == [] and all(r["n"] == 0 for r in swept.report.collect())
    done = P.Projection(P.Graph(None, None, None, None), P.Graph(None, None, None, None), spark.createDataFrame([], "id string, anchor_ms long"), NOW)
    assert done.nodes.collect() == done.concepts.collect() == done.facts.collect() == done.edges.collect() == done.dropped.collect() == []
