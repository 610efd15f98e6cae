import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from memlake.llm import mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def poured(sizes, weights=(3, 1, 2), budget=1.5, cap=2.0):
    """Share by weight, cap, share again what is left, until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, total = {}, budget * sum(sizes.values())
    while True:
        left = total - sum(full.values())
        w = sum(weight[s] for s in names if s not in full)
        share = {s: left * weight[s] / w for s in names if s not in full} if w else {}
        over = [s for s in share if share[s] >= cap * sizes[s]]
        if not over:
            return {**full, **share}
        full |= {s: cap * sizes[s] for s in over}


def corpus():
    rows = [(k, "w " * (k % 7), "en", f"s{k % 4}") for k in range(200)]
    rows += [(900 + k, "x\x0by " * 40, "en", "big") for k in range(30)]
    rows += [(1000, None, "en", "s0"), (1001, "a b", "en", None), (None, "a b c", "en", "s1"), (None, "a b c", "en", "s1"), (7, "w " * 3, "en", "s9"), (1002, "", "en", "empty"), (1003, "long " * 50_000, "en", "big"), (1004, "é\x1cü", "en", "Ä")]
    return rows


def test_mix_against_brute_force(documents):
    rows = corpus()
    got = mixing.mix(documents(rows).withColumnsRenamed({"lang": "size", "n_chars": "target"})).collect()
    size = [len(WORD.findall(t or "")) for _, t, *_ in rows]
    by_source = defaultdict(int)
    for n, r in zip(size, rows, strict=True):
        by_source[r[3]] += n
    target = poured(by_source)
    expected = Counter()
    for source in by_source:
        rate = target[source] / by_source[source] if by_source[source] else 0.0
        own = [(n, r, int(hashlib.md5(f"{'null' if r[0] is None else r[0]}:17".encode()).hexdigest()[:13], 16) / 2**52) for n, r in zip(size, rows, strict=True) if r[3] == source]
        tries = []
        for turn in range(64):
            copies = [math.floor(rate) + ((u + turn * mixing.STEP) % 1.0 < rate - math.floor(rate)) for *_, u in own]
            tries.append((round(abs(sum(c * n for c, (n, *_) in zip(copies, own, strict=True)) - target[source]), 6), turn, copies))
        for c, (n, r, _) in zip(min(tries)[2], own, strict=True):
            expected[r[0], n, by_source[source], round(target[source], 6), c] += 1
    assert Counter((g["doc_id"], g["size"], g["source_size"], round(g["target"], 6), g["copies"]) for g in got) == expected
    assert all(g["copies"] <= 2 for g in got) and abs(sum(target.values()) - 1.5 * sum(size)) < 1e-6 * sum(size)


def test_mixed_documents_follow_the_mix(documents):
    docs = documents(corpus()).withColumnRenamed("lang", "_rate")
    copies = Counter()
    for g in mixing.mix(docs).collect():
        copies[g["doc_id"]] += g["copies"]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({k: n for k, n in copies.items() if n})


def test_words_taken_come_near_the_targets(documents):
    draw = random.Random(3)
    rows = [(k, "w " * int(draw.paretovariate(1.1) * 20), "en", f"s{k % 7}" if k % 3 else "hot") for k in range(2500)]
    taken, target = defaultdict(int), {}
    ids = {k: s for k, _, _, s in rows}
    for g in mixing.mix(documents(rows)).collect():
        taken[ids[g["doc_id"]]] += g["size"] * g["copies"]
        target[ids[g["doc_id"]]] = g["target"]
    assert max(abs(taken[s] / target[s] - 1) for s in target) < 0.01


def test_mix_of_nothing(documents):
    assert mixing.mix(documents([])).collect() == [] and mixing.mixed_documents(documents([])).collect() == []
    assert [r["copies"] for r in mixing.mix(documents([(1, "", "en", "a"), (2, None, "en", None)])).collect()] == [0, 0]


def bid(key, shard, weight):
    h = xxhash.xxh64_intdigest(f"{key}@{shard}".encode(), seed=42)
    return -math.log(((h >> 11) + 0.5) / 2**53) / weight


@pytest.mark.parametrize("weights", [None, [1.0, 3.0, 0.5, 1.0, 2.0]])
def test_shards_against_brute_force(documents, weights):
    rows = corpus()
    shards = 4
    docs = documents(rows).withColumnsRenamed({"lang": "shard", "source": "slot", "n_chars": "split"})
    got = sharding.assign_shards(docs.repartition(5), shards=shards, weights=weights).collect()
    w = weights or [1.0] * (shards + 1)
    expected = Counter()
    for i, text, *_ in rows:
        key, raw = "null" if i is None else str(i), (text or "").encode()
        before = min(range(shards), key=lambda s: (bid(key, s, w[s]), s))
        after = min(range(shards + 1), key=lambda s: (bid(key, s, w[s]), s))
        expected[i, len(raw) + 8, zlib.crc32(raw), before, after] += 1
    assert Counter((g["doc_id"], g["size"], g["text_crc32"], g["shard"], g["grown_shard"]) for g in got) == expected
    assert all(g["grown_shard"] in (g["shard"], shards) for g in got)
    for s in range(shards):
        slots = sorted(g["slot"] for g in got if g["shard"] == s)
        assert slots == list(range(len(slots)))


def test_one_key_with_many_rows(documents):
    got = sharding.assign_shards(documents([(5, "same")] * 500).repartition(7)).collect()
    assert len({g["shard"] for g in got}) == 1 and sorted(g["slot"] for g in got) == list(range(500))


def test_shards_of_nothing(documents):
    assert sharding.assign_shards(documents([])).collect() == []
    with pytest.raises(ValueError):
        sharding.assign_shards(documents([]), shards=3, weights=[1.0, 1.0])
