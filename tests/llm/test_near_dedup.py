import random

import numpy as np
import pyarrow as pa

from memlake.llm import near_dedup
from memlake.llm.components import components
from memlake.llm.words import shingles, split_words


def brute_force(rows, width=5, similarity=0.8):
    sets = []
    for i, text in rows:
        words = (text or "").lower().encode().split()
        sets.append(frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else None)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same_row = rows[a] == rows[b] and sets[a]
            if same_row or sets[a] and sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9:
                up[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i if i is not None else -1, least.get(find(k), -1)) for k, (i, _) in enumerate(rows))


def test_against_brute_force(documents):
    draw = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    bases = [[draw.choice(vocabulary) for _ in range(draw.choice([4, 30, 80, 160]))] for _ in range(12)]
    rows = []
    for n in range(220):
        words = list(draw.choice(bases))
        for _ in range(draw.randrange(0, 1 + len(words) // 12)):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        rows.append((n, " ".join(words)))
    rows += [(300, None), (301, ""), (302, " \n"), (303, "one"), (304, "One"), (305, "x " * 20000), (306, "X " * 19000), (7, rows[7][1]), (None, rows[9][1]), (None, "only here no id")]
    got = near_dedup.near_duplicates(documents(rows).withColumnsRenamed({"lang": "key", "source": "row"})).collect()
    found = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["class_id"] if r["class_id"] is not None else -1) for r in got)
    assert found == brute_force(rows)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_near_copies_whose_other_shingles_repeat(documents):
    rows = []
    for n in range(24):
        shared = [f"s{n}_{k}" for k in range(104)]
        own = [f"o{n}_{k}" for k in range([20, 12, 7][n % 3])]
        rows += [(2 * n, " ".join(shared)), (2 * n + 1, " ".join(shared + own * 500))]
    got = sorted((r["doc_id"], r["class_id"]) for r in near_dedup.near_duplicates(documents(rows)).collect())
    assert got == brute_force(rows) == [(k, k - k % 2) for k in range(48)]


def test_empty_table(documents):
    assert near_dedup.near_duplicates(documents([])).collect() == []


def test_words_and_shingles():
    texts = pa.array([" a  b\tc\x0bd\n", "", "\x1c x y ", "p q r s t u"])
    words, starts = split_words(texts)
    assert words.to_pylist() == ["a", "b", "c", "d", "\x1c", "x y", "p", "q", "r", "s", "t", "u"]
    assert starts.tolist() == [0, 4, 4, 6, 12]
    assert np.diff(shingles(texts, 5)[1]).tolist() == [1, 0, 1, 2]


def test_signatures_estimate_probability_jaccard():
    draw = np.random.default_rng(1)
    shared, own = draw.integers(0, 2**63, 60, dtype=np.uint64), draw.integers(0, 2**63, (2, 20), dtype=np.uint64)
    a, b = np.concatenate([shared, own[0]]), np.concatenate([shared, own[1]])
    w_a, w_b = draw.uniform(1, 4, 80), draw.uniform(1, 4, 80)
    size = 8192
    one, two = near_dedup.prob_minhash(np.concatenate([a, b]), np.concatenate([w_a, w_b]), np.array([0, 80, 160]), size)
    full_a, full_b = np.concatenate([w_a, np.zeros(20)]), np.concatenate([w_b[:60], np.zeros(20), w_b[60:]])
    exact = sum(1 / np.maximum(full_a / full_a[k], full_b / full_b[k]).sum() for k in range(60))
    assert abs((one == two).mean() - exact) < 4 * (exact * (1 - exact) / size) ** 0.5


def test_components(spark):
    edges = [(k, k + 1) for k in range(200, 260)] + [(5, k) for k in range(6, 60)] + [(90, 1), (91, 90)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 200 for k in range(200, 261)}, **{k: 5 for k in range(5, 60)}, 90: 1, 91: 1, 1: 1}
