import numpy as np
import pytest

from memlake.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, id string, size string"


def brute_force(rows, cosine=0.9):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    x = [np.array(v, dtype=np.float32).astype(float) if o else None for (_, v), o in zip(rows, ok, strict=True)]
    x = [v / np.linalg.norm(v) if v is not None else None for v in x]
    near = [[j for j in range(len(rows)) if i != j and ok[i] and ok[j] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= cosine] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((rows[i][0], len(near[i]), min(ids, default=None)))
    return sorted(map(str, out))


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b") for i, v in rows], SCHEMA)


def sample(draw, n, dim):
    centres = draw.standard_normal((n // 6, dim))
    return [(k, [float(t) for t in np.float32(centres[draw.integers(len(centres))] + draw.choice([0.0, 0.1, 0.25, 0.35]) * draw.standard_normal(dim))]) for k in range(n)]


def test_against_brute_force(spark):
    draw = np.random.default_rng(4)
    rows = sample(draw, 300, 32)
    rows += [(1000 + k, rows[k][1]) for k in range(40)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 32), (2003, [float("nan")] * 32), (2004, [None] * 32), (2005, [1.0, float("inf")]), (2006, [1.0]), (2007, [2.0]), (2008, [-1.0]), (None, rows[3][1]), (None, [0.0]), (5, rows[5][1])]
    got = embedding_duplicates = embedding_dedup.embedding_duplicates(vectors(spark, rows), recall=0.9999999).collect()
    assert sorted(str((r["vec_id"], r["n_links"], r["component_id"])) for r in got) == brute_force(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in embedding_duplicates)


def test_crowded_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    monkeypatch.setattr(embedding_dedup, "TASK", 32)
    rows = sample(np.random.default_rng(8), 240, 16)
    got = embedding_dedup.embedding_duplicates(vectors(spark, rows), recall=0.9999999).collect()
    assert sorted(str((r["vec_id"], r["n_links"], r["component_id"])) for r in got) == brute_force(rows)


def test_recall_at_the_limit():
    draw = np.random.default_rng(6)
    bits, tables = embedding_dedup.plan(50_000, 0.9, 0.995)
    x = embedding_dedup.unit(draw.standard_normal((2000, 64)))
    away = draw.standard_normal((2000, 64))
    away = embedding_dedup.unit(away - (away * x).sum(1, keepdims=True) * x)
    y = 0.9 * x + np.sqrt(1 - 0.81) * away
    turns = embedding_dedup.rotations(64, 1 + -(-bits * tables // 64), 5)
    keys = [(v @ turns[64 : 64 + bits * tables].T > 0).reshape(-1, tables, bits) for v in (x, y)]
    together = (keys[0] == keys[1]).all(axis=2).any(axis=1)
    assert together.mean() > 0.985


@pytest.mark.parametrize("dim", [17, 64, 300])
def test_estimates_and_bounds(dim):
    draw = np.random.default_rng(6)
    rotation = embedding_dedup.rotations(dim, 1, 5)
    for cosine in (0.3, 0.9, 0.95):
        x = embedding_dedup.unit(draw.standard_normal((1500, dim)))
        away = draw.standard_normal((1500, dim))
        away = embedding_dedup.unit(away - (away * x).sum(1, keepdims=True) * x)
        y = cosine * x + np.sqrt(1 - cosine**2) * away
        (a, of_a), (b, of_b) = (embedding_dedup.encode(v, rotation, draw) for v in (x, y))
        signs, _ = embedding_dedup.decode(b, of_b, dim)
        _, turned = embedding_dedup.decode(a, of_a, dim)
        assert abs(((turned * signs).sum(1) / of_b[:, 0]).mean() - cosine) < 0.02  # unbiased
        room = np.array([embedding_dedup.may_link(turned[k : k + 1], of_a[k : k + 1, 2], signs[k : k + 1], of_b[k : k + 1, 0], 0.9)[0, 0] for k in range(1500)])
        assert room.mean() > 0.998 if cosine >= 0.9 else room.mean() < (0.6 if dim < 64 else 0.02)


def test_recall_at_the_production_setting(spark):
    """Against brute force over all pairs, with the default recall: links found, and none that isn't one."""
    draw = np.random.default_rng(12)
    centres = draw.standard_normal((400, 64))
    x = np.float32(centres[draw.integers(400, size=6000)] + draw.choice([0.15, 0.3, 0.33, 0.36], size=(6000, 1)) * draw.standard_normal((6000, 64)))
    got = embedding_dedup.embedding_duplicates(vectors(spark, [(k, [float(t) for t in v]) for k, v in enumerate(x)])).collect()
    u = embedding_dedup.unit(x)
    true = (u @ u.T >= 0.9).sum(axis=1) - 1
    found = np.array([r["n_links"] for r in sorted(got, key=lambda r: r["vec_id"])])
    assert (found <= true).all() and true.sum() > 10_000 and found.sum() / true.sum() > 0.99


def test_empty_table(spark):
    assert embedding_dedup.embedding_duplicates(vectors(spark, [])).collect() == []
