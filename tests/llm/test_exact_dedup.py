import hashlib
import string

import numpy as np

from memlake.llm import exact_dedup

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def test_golomb_code():
    draw = np.random.default_rng(2)
    for shift in (0, 3, 20):
        for n in (0, 1, 500):
            values = np.unique(draw.integers(0, max(4, n << (shift + 1)), n, dtype=np.uint64))
            assert (exact_dedup.golomb_decode(exact_dedup.golomb_encode(values, shift), len(values), shift) == values).all()


def test_against_brute_force(documents):
    rows = [(n, f"Text {n % 40} É") for n in range(300)] + [(n, f"text {n % 40} É") for n in range(300, 400)] + [(n, f"own {n}") for n in range(400, 500)]
    rows += [(500, None), (501, ""), (502, " "), (None, "text 3 É"), (None, "nobody"), (None, "NOBODY"), (399, "text 39 É"), (600, "x" * 100_000), (601, "X" * 100_000), (602, "é"), (603, "É")]
    docs = documents(rows).withColumnsRenamed({"lang": "row", "source": "text_sha256", "n_chars": "sender"})
    groups = {}
    for i, text in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(i)
    expected = []
    for i, text in rows:
        norm = (text or "").translate(LOWER)
        ids = [x for x in groups[norm] if x is not None]
        expected.append((i, max(ids, default=None), len(groups[norm]), hashlib.sha256(norm.encode()).hexdigest()))
    got = exact_dedup.exact_duplicates(docs).collect()
    assert sorted(map(str, expected)) == sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"])) for r in got)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)
    left = exact_dedup.without_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(r["doc_id"]) for r in kept)


def test_suspects_split_by_bytes(documents, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SPARE", -12)  # four bits, so nearly all rows are suspects
    got = exact_dedup.exact_duplicates(documents([(n, f"t{n // 2}") for n in range(60)])).collect()
    assert all(r["group_size"] == 2 and r["kept"] == (r["doc_id"] % 2 == 1) for r in got)


def test_suspects_are_the_repeated_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SENDER_ROWS", 100)  # several senders in a partition
    draw = np.random.default_rng(4)
    values = draw.integers(0, 1 << 20, 3000)
    values[::7] = values[0]
    rows = spark.createDataFrame([(int(v),) for v in values], "fingerprint long").repartition(5)
    found, counts = np.unique(values, return_counts=True)
    for owners in (1, 6):
        got = exact_dedup.suspects(rows, 20, 5, owners, len(values)).collect()
        assert sorted(r["fingerprint"] for r in got) == found[counts > 1].tolist()


def test_null_ids_and_clashing_names(documents):
    docs = documents([(None, "a"), (None, "A"), (None, None), (None, ""), (3, "b")]).withColumnsRenamed({"lang": "_row", "source": "_sha", "n_chars": "keep_id"})
    left = exact_dedup.without_duplicates(docs)
    assert left.columns == docs.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["3", "None", "None"]


def test_empty_table(documents):
    assert exact_dedup.exact_duplicates(documents([])).collect() == []
    assert exact_dedup.without_duplicates(documents([])).collect() == []
