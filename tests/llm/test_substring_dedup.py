import random
import re
from collections import Counter

import numpy as np

from memlake.llm import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(rows, window):
    words = [WORD.findall(text or "") for _, text in rows]
    count = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((str(i), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def test_against_brute_force(documents):
    draw = random.Random(7)
    vocabulary = [f"w{k}" for k in range(50)] + ["é", "\x1c", "Ü,", "\xa0"]
    passage = " ".join(draw.choice(vocabulary) for _ in range(60))
    rows = []
    for n in range(160):
        text = " ".join(draw.choice(vocabulary) for _ in range(draw.randrange(0, 90)))
        if n % 5 == 0:
            text += draw.choice([" ", "\n"]) + passage[draw.randrange(40) :] + "\t" + text[:9]
        rows.append((n, text))
    rows += [(200, None), (201, ""), (202, " \x0b"), (203, "a " * 34), (204, "b " * 35), (205, "c " * 36), (206, "d e " * 30_000), (0, rows[0][1]), (None, rows[1][1]), (7, rows[7][1])]
    docs = documents(rows).withColumnsRenamed({"lang": "chunk", "source": "n_words", "n_chars": "h1"})
    for window in (35, 3):
        got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["text"]) for r in substring_dedup.remove_repeats(docs, window=window).collect())
        assert got == brute_force(rows, window)


def test_copies_of_one_row_share_no_chunk(documents, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 4096)
    rows = [(None, "one two three four five")] * 400 + [(None, None)] * 400 + [(n, f"own {n} words here") for n in range(50)]
    docs = documents(rows).repartition(6)
    chunks, n_bytes, _ = substring_dedup.dealt(docs, "doc_id", "text", None, None)
    dealt = Counter(r["chunk"] for r in chunks.collect())
    assert n_bytes == sum(len(t or "") for _, t in rows) and max(dealt.values()) < 200
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["text"]) for r in substring_dedup.remove_repeats(docs, window=3).collect())
    assert got == brute_force(rows, 3)


def test_plan_bounds_messages_and_memory():
    for n_bytes in (0, 10**6, 5 * 10**8, 3 * 10**10, 10**12, 10**14):
        for task in (1 << 28, 1 << 30, 12 << 30):
            chunk, bits = substring_dedup.plan(n_bytes, task)
            assert chunk >= substring_dedup.CHUNK_BYTES and bits >= substring_dedup.SHARD_BITS
            assert chunk * substring_dedup.CHUNK_MEMORY <= max(task, substring_dedup.CHUNK_BYTES * substring_dedup.CHUNK_MEMORY)
            assert substring_dedup.CELL_MEMORY << bits <= max(task, substring_dedup.CELL_MEMORY << substring_dedup.SHARD_BITS)
    chunk, bits = substring_dedup.plan(10**12, 12 << 30)
    assert 2 * 10**12 / chunk * 4 * 2e11 / 2**bits < 10**9
    chunk, bits = substring_dedup.plan(10**14, 12 << 30)
    assert 2 * 10**14 / chunk * 4 * 2e13 / 2**bits < 2 * 10**11


def test_empty_table(documents):
    assert substring_dedup.remove_repeats(documents([])).collect() == []


def test_a_full_sketch_loses_nothing(documents, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CELLS_PER_WINDOW", 1e-9)  # 2^16 cells at least, whatever the input
    rows = [(n, " ".join(f"{n}.{k}" for k in range(3000)) + " same" * 40) for n in range(40)]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["text"]) for r in substring_dedup.remove_repeats(documents(rows)).collect())
    assert got == brute_force(rows, 35)


def test_cells_round_trip():
    cells = np.unique(np.random.default_rng(0).integers(0, 1 << 24, 5000))
    assert (substring_dedup.unpack_cells(substring_dedup.pack_cells(cells)) == cells).all()
    assert len(substring_dedup.unpack_cells(substring_dedup.pack_cells(cells[:0]))) == 0
