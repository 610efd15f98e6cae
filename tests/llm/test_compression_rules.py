"""Quality rules against plain loops, and what the bands keep and reject."""

import base64
import random
import re

import pytest
import zstandard

from memlake.llm import compression_rules as rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines, seen, again = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for line in lines:
        again += line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def verdict(text, share=0.25):
    raw = (text or "").encode()
    outside = lambda part: not next((low <= len(zstandard.ZstdCompressor(level=3).compress(part)) / len(part) <= high) for least, low, high in rules.BANDS[::-1] if len(part) >= least)
    if not raw:
        return True
    chunks = [raw[k : k + 4096] for k in range(0, len(raw), 4096)]
    chunks = [c for c in chunks if len(c) >= 1024 or len(chunks) == 1]
    return not outside(raw) and sum(len(c) for c in chunks if outside(c)) <= share * sum(map(len, chunks))


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    some = ["a", "b", "c", "dd", "é", "x\x0by", "|", "<p>", "日本", "##", "\xa0"]
    out = [None, "", " \t\n", "one", "a b", "a b c a b c", "x\ny\nx\n\n \n \nx", "a\r\nb\na\r\nb"]
    for _ in range(120):
        out.append("".join(draw.choice(some) + draw.choice([" ", "\n", " \t", "\x0c", "　"]) for _ in range(draw.randrange(1, 90))))
    vocabulary = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randrange(2, 10))) for _ in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    prose = lambda n: " ".join(draw.choices(vocabulary, weights, k=n))
    noise = lambda n: " ".join(base64.b64encode(draw.randbytes(30)).decode() for _ in range(n))
    out += [prose(60), prose(900), prose(5000), noise(100), noise(2000), prose(2000) + noise(40), prose(700) + noise(400), " ".join(f"row {k} of the same table" for k in range(900))]
    return out


def test_figures_by_plain_loops(documents, texts):
    got = {r["doc_id"]: r for r in rules.judge(documents(list(enumerate(texts)))).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        assert tuple(got[k][c] for c in rules.COUNTS) == by_hand(text), text
        n, repeated = got[k]["n_words"], got[k]["n_repeat_words"]
        assert got[k]["base_failed"] == (n < 50 or 100 * repeated > 50 * n)
        assert got[k]["kept"] == (not got[k]["base_failed"] and verdict(text)), text


def test_bands_reject_what_repeats_and_what_is_random(documents):
    draw = random.Random(8)
    vocabulary = ["".join(draw.choice("etaoinshrdlucmfwypvbgkjqxz") for _ in range(draw.randrange(3, 9))) for _ in range(3000)]
    weights = [1 / (k + 5) for k in range(3000)]
    rows = [(k, " ".join(draw.choices(vocabulary, weights, k=n))) for k, n in enumerate([60, 150, 400, 1500, 6000, 30_000])]
    rows.append((100, " ".join(base64.b64encode(draw.randbytes(15)).decode() for _ in range(900))))  # random
    rows.append((101, " ".join(f"item{k % 7} number{k} costs{k % 11}" for k in range(1500))))  # a table, no window repeats often
    rows.append((102, rows[5][1] + " " + " ".join(base64.b64encode(draw.randbytes(15)).decode() for _ in range(400))))  # a random tail of a twentieth
    kept = {r["doc_id"]: r["kept"] for r in rules.judge(documents(rows)).collect()}
    assert kept == {**dict.fromkeys(range(6), True), 100: False, 101: False, 102: True}


def test_edge_rows(spark, documents):
    frame = documents([(None, None), (1, "a b"), (1, "a b")])
    assert sorted((r["doc_id"] or 0, r["n_words"], r["kept"]) for r in rules.judge(frame).collect()) == [(0, 0, False), (1, 2, False), (1, 2, False)]
    assert rules.judge(documents([])).collect() == []
    odd = spark.createDataFrame([("k", "a b c", 1.0, True)], "key string, body string, ratio double, kept boolean")
    assert [tuple(r)[:2] for r in rules.judge(odd, "key", "body").collect()] == [("k", 3)]
    long = documents([(1, "word " * 400_000)])
    row = rules.judge(long).first()
    assert row["n_words"] == row["n_repeat_words"] == 400_000 and row["base_failed"]
