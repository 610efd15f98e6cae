"""Spelling variants against plain loops, and the index against plain search."""

import random
import re
import zlib

import numpy as np
import pytest

from memlake.llm import fm_index, spelling


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def by_hand(rows, least_length=6, least_count=5):
    counts = {}
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'null' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= least_length:
                counts[run] = counts.get(run, 0) + 1
    counts = {w: n for w, n in counts.items() if n >= least_count}
    form, near = {}, {}
    for w, n in counts.items():
        around = [v for v in counts if one_edit(w, v)]
        near[w] = len(around)
        best = min(around, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, root, form[w], n, near[w], counts.get(form[w])))
    return out


def result(frame):
    rows = [(r["word"], r["root"], r["form"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(7)
    words = []
    for _ in range(60):
        word = "".join(draw.choice("abé") for _ in range(draw.randrange(5, 12)))
        words += [word] * draw.choice([1, 2, 6, 40])
        for _ in range(4):
            k = draw.randrange(len(word))
            other = draw.choice([word[:k] + draw.choice("abcÿ") + word[k:], word[:k] + word[k + 1 :], word[:k] + draw.choice("abc") + word[k + 1 :]])
            words += [other.upper() if draw.random() < 0.2 else other] * draw.choice([1, 5, 30, 200])
    draw.shuffle(words)
    rows = [(k, ", ".join(words[k::97]) + "; x-y naïve") for k in range(97)]
    return [*rows, (None, "abababab " * 9), (None, None), (3, ""), (3, "Zürich-" * 8), (5, "aaaaaaaaaaaa " * 700), (5, "aaaaaaaaaaa " * 120), (6, "aaaaaaaaaa " * 22)]


def test_by_plain_loops(documents, rows):
    want = by_hand(rows)
    assert len(want) > 100 and any(w[2] for w in want) and any(w[1] != (w[2] or w[0]) for w in want)
    assert result(spelling.spelling_variants(documents(rows))) == want


def test_crowded_groups_are_split(documents, rows):
    want = by_hand(rows)
    assert result(spelling.spelling_variants(documents(rows), cell_words=8, block_words=3)) == want


def test_index_against_plain_search():
    draw = random.Random(2)
    words = sorted({"".join(draw.choice("abc") for _ in range(draw.randrange(4, 9))) for _ in range(400)})
    index = fm_index.TwoWayIndex(words)
    for rightward in (True, False):
        for longer in (False, True):
            asked = np.array([k for k, w in enumerate(words) if len(w) > 4 or not longer])
            exact = np.array([(len(words[k]) - longer) // 2 for k in asked])
            got = [(asked[a], b) for at, found in index.one_edit(asked, exact, np.full(len(asked), longer), rightward) for a, b in zip(at, found, strict=True)]
            same = lambda a, b, n: a[:n] == b[:n] if rightward else a[len(a) - n :] == b[len(b) - n :]
            want = {(k, j) for k, e in zip(asked, exact, strict=True) for j, v in enumerate(words) if one_edit(words[k], v) and (len(v) < len(words[k])) == longer and same(words[k], v, e)}
            want = {(k, j) for k, j in want if one_edit_beyond(words[k], words[j], exact[list(asked).index(k)], rightward)}
            assert len(got) == len(set(got)) and set(got) == want


def one_edit_beyond(a, b, n, rightward):
    """Whether one edit after the first n characters (before the last n) makes b of a."""
    if not rightward:
        a, b = a[::-1], b[::-1]
    return one_edit(a[n:], b[n:]) and a[:n] == b[:n]


def test_suffix_ranks_name_the_words():
    words = ["ab", "abc", "b", "bab"]
    index = fm_index.TwoWayIndex(words)
    low, count = np.array([0]), np.array([index.forward.size])
    for c in "\0bab\0":  # read from its end
        low, count, _ = index.forward.extend(np.searchsorted(index.symbols, [ord(c)]), low, count)
    assert (low[0] - 1, count[0]) == (3, 1)


def test_edge_tables(spark, documents):
    assert spelling.spelling_variants(documents([])).collect() == []
    assert spelling.spelling_variants(documents([(1, None), (2, "short words only")])).collect() == []
    odd = spark.createDataFrame([("k", "letters " * 6, "x", 1)], "n string, word string, root string, n_near long")
    assert result(spelling.spelling_variants(odd, "n", "word")) == by_hand([("k", "letters " * 6)])
    long = "q" * 30_000
    assert result(spelling.spelling_variants(documents([(1, (long + " ") * 5), (2, ("q" + long + " ") * 30)]))) == by_hand([(1, (long + " ") * 5), (2, ("q" + long + " ") * 30)])
