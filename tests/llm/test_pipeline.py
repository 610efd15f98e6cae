import hashlib
import random
import string
from collections import Counter

import corpus_pipeline
from memlake.llm import bpe

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingle_set(text):
    words = text.lower().encode().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_stages_against_brute_force(spark, documents):
    draw = random.Random(9)
    vocabulary = {"en": ["the", "of", "and", "thing", "with"], "de": ["der", "und", "nicht", "straße", "über"]}
    rows = []
    for k in range(160):
        lang = draw.choice(list(vocabulary))
        rows.append((k, " ".join(draw.choice(vocabulary[lang]) + str(draw.randrange(30)) for _ in range(40)), lang, f"s{k % 3}"))
    rows += [(300 + k, rows[k][1].upper() if k % 2 else rows[k][1], rows[k][2], "s1") for k in range(20)]
    rows += [(400 + k, rows[k + 30][1] + " more", rows[k + 30][2], None) for k in range(20)]
    rows += [(500, None), (501, ""), (502, "123 !?"), (9, rows[9][1], rows[9][2], "s0")]
    docs = documents(rows)

    docs = corpus_pipeline.identify_language(spark, docs, "")
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = [r for r in rows if r[0] not in (500, 501, 502)]
    assert sorted(r["doc_id"] for r in docs.collect()) == sorted(r[0] for r in kept)

    docs = corpus_pipeline.drop_exact_duplicates(spark, docs, "")
    last = {}
    for r in kept:
        norm = r[1].translate(LOWER)
        if norm not in last or last[norm][0] < r[0]:
            last[norm] = r
    kept = sorted(last.values())
    assert [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()] == [r[:2] for r in kept]

    docs = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    sets = [shingle_set(r[1]) for r in kept]
    first = [k for k in range(len(kept)) if not any(len(sets[j] & sets[k]) >= 0.8 * len(sets[j] | sets[k]) for j in range(k))]
    kept = [kept[k] for k in first]
    assert 155 < len(kept) < 175
    assert [r["doc_id"] for r in docs.orderBy("doc_id").collect()] == [r[0] for r in kept]

    docs = corpus_pipeline.mix_sources(spark, docs, "")
    copies = Counter(r["doc_id"] for r in docs.collect())
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and max(copies.values()) == 2 and len(copies) < len(kept)
    assert copies == Counter(r["doc_id"] for r in docs.collect())

    tokens = bpe.encoding()
    texts = {r[0]: r[1] for r in kept}
    out = corpus_pipeline.tokenize(spark, docs, "").collect()
    assert Counter(r["doc_id"] for r in out) == copies
    assert all(list(r["ids"]) == tokens.encode_ordinary(texts[r["doc_id"]]) and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in out)


def test_run_over_nothing(spark, documents, tmp_path):
    documents([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
