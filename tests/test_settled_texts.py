"""Which texts go to Python for their compatibility form."""

import random
import re
import unicodedata

from memlake.operators import dedupe


def test_texts_that_stay_as_they_are_do_not_go_to_python(spark):
    draw = random.Random(5)
    marks = ["a", " ", "é", "ß", "漢", "가", "ᄀ", "ᅡ", "ᆨ", "́", "e", "ﬁ", "①", " ", "​", "⁠", "\u0085", "\x1c", "😀", "𝐀", "　", "が", "か", "゙", "豈", "ё", "й", "ٓ", "ا"]
    texts = ["".join(draw.choices(marks, k=draw.randrange(12))) for _ in range(3000)] + [None, "plain", "Ünï 漢字 Straße"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    odd = {r["id"] for r in rows.where(rows.content.rlike(dedupe.unsettled())).collect()}
    assert all(k in odd for k, t in enumerate(texts) if t and unicodedata.normalize("NFKC", t) != t)
    assert len(texts) - 1 not in odd and len(texts) - 2 not in odd
    got = {r["id"]: r["key"] for r in dedupe.dedupe_key(rows).collect()}
    for k, t in enumerate(texts):
        if t and not t.isascii():
            assert got[k] == re.sub(r"\s+", " ", re.sub("[​-‏﻿]", "", unicodedata.normalize("NFKC", t))).strip(), ascii(t)
    assert got[len(texts) - 3] is None
