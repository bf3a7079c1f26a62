"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from tapewatch.llm import variants as V


def plain_words(rows):
    found = Counter()
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            found[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def plain_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(count):
    near = {w: [x for x in count if plain_near(w, x)] for w in count}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-count[x], x), default=None)
        form[w] = best if best and count[best] >= 10 * count[w] else None
    out = set()
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, count[w], form[w], root, len(near[w]), count.get(form[w])))
    return out


def as_set(df):
    return {(r.word, r.n, r.form, r.root, r.n_near, r.form_n) for r in df.select("word", "n", "form", "root", "n_near", "form_n").collect()}


@pytest.mark.parametrize("block", [16, 1024])
def test_equals_all_pairs(spark, block):
    draw, letters = random.Random(block), "abcdeinorxéèß÷ÀÖ"
    words = {"".join(draw.choice(letters) for _ in range(draw.randint(7, 10))) for _ in range(60)}
    for w in list(words) * 6:  # up to two edits away
        for _ in range(draw.randint(1, 2)):
            k = draw.randrange(len(w))
            w = draw.choice([w[:k] + w[k + 1 :], w[:k] + draw.choice(letters) + w[k:], w[:k] + draw.choice(letters) + w[k + 1 :]])
        words.add(w)
    words |= {"e" * 7, "e" * 8, "e" * 9, "listens", "silents", "x" * 40_000, "x" * 40_001}
    count = {w: draw.choice([2, 3, 20, 25, 200, 250, 2500, 30_000]) for w in words}
    got = as_set(V.variants(spark.createDataFrame(list(count.items()), "word string, n long"), block=block))
    want = plain_variants(count)
    assert got == want and sum(r[2] is not None for r in want) > 50 and any(r[3] != (r[2] or r[0]) for r in want)


def test_counts_of_odd_texts(spark):
    draw = random.Random(2)
    pool = ["Example", "example's", "ÀÉÎõüþÿ", "straße", "naïveté", "sevenseven", "x×y÷zabcd", "İstanbul", "KELVINS"]
    rows = [(k, " ".join(draw.choice(pool) for _ in range(40))) for k in range(200)] + [(None, "nothing nothing"), (7, None), (8, ""), (9, "a" * 200_000), (9, "a" * 200_000), (10, "ſtrange Kelvins strange")]
    got = {r.word: r.n for r in V.word_counts(spark.createDataFrame([(*r, "w") for r in rows], "doc_id long, text string, word string")).collect()}
    assert got == plain_words(rows) and "a" * 200_000 in got or "a" * 199_999 in got


def test_query_equals_plain_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert as_set(V.variants(V.word_counts(docs))) == plain_variants(plain_words(rows))
    assert V.variants(V.word_counts(docs.limit(0))).count() == 0
