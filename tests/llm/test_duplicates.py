"""SimHash components against brute force."""

import random
import re

import numpy as np
import xxhash

from tapewatch.llm import simhash
from tapewatch.llm.components import components
from tapewatch.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(ids, prints, radius=3):
    f, parent = np.array(prints, dtype=np.uint64), list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k in range(len(f)):
        for j in np.nonzero(np.bitwise_count(f[:k] ^ f[k]) <= radius)[0].tolist():
            a, b = find(k), find(j)
            parent[max(a, b)] = min(a, b)
    least = {}
    for k, i in enumerate(ids):
        r = find(k)
        least[r] = min(least.get(r, i), i)
    return [least[find(k)] for k in range(len(ids))]


def test_masks_cover_every_pair():
    draw = random.Random(3)
    for level in (0, 1):
        masks = [m % (1 << 64) for m in simhash.covering_masks(3, level)]
        assert len(masks) == 15 and all(20 < m.bit_count() < 50 for m in masks)
        for _ in range(3000):
            differ = sum(1 << b for b in draw.sample(range(64), 3))
            assert any(m & differ == 0 for m in masks)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()
    prints = [plain_fingerprint(d.text) for d in docs]
    want = {d.doc_id: (f"{p:016x}", c) for d, p, c in zip(docs, prints, plain_components([d.doc_id for d in docs], prints))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op5_covering_simhash"](spark, FOLDER).collect()}
    assert got == want and len({c for _, c in got.values()}) < len(got)


def test_dense_buckets_are_divided_not_cut(spark):
    draw = random.Random(8)
    centre = draw.getrandbits(64)
    prints = {centre} | {centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(1, 5))) for _ in range(600)} | {draw.getrandbits(64) for _ in range(50)}
    prints = sorted(prints)
    want = plain_components(prints, prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "bits long")
    for bucket in (40, 2048):
        edges = [(r.u % (1 << 64), r.v % (1 << 64)) for r in simhash.links(df, bucket=bucket).collect()]
        assert all((a ^ b).bit_count() <= 64 for a, b in edges)
        at, parent = {p: k for k, p in enumerate(prints)}, list(range(len(prints)))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            x, y = find(at[a]), find(at[b])
            parent[max(x, y)] = min(x, y)
        assert [prints[find(k)] for k in range(len(prints))] == want
        assert len(edges) < 20 * len(prints)


def test_odd_rows_and_representatives(spark):
    long = "word " * 70_000 + "end"
    rows = [(4, None, "a"), (2, "", "b"), (7, " \n", "c"), (None, "one two three four", "d"), (5, "One two  three four", "e"), (5, "One two  three four", "e"), (9, long, "f"), (8, long, "g"), (None, "alone here today", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, BITS string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(df).collect())
    assert got == sorted([("None", "5"), ("None", "None"), ("2", "2"), ("4", "2"), ("5", "5"), ("5", "5"), ("7", "2"), ("8", "8"), ("9", "8")])
    kept = simhash.keep_representatives(df)
    assert kept.columns == df.columns and sorted(r.BITS for r in kept.collect()) == ["b", "e", "g", "h"]
    assert simhash.fingerprint(long) == plain_fingerprint(long)
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_representatives(df.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(8, 60)] + [(3, 3), (200, 201), (201, 200)]
    got = dict((r.node, r.root) for r in components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{k: 100 for k in range(100, 141)}, **{k: 7 for k in range(7, 60)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
