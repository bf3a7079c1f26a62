"""The pipeline's near-dedup stage against exact Jaccard similarity."""

import random

import corpus_pipeline
from tapewatch.llm import nearcopies
from tapewatch.llm.nearcopies import near_copies


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_least(rows):
    """The smallest id of each row's component, from all pairs."""
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if similarity(sets[a], sets[b]) >= 0.8:
                root = [root[b] if r == root[a] else r for r in root]
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min(least.get(r, i), i)
    return [least[r] for r in root]


def test_planted_copies_leave_and_others_stay(spark):
    draw, rows = random.Random(5), []
    say = lambda n: ["".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    for group in range(40):
        base = say(400)
        rows.append((10 * group, " ".join(base)))
        for j, changes in enumerate((1, 3, 6, 8, 9, 14, 30), 1):  # similarity from 0.975 down to about 0.5
            copy = list(base)
            for k in range(changes):
                copy[20 + (k * 400) // (changes + 1)] = say(1)[0]
            rows.append((10 * group + j, " ".join(copy)))
    want = plain_least(rows)
    between = [k for k, (i, t) in enumerate(rows) if i % 10 and 0.8 <= similarity(plain_set(t), plain_set(rows[k - i % 10][1])) < 0.95]
    assert len(between) >= 80 and len(set(want)) > 80
    got = {r.doc_id: r.component_id for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == want
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), None)
    assert {r.doc_id for r in kept.collect()} == set(want)


def test_stage_equals_exact_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.filter("doc_id is not null and text is not null").select("doc_id", "text").collect())
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs.filter("doc_id is not null and text is not null"), None).collect()}
    assert got == set(plain_least(rows))


def test_odd_rows(spark):
    rows = [(4, None), (2, ""), (7, " \n"), (None, "one two three four"), (5, "One two  three four"), (5, "One two  three four"), (None, "alone here today")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id is None, r.doc_id) for r in corpus_pipeline.near_dedup(spark, df, None).collect()) == [(False, 2), (False, 5), (True, None)]
    assert near_copies(df.limit(0)).count() == 0


def test_large_buckets_without_the_square(spark):
    """Many texts with one long passage in common that are not copies, among them families of copies, some chained."""
    draw, rows = random.Random(9), []
    say = lambda n: ["".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    passage = say(150)
    for k in range(150):
        rows.append((1000 + k, " ".join(say(15) + passage + say(15))))  # similarity of about 0.7
    base = passage + say(60)
    for k in range(60):  # near copies, each a change further from the first
        base = list(base)
        base[3 * k] = say(1)[0]
        rows.append((2000 + k, " ".join(base)))
    for k in range(80):
        copy = passage + say(20)
        rows += [(3000 + 2 * k, " ".join(copy)), (3001 + 2 * k, " ".join(copy[:-1] + say(1)))]
    want = plain_least(rows)
    got = {r.doc_id: r.component_id for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == want and 200 < len(set(want)) < len(rows) - 100


def test_long_texts_and_clashing_columns(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, long, "a", 1), (2, long + " end", "b", 2), (3, " ".join(f"w{k}" for k in range(0, 120_000, 2)), "c", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, root int")
    kept = corpus_pipeline.near_dedup(spark, df, None)
    assert kept.columns == df.columns and sorted(r.node for r in kept.collect()) == ["a", "c"]


def test_covering_simhash_proposes_close_fingerprints(spark):
    draw = random.Random(11)
    bits, rows = [draw.getrandbits(64) for _ in range(30)], []
    for b in list(bits):
        bits += [b, b ^ sum(1 << k for k in draw.sample(range(64), 3)), b ^ sum(1 << k for k in draw.sample(range(64), 5))]
    rows = [(k, b - (1 << 64) if b >> 63 else b) for k, b in enumerate(bits)]
    got = nearcopies._simhash_pairs(spark.createDataFrame(rows, "node long, bits long"), 4).collect()

    def least(pairs):
        root = list(range(len(bits)))
        for a, b in pairs:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
        return root

    assert all((bits[r.u] ^ bits[r.v]).bit_count() <= 3 for r in got) and len(got) < len(bits)
    assert least([(r.u, r.v) for r in got]) == least([(a, b) for a in range(len(bits)) for b in range(a) if (bits[a] ^ bits[b]).bit_count() <= 3])
