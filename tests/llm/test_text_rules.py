"""Quality rules, personal data and toxicity: exact parts against plain code, learned parts on held-out rows."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapewatch.llm import pii, quality, toxicity
from tapewatch.llm.queries import QUERIES

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# --- quality -----------------------------------------------------------------------------------------------------------


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    inside = {j for k, g in enumerate(grams) if grams.count(g) > 1 for j in (k, k + 1, k + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\té#|\x1c ", max_size=60))
def test_statistics_equal_plain_ones(text):
    assert quality.statistics(text)[:5] == plain_counts(text)


def test_wide_vocabularies_count_alike(monkeypatch):
    draw = np.random.default_rng(0)
    ids = draw.integers(0, 6, 400)
    want = quality._repeat_words(ids.astype(np.int64), 6)
    assert quality._repeat_words(ids.astype(np.int64), 2_000_000) == want > 0


def test_decision_list_learns_conjunctions():
    draw = np.random.default_rng(3)
    n = 3000
    x = {f: draw.random(n) for f in quality.FEATURES}
    bad = ((x["upper_share"] > 0.8) & (x["mark_share"] > 0.5)) | (x["word_length"] < 0.1)
    rules = quality.learn_list(x, bad, draw.random(n) < 1 / 3)
    hit = np.zeros(n, dtype=bool)
    for rule in rules:
        hit |= quality._covered(rule, x, n)
    assert (hit == bad).mean() > 0.98 and any(len(r) > 1 for r in rules)
    assert quality.learn_list(x, np.zeros(n, dtype=bool), draw.random(n) < 0.5) == []


def test_quality_holds_few_texts_at_once(spark):
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1200)), "text": ["one two three"] * 1199 + [None]})
    parts = list(quality.measured(batch, "text", ["doc_id"]))
    assert max(p.num_rows for p in parts) <= 500 and sum(p.num_rows for p in parts) == 1200
    assert pa.Table.from_batches(parts)["n_words"].to_pylist() == [3] * 1199 + [0]
    # The workers get every text once.
    df = spark.createDataFrame([(k, f"{k} " * 60) for k in range(20)], "doc_id long, text string")
    kept = quality.keep_good(df, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    sent = [line for line in kept._jdf.queryExecution().optimizedPlan().toString().splitlines() if "MapInArrow" in line]
    assert len(sent) == 1 and "_text" not in sent[0] and kept.columns == ["doc_id", "text"]


def test_quality_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    got = QUERIES["op3_decision_list"](spark, MIDDLE).collect()
    assert len(got) == len(docs)
    for r in got[::7]:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(docs[r.doc_id])
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    good = [r for r in got if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.98 * len(good)


def test_quality_of_odd_rows(spark):
    text = "\n".join(" ".join(f"word{k * 12 + j}" for j in range(12)) for k in range(60))
    df = spark.createDataFrame([(1, text, 5, 9), (1, text, 5, 9), (2, None, 1, 1), (None, "", 1, 1), (3, "x" * 300_000, 1, 1)], "doc_id long, text string, N_WORDS int, _c0 int")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and [tuple(r)[0::2] for r in kept.collect()] == [(1, 5), (1, 5)]
    assert quality.keep_good(df.limit(0), labels.limit(0)).count() == 0


# --- personal data -----------------------------------------------------------------------------------------------------

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    out = {}
    for kind, pattern in PLAIN.items():
        out[kind] = []
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out[kind].append(m.span())
    return out


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet="a1.@- +()9é%02", max_size=50), st.text(alphabet="0123456789 -", min_size=15, max_size=60), st.text(max_size=30)))
def test_base_spans_equal_plain_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_pii_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    got = QUERIES["op2_contextual_pii"](spark, MIDDLE).collect()
    assert len(got) == len(docs)
    for r in got:
        spans = plain_spans(docs[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in spans[k])
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(spans[k]) for k in pii.KINDS)
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_shapes_recover_what_base_patterns_lose(spark):
    """A phone number right before a card number is one failing match for either base pattern."""

    def card(k):
        body = f"45395787636{k:04d}"
        return body + next(str(d) for d in range(10) if pii.luhn(body + str(d)))

    rows = [(k, f"call +1 (2{k:02d}) 555-01{k:02d} or pay {card(k)} now") for k in range(12)] + [(50, f"of +1 (415) 555-0177 {card(99)} the"), (51, "number 4539578763621487 of 99887766 things")]
    got = {r.doc_id: ([tuple(s) for s in r.base], [tuple(s) for s in r.added]) for r in pii.personal_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50] == ([], [("card", 21, 37), ("phone", 3, 20)]) and got[51] == ([], []) and all(not got[k][1] and len(got[k][0]) == 2 for k in range(12))


def test_patterns_discover_unseen_identifiers_only_where_they_are_sure(spark):
    seeds = [(k, f"Fine words. Phone: +1 (2{k:02d}) 555-01{k:02d} and the +1 (3{k:02d}) 555-01{k:02d}") for k in range(20)] + [(50 + k, f"E-mail: j{k}@mail.org") for k in range(5)]
    more = [(100, "Phone: (415) 555-0199 too"), (101, None), (102, ""), (103, "the (415) 555-0188 of the house and the garden"), (104, "E-mail: joe (at) mail (dot) org"), (104, "E-mail: joe (at) mail (dot) org"), (105, "the dog " * 50_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in seeds + more], "doc_id long, text string, BASE string")
    got = pii.personal_spans(df).collect()
    added = sorted((r.doc_id, s.kind, s.start, s.end) for r in got for s in r.added)
    assert added == [(100, "phone", 7, 21), (104, "email", 8, 31), (104, "email", 8, 31)] and len(got) == len(seeds + more)
    assert pii.personal_spans(df.limit(0)).count() == 0


def test_every_loose_address_has_a_slot():
    def loose(text):
        base = pii.base_spans(text)
        return [text[a:b] for kind, a, b, *_, seed in pii.slots(text, base) if kind == "email" and not seed]

    names = ["anna [at] mail [dot] com", "bob [at] mail [dot] com", "carl at mail dot com", "dora(at)mail(dot)com"]
    assert loose(", ".join(names)) == names and loose("x@y.org " + " ".join(names)) == names
    for long in ("l" * 300 + " [at] mail [dot] com", "joe [at] " + "h" * 400 + " [dot] com", "joe at " + "h" * 100 + " dot com"):
        assert loose(f"to {long}, thanks") == [long]
    assert loose("Mail x@y.org. Bob.B [at] mail [dot] com. Eve [at] mail [dot] com.") == ["Bob.B [at] mail [dot] com", "Eve [at] mail [dot] com"]
    assert loose("look at it, @ [at] a [dot] b") == [] and len(loose("a [at] b [dot] c, " * 20_000)) == 20_000


def test_contexts_glued_to_their_values_are_patterns(spark):
    rows = [(k, f"ip=10.0.{k}.7 x and mailto:u{k}@mail.org") for k in range(20)] + [(90, "see ip=10 . 3 . 4 . 5 here"), (91, "mailto:joe[at]mail[dot]org"), (92, "w" * 60 + " " + "v" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    total = {r.before: r.total for r in pii.word_counts(df).collect()}
    assert total["ip="] == 21 and total["mailto:"] == 21 and total["w" * 40] == 1
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.added] for r in pii.personal_spans(df).collect()}
    assert got[90] == [("ip", 7, 21)] and got[91] == [("email", 7, 26)]


# --- toxicity ----------------------------------------------------------------------------------------------------------


def test_toxicity_query_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    got = QUERIES["op8_noisy_channel_toxicity"](spark, folder)
    rows = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id", "left").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.toxic is not None]
    caught = [r.predicted for r in held if r.toxic == 1]
    clean = [r.predicted for r in held if r.toxic == 0]
    assert np.mean(caught) > 0.8 and np.mean(clean) < 0.01


def test_obfuscated_words_are_restored_and_scored(spark):
    filler = "they walked along the river and talked about the weather stupid moron idiot clown".split()
    docs = [(k, " ".join(filler[(k + j) % 10] for j in range(30)) + (" you idiot" if k % 4 == 0 else ""), k % 4 == 0) for k in range(200)]
    odd = [(900, "a 1d10t there", None), (901, "an i d i o t there", None), (902, "idiooooot", None), (903, None, None), (904, "", None), (905, "the 2023 report", None), (906, "river " * 60_000, None), (900, "a 1d10t there", None)]
    df = spark.createDataFrame([(i, t, None if y is None else int(y), 0.5) for i, t, y in docs + odd], "doc_id long, text string, toxic int, SCORE double")
    got = toxicity.toxicity(df, df.filter("toxic is not null"), restored=True).collect()
    score = {r.doc_id: (r.score, r.restored) for r in got}
    assert len(got) == len(docs + odd) and all(score[k][0] >= 0.5 for k in (900, 901, 902)) and all(score[k][0] < 0.5 for k in (903, 904, 905, 906))
    assert score[900][1] == "a idiot there" and score[901][1] == "an idiot there"
    assert {r.score for r in toxicity.toxicity(df, df.filter("toxic = 0").limit(3)).collect()} == {0.0}
    assert toxicity.toxicity(df.limit(0), df.limit(0)).count() == 0


def test_character_counts_follow_the_corpus(spark):
    df = spark.createDataFrame([("ab",), ("ab",), (None,)], "text string")
    once = {r.trigram: r.n for r in toxicity.character_counts(df.limit(1)).collect()}
    both = {r.trigram: r.n for r in toxicity.character_counts(df).filter(F.col("n") > 0).collect()}
    assert sum(both.values()) > sum(once.values())
