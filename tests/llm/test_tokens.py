"""Byte-pair encoding and token files against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
from tapewatch.llm import huffman
from tapewatch.llm.bpe import ForcedBoundaryCodec, decode, token_table, with_decoded, with_token_ids
from tapewatch.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
WORD_FILE, BYTE_FILE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def codec():
    return ForcedBoundaryCodec(WORD_FILE)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_FILE), Tokenizer.from_file(BYTE_FILE), token_table(WORD_FILE)


ODD = "ab'sC 1é́ÅßΣς  \x1c\x85‍日本\t\n|$_-🙂İ"


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(alphabet=ODD, max_size=40), st.text(max_size=40), st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "x", " ", "it's", "\x1f"]), max_size=8).map("".join)))
def test_encoding_equals_library(codec, library, text):
    text = text.encode("utf-8", "ignore").decode()
    want = library[0].encode(text, add_special_tokens=False).ids
    got = codec.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == want
    assert decode(library[2], got) == library[0].decode(want, skip_special_tokens=False)


def test_no_cut_inside_a_token(codec):
    tokens = [t.removesuffix("</w>") for t in token_table(WORD_FILE) if t and not t.startswith("<|")]
    assert all(len(codec.cut(t)) == 1 for t in tokens if t)
    assert len(codec.cut("ab" + "é" + "§ab")) >= 1 and "".join(codec.cut("qxzjqxzj")) == "qxzjqxzj"


def test_long_text_and_bounded_memory(codec, library, monkeypatch):
    monkeypatch.setattr("tapewatch.llm.bpe.REMEMBERED", 3)
    draw = random.Random(2)
    text = " ".join("".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 9))) for _ in range(20_000)) + " " + "z" * 30_000
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == library[0].encode(text, add_special_tokens=False).ids


def test_frames_with_nulls_repeats_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "Hi there", "z"), (2, "Hi there", "z")], "doc_id long, text string, N_TOKENS string")
    rows = with_decoded(with_token_ids(df, WORD_FILE), WORD_FILE).orderBy("doc_id").collect()
    assert sorted(r.decoded for r in rows) == ["", "", "hi</w> there</w>", "hi</w> there</w>"] and {r.n_tokens for r in rows} == {0, 2}
    assert with_decoded(with_token_ids(df.limit(0), WORD_FILE), WORD_FILE).count() == 0


def test_query_round_trip(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = QUERIES["op4_forced_boundary_bpe"](spark, FOLDER).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library[0].encode(docs[r.doc_id], add_special_tokens=False).ids
        text = library[0].decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


# --- token files -------------------------------------------------------------------------------------------------------


def test_code_lengths_are_optimal_and_limited():
    draw = random.Random(4)
    for _ in range(30):
        counts = np.array([draw.randint(1, 10 ** draw.randint(1, 6)) for _ in range(draw.randint(2, 40))])
        free = huffman.code_lengths(counts, 40)
        import heapq

        heap, cost = [int(c) for c in counts], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a + b
            heapq.heappush(heap, a + b)
        assert int((free * counts).sum()) == cost
        short = huffman.code_lengths(counts, 6)
        assert short.max() <= 6 and sum(2.0 ** -int(x) for x in short) <= 1
    assert huffman.code_lengths(np.array([5])).tolist() == [1] and len(huffman.code_lengths(np.array([], dtype=np.int64))) == 0


def test_blocks_round_trip():
    draw = np.random.default_rng(1)
    ids = (draw.pareto(1.0, 5000) * 20).astype(np.int64) % 50_000
    known, n = np.unique(ids, return_counts=True)
    book = huffman.Codebook(known, huffman.code_lengths(n))
    for size in (1, 255, 256, 257, 5000):
        checkpoints, bits = book.encode(ids[:size])
        assert book.decode(checkpoints, bits, size).tolist() == ids[:size].tolist()
    one = huffman.Codebook(np.array([7]), huffman.code_lengths(np.array([3])))
    assert one.decode(*one.encode(np.array([7, 7, 7])), 3).tolist() == [7, 7, 7]


def test_files_of_odd_rows(spark, library, tmp_path):
    rows = [(3, "same"), (3, "same"), (None, "no id"), (1, None), (2, ""), (9, "<|endoftext|> é \x00" + "long " * 4000), (-5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text").repartition(3)
    huffman.write_token_files(df.selectExpr("*", "'clash' as tie", "1 as part"), f"{tmp_path}/f", BYTE_FILE, end_id=0, block_ids=50)
    got = huffman.read_token_files(spark, f"{tmp_path}/f").orderBy("start").collect()
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library[1].encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, bytes(r.token_ids)) for r in got] == want


def test_empty_file_set(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    huffman.write_token_files(empty, f"{tmp_path}/f", BYTE_FILE, end_id=0)
    assert huffman.read_token_files(spark, f"{tmp_path}/f").count() == 0


def test_long_white_space_runs(library, monkeypatch):
    encode = huffman.byte_encoder(BYTE_FILE)
    assert len(encode(" " * 2_000_000 + "x")) == 2_000_000
    assert encode("a" + "\n" * 1_200_000 + "b") == library[1].encode("a" + "\n" * 1_200_000 + "b", add_special_tokens=False).ids
    monkeypatch.setattr(huffman, "LONG_RUN", 3)
    draw = random.Random(9)
    for _ in range(2000):
        text = "".join(draw.choice([" ", "    ", "\n", "\t \t\t", "\x1c", "\xa0", "\u3000\u2009 ", "it's", "é", "12", "..", "<|endoftext|>", "<|"]) for _ in range(draw.randint(1, 12)))
        assert encode(text) == library[1].encode(text, add_special_tokens=False).ids, text


def test_token_file_query(spark, library):
    start = 0
    got = {r.doc_id: r for r in QUERIES["op10_huffman_token_files"](spark, FOLDER).collect()}
    docs = sorted(spark.read.parquet(f"{FOLDER}/documents.parquet").collect(), key=lambda r: r.doc_id)
    for d in docs:
        ids = [*library[1].encode(d.text or "", add_special_tokens=False).ids, 0]
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
