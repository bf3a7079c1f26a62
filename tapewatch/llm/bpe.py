"""Byte-pair encoding and decoding with forced boundaries.

Two neighbouring byte characters that stand side by side in no vocabulary token can never end up in
one token, whatever the merges do. A cut between them is certain, and so is every white-space run and every
border of the pre-tokenizer. Texts are cut at all of these, each fragment is encoded on its own
(equal fragments once per task), and the ids are concatenated. The result equals encoding whole texts.

Null texts count as empty. Texts of any length are encoded whole; a fragment without any forced
cut is still encoded as one. Repeated rows are encoded each. Columns of the input that have the name of an output column are replaced.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tapewatch.llm.common import map_batches, slices

#: Distinct chunks, and as many fragments, that a worker remembers: the first it meets, among them the frequent ones.
REMEMBERED = 200_000
#: str.split also cuts at these separators, which are no white space to the tokenizer.
NOT_SPACE = re.compile("[\x1c-\x1f]")
SPACE = re.compile("[ \t\n\r\x0b\x0c]+")


class ForcedBoundaryCodec:
    """Encoder for a word-end BPE in the file format of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.normalizer, self.splitter = whole.normalizer, whole.pre_tokenizer
        self.last = BPE(vocab, merges, end_of_word_suffix=self.end) if self.end else BPE(vocab, merges)
        self.inner = BPE(vocab, merges)
        self.inside = {a + b for token in vocab for body in [token.removesuffix(self.end) if self.end else token] for a, b in zip(body, body[1:])}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # On printable ASCII the letter and digit classes are these, and byte characters are the characters themselves.
        self.plain = re.compile(pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").replace("[[", "[").replace("]]", "]"), re.ASCII)
        self.fragments: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}  # inner ones, and ends of words
        self.chunks: dict[str, bytes] = {}

    def cut(self, word: str) -> list[str]:
        """The fragments of one pre-tokenized word between its forced boundaries."""
        inside = self.inside
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in inside]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])] if cuts else [word]

    def fragment(self, text: str, final: bool) -> bytes:
        got = self.fragments[final].get(text)
        if got is None:
            got = np.array([t.id for t in (self.last if final else self.inner).tokenize(text)], dtype="<u4").tobytes()
            if sum(map(len, self.fragments)) < REMEMBERED:
                self.fragments[final][text] = got
        return got

    def chunk(self, text: str) -> bytes:
        """Ids of a text without ASCII white space or special tokens."""
        if text.isascii() and text.isprintable():
            words = self.plain.findall(text.lower())
        else:
            words = [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]
        parts = []
        for word in words:
            *inner, final = self.cut(word)
            parts += [self.fragment(x, False) for x in inner]
            parts.append(self.fragment(final, True))
        return b"".join(parts)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out, known = [], self.chunks
        for k, piece in enumerate(self.at_special.split(text) if self.at_special else [text]):
            if k % 2:
                out.append(np.array([self.special[piece]], dtype="<u4").tobytes())
                continue
            for chunk in SPACE.split(piece) if NOT_SPACE.search(piece) else piece.split():
                got = known.get(chunk)
                if got is None:
                    got = self.chunk(chunk)
                    if len(chunk) <= 64 and len(known) < REMEMBERED:
                        known[chunk] = got
                out.append(got)
        return b"".join(out)


def token_table(path: str) -> np.ndarray:
    """Token text by id, special tokens included."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    names = spec["model"]["vocab"] | {x["content"]: x["id"] for x in spec["added_tokens"]}
    tokens = np.empty(max(names.values(), default=-1) + 1, dtype=object)
    tokens[:] = ""
    for token, i in names.items():
        tokens[i] = token
    return tokens


def decode(tokens: np.ndarray, ids: bytes) -> str:
    return " ".join(tokens[np.frombuffer(ids, dtype="<u4")])


@functools.lru_cache(maxsize=2)
def codec_of(path: str) -> ForcedBoundaryCodec:
    """One codec per Python worker, so that later tasks find its fragments known."""
    return ForcedBoundaryCodec(path)


def _replaced(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.lower() in names])


def _schema(df: DataFrame, *added: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *added])


def with_token_ids(df: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """Add ``n_tokens`` and ``token_ids`` (little-endian unsigned 32-bit ids, binary) for every text."""
    df = _replaced(df, "n_tokens", "token_ids")

    def make():
        codec = codec_of(tokenizer)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for rows in slices(batch):
                ids = [codec.encode(t or "") for t in rows.column(text).to_pylist()]
                added = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays([*rows.columns, *added], names=[*rows.schema.names, "n_tokens", "token_ids"])

        return step

    return map_batches(df, make, _schema(df, "n_tokens bigint", "token_ids binary"))


def with_decoded(df: DataFrame, tokenizer: str, ids: str = "token_ids") -> DataFrame:
    """Add ``decoded``, the text that the ids stand for (null ids: empty); token texts are joined by spaces, as the file names no decoder."""
    df = _replaced(df, "decoded")

    def make():
        tokens = token_table(tokenizer)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for rows in slices(batch):
                texts = [decode(tokens, x or b"") for x in rows.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], names=[*rows.schema.names, "decoded"])

        return step

    return map_batches(df, make, _schema(df, "decoded string"))
