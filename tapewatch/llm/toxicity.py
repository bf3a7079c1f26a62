"""Toxicity of texts after noisy-channel deobfuscation.

A character model (trigram counts of letters over all texts) is the source of a noisy channel that writes letters as look-alikes, repeats them or puts separators between
them. Tokens that look written that way become lattices of the letters they may stand for; Viterbi decoding picks the likeliest reading, and the restored
text is scored. The score of a word is the smoothed share of toxic texts among the labelled texts with that word or one of its beginnings, and a text has the score of its
worst words, so that one insult counts in a long text and many harmless words don't add up.

Learning words reads at most ``max_labelled`` labelled texts (those of the smallest id hash); the character model and the scores cover every text, whole. Null texts are empty;
texts without words have score zero. Null labels are ignored; without toxic labels every score is zero. Repeated rows are scored each. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.common import cut_lineage, map_batches

MAX_LABELLED = 40_000
#: Features of the model: those of the most evidence, if more pass LEAST_SCORE.
MAX_FEATURES = 100_000
LEAST_SCORE = 0.15
#: Labelled texts that the prior counts as.
WEIGHT = 8.0
#: A toxic text speaks for features of this score, or of a score so near its best.
CERTAIN, NEARLY = 0.9, 0.05

LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäãåæçèéêëìíîïñòóôöõœùúûüýÿß"
#: Symbols of the model: 0 outside a word, then LETTERS, then any other letter.
SYMBOLS = len(LETTERS) + 2
#: What a character may stand for besides itself. Fixed values.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i", "µ": "u"}
SEPARATORS = " .-_*~'"
#: Log-probabilities of the channel: a look-alike, a dropped separator, a dropped repetition, and a letter kept as it is.
LOOKALIKE, DROP_SEPARATOR, DROP_REPEAT, KEPT = -1.5, -0.5, -1.0, -0.1

WORD = re.compile(r"[^\W\d_]+")
SPACED = re.compile(r"(?<!\w)\w(?:[ .*_~-]\w){3,}(?!\w)")
TRIPLE = re.compile(r"(.)\1\1")
EDGES = ".,;:!?\"'()[]{}#$%&*|-_/\\<>=…«»„“”"
MIXED = frozenset(LOOKALIKES) | frozenset(SEPARATORS)


# --- character model ---------------------------------------------------------------------------------------------------


def _codes(text: str) -> np.ndarray:
    """Symbols of a lower-case text; every character that is no letter is outside."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    out = CODE_OF[np.minimum(points, len(CODE_OF) - 1)]
    return out[(out != 0) | (np.concatenate([[1], out[:-1]]) != 0)]


def _code_table() -> np.ndarray:
    table = np.zeros(0x3000, dtype=np.int64)
    for k in range(len(table)):
        if chr(k).isalpha():
            table[k] = SYMBOLS - 1
    for k, c in enumerate(LETTERS):
        table[ord(c)] = k + 1
    return table


CODE_OF = _code_table()


def character_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``trigram, n`` over all texts, added up in each task first; at most SYMBOLS**3 rows."""

    def run(batches):
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for k in range(0, len(t or ""), 1 << 20):
                    c = np.concatenate([[0, 0], _codes(t[k : k + (1 << 20)].lower()), [0]])
                    total += np.bincount((c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:], minlength=SYMBOLS**3)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], names=["trigram", "n"])

    return df.select(text).mapInArrow(run, "trigram bigint, n bigint").groupBy("trigram").agg(F.sum("n").alias("n"))


class CharacterModel:
    """Trigram model with additive smoothing over bigram and letter counts."""

    def __init__(self, trigrams: np.ndarray, n: np.ndarray):
        c = np.zeros(SYMBOLS**3)
        c[trigrams] = n
        c = c.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        one = (c.sum(axis=(0, 1)) + 1) / (c.sum() + SYMBOLS)
        two = (c.sum(axis=0) + 5 * one) / (c.sum(axis=(0, 2))[:, None] + 5)
        self.log = np.log((c + 5 * two[None]) / (c.sum(axis=2)[:, :, None] + 5)).astype(np.float32)
        self.known: dict[str, str] = {}

    def __getstate__(self):
        return {"log": self.log, "known": {}}

    def decode(self, token: str) -> str:
        """The likeliest reading of an obfuscated token."""
        log = self.log
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        previous = ""
        for c in token.lower():
            options = [(c, KEPT)] if c.isalpha() else []
            options += [(x, LOOKALIKE) for x in LOOKALIKES.get(c, "")]
            drop = DROP_SEPARATOR if c in SEPARATORS or not options else DROP_REPEAT if c == previous else None
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in states.items():
                if drop is not None and score + drop > after.get((a, b), (-1e30,))[0]:
                    after[a, b] = (score + drop, path)
                for x, cost in options:
                    k = int(CODE_OF[ord(x)]) if ord(x) < len(CODE_OF) else SYMBOLS - 1
                    total = score + cost + float(log[a, b, k])
                    if total > after.get((b, k), (-1e30,))[0]:
                        after[b, k] = (total, (x, path))
            states, previous = after, c
        if not states:
            return token
        (_, _), (_, path) = max(states.items(), key=lambda s: s[1][0] + float(log[s[0][0], s[0][1], 0]))
        out = []
        while path:
            out.append(path[0])
            path = path[1]
        return "".join(reversed(out)) or token

    def _reading(self, token: str) -> str:
        got = self.known.get(token)
        if got is None:
            got = self.decode(token)
            if len(self.known) < 50_000 and len(token) <= 64:
                self.known[token] = got
        return got

    def restore(self, text: str) -> str:
        """The text with obfuscated tokens read; all else as it is."""
        text = SPACED.sub(lambda m: self._reading(m[0]) if sum(map(str.isalpha, m[0])) >= 3 else m[0], text)
        read = {}
        for token in set(text.split()):
            if token.isalpha() and not TRIPLE.search(token):
                continue
            core = token.strip(EDGES)
            if core.isalpha():
                if not TRIPLE.search(core):
                    core = token.lstrip(".,;:?\"'()[]{}#%&*-_/\\<>=")  # a look-alike may stand at an end
                    core = core.rstrip(".,;:?\"'()[]{}#%&*-_/\\<>=!")
                    if core.isalpha():
                        continue
            if obfuscated(core):
                read[token] = token.replace(core, self._reading(core), 1)
        return re.sub(r"\S+", lambda m: read.get(m[0], m[0]), text) if read else text


def obfuscated(token: str) -> bool:
    """Letters mixed with look-alikes or separators, or a character three times in a row."""
    letters = sum(map(str.isalpha, token))
    if letters < 2 or len(token) < 3:
        return False
    if letters == len(token):
        return bool(TRIPLE.search(token))
    return all(c.isalpha() or c in MIXED for c in token) and (letters * 2 >= len(token) - 1 or bool(TRIPLE.search(token)))


# --- words -------------------------------------------------------------------------------------------------------------


def word_features(word: str) -> tuple[str, ...]:
    """A word whole, and its beginnings of 4 to 8 letters, which unseen endings leave as they are."""
    return (word, *(f"{word[:k]}~" for k in (4, 5, 6, 7, 8) if len(word) > k))


def feature_counts(labelled: DataFrame, model: CharacterModel, text: str = "text", label: str = "toxic") -> DataFrame:
    """``feature, toxic, clean``: labelled texts with each feature."""

    def make():
        def step(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
            toxic, clean = Counter(), Counter()
            for t, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                words = set(WORD.findall(model.restore(t or "").lower()))
                (toxic if y else clean).update({f for w in words for f in word_features(w)})
            every = sorted(toxic.keys() | clean.keys())
            return [pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([toxic[f] for f in every], pa.int64()), pa.array([clean[f] for f in every], pa.int64())], names=["feature", "toxic", "clean"])]

        return step

    rows = labelled.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"))
    return map_batches(rows, make, "feature string, toxic bigint, clean bigint").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _scored(counts: DataFrame, share: float) -> DataFrame:
    score = (F.col("toxic") + WEIGHT * share) / (F.col("toxic") + F.col("clean") + WEIGHT)
    passed = counts.filter("toxic >= 2").withColumn("score", score).filter(F.col("score") >= max(LEAST_SCORE, 1.5 * share))
    return passed.orderBy(F.desc(F.col("score") * F.log1p("toxic")), "feature").limit(MAX_FEATURES)


def explained_counts(toxic: DataFrame, model: CharacterModel, scores: dict[str, float], text: str = "text") -> DataFrame:
    """``feature, toxic``: toxic texts that a feature explains, being among the best of the text or nearly certain."""

    def make():
        def step(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
            total = Counter()
            for t in batch.column("text").to_pylist():
                own = {f: scores[f] for w in set(WORD.findall(model.restore(t or "").lower())) for f in word_features(w) if f in scores}
                best = max(own.values(), default=0.0)
                total.update(f for f, s in own.items() if s >= min(CERTAIN, best - NEARLY))
            return [pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["feature", "toxic"])]

        return step

    return map_batches(toxic.select(F.col(text).alias("text")), make, "feature string, toxic bigint").groupBy("feature").agg(F.sum("toxic").alias("toxic"))


def learn_features(labelled: DataFrame, model: CharacterModel, text: str = "text", label: str = "toxic", rounds: int = 3) -> tuple[dict[str, float], float]:
    """Scores of features, and the share of toxic texts.

    After the first counts a toxic text speaks only for the features that explain it best, so that harmless words of copied toxic texts lose their
    score to the insults beside them.
    """
    share = labelled.agg(F.avg(F.col(label).cast("double"))).head()[0] or 0.0
    found = _scored(feature_counts(labelled, model, text, label), share).toArrow()
    names, clean = found["feature"].to_pylist(), found["clean"].to_pylist()
    scores, harmless = dict(zip(names, found["score"].to_pylist())), dict(zip(names, clean))
    toxic = labelled.filter(F.col(label).cast("int") == 1)
    for _ in range(rounds if scores else 0):
        explained = explained_counts(toxic, model, scores, text).toArrow()  # at most MAX_FEATURES rows
        now = {}
        for f, n in zip(explained["feature"].to_pylist(), explained["toxic"].to_pylist()):
            score = (n + WEIGHT * share) / (n + harmless[f] + WEIGHT)
            if n >= 2 and score >= max(LEAST_SCORE, 1.5 * share):
                now[f] = score
        if now == scores:
            break
        scores = now
    return scores, share


class Scorer:
    def __init__(self, features: dict[str, float], share: float):
        self.features, self.share, self.words = features, share, {}

    def __getstate__(self):
        return {"features": self.features, "share": self.share, "words": {}}

    def word(self, word: str) -> float:
        """Excess over the share of toxic texts, 0 to 1."""
        got = self.words.get(word)
        if got is None:
            best = max((self.features.get(f, 0.0) for f in word_features(word)), default=0.0)
            got = max(0.0, (best - self.share) / (1 - self.share)) if self.share < 1 else best
            if len(self.words) < 200_000:
                self.words[word] = got
        return got

    def text(self, text: str) -> float:
        """Noisy-or of the two worst words."""
        worst = second = 0.0
        for word in set(WORD.findall(text.lower())):
            s = self.word(word)
            if s > second:
                worst, second = (s, worst) if s > worst else (worst, s)
        return 1 - (1 - worst) * (1 - second)


def toxicity(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = MAX_LABELLED, restored: bool = False) -> DataFrame:
    """``doc_id, score`` of every row of ``df`` (and ``restored``, the text that was scored), learned from the texts that ``labels`` (id, label) names."""
    chars = character_counts(df, text).orderBy("trigram").toArrow()  # at most SYMBOLS**3 rows
    model = CharacterModel(chars["trigram"].to_numpy(), chars["n"].to_numpy())
    known = labels.filter(F.col(label).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(label).alias("_label"))
    chosen = cut_lineage(known.orderBy(F.xxhash64("_id"), "_id", "_label").limit(max_labelled))
    # At most max_labelled ids and labels, so texts needn't be moved to find theirs.
    sample = df.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    features, share = learn_features(cut_lineage(sample.select("_text", "_label")), model, "_text", "_label")
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def make():
        scorer = Scorer(features, share)

        def step(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
            read = [model.restore(t or "") for t in batch.column("text").to_pylist()]
            out = [batch.column("doc_id"), pa.array([scorer.text(t) for t in read], pa.float64())]
            return [pa.RecordBatch.from_arrays([*out, pa.array(read, pa.string())] if restored else out, names=["doc_id", "score", *["restored"] * restored])]

        return step

    return map_batches(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double" + ", restored string" * restored)
