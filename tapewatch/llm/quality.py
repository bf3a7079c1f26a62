"""Quality rules as a learned decision list.

Rows get text statistics; sequential covering then learns ordered rules from labelled rows. A rule is grown as a conjunction of threshold conditions by
information gain on one part of the labelled rows, pruned from its end on the other part, and accepted only if it is precise there; what it
covers is then set aside. The list becomes one Spark conditional expression: the first rule that holds rejects, and a row that none holds for is kept.

Learning reads at most ``max_labelled`` labelled rows (those of the smallest id hash); statistics and verdicts cover every row. Null texts have no words. Labels
that are null or whose row is missing are ignored; without labels there are no rules. Repeated rows are judged each. Columns of the input that have the name of a statistic are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.common import cut_lineage, map_batches, slices

MAX_LABELLED = 50_000
WHITE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("word_length", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "mark_share", "digit_share", "distinct_share", "words_per_line", "longest_word")


def _repeat_words(ids: np.ndarray, distinct: int) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    pairs = ids[:-2] * np.int64(distinct) + ids[1:-1]
    if distinct >= 2_000_000:  # else the triple code below would not fit
        pairs = np.unique(pairs, return_inverse=True)[1]
    code = pairs * np.int64(distinct) + ids[2:]
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(code), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), dtype=bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def statistics(text: str) -> tuple:
    """The counts, then the learned rules' features."""
    words = text.encode("utf-8", "replace").split()  # bytes: parted by ASCII white space only
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in WHITE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen, lines, dup = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            lines += 1
            dup += line in seen
            seen.add(line)
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int64, count=n)
    repeat = _repeat_words(ids, len(index))
    upper, size, w = sum(map(str.isupper, text)) if n else 0, max(chars, 1), max(n, 1)
    marks = text.count("!") + text.count("?")
    digits = sum(text.count(c) for c in "0123456789")
    longest = max(map(len, index), default=0)
    return n, chars, symbols, dup, repeat, chars / w, symbols / w, dup / max(lines, 1), repeat / w, upper / size, marks / w, digits / size, len(index) / w, n / max(lines, 1), float(longest)


def measured(batch: pa.RecordBatch, text: str, kept: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns ``kept`` and the statistics of ``text``, a part of the batch at a time, so that a worker holds few texts as Python strings."""
    types = [pa.int64()] * len(COUNTS) + [pa.float64()] * len(FEATURES)
    for rows in slices(batch):
        values = list(zip(*[statistics(t or "") for t in rows.column(text).to_pylist()])) or [()] * len(types)
        yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), *(pa.array(v, t) for v, t in zip(values, types))], names=[*kept, *COUNTS, *FEATURES])


def with_statistics(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add ``COUNTS`` (long) and ``FEATURES`` (double) of every text."""
    names = {*COUNTS, *FEATURES}
    df = df.drop(*[c for c in df.columns if c.lower() in names and c != text])
    kept = [f for f in df.schema.fields if keep_text or f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{c} bigint" for c in COUNTS), *(f"{c} double" for c in FEATURES)])

    def make():
        return lambda batch: measured(batch, text, [f.name for f in kept])

    return map_batches(df, make, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


# --- learning ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        return F.col(self.feature) >= self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:.6g}"


def _covered(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    mask = np.ones(n, dtype=bool)
    for c in rule:
        mask &= c.mask(x)
    return mask


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray, cuts: int) -> tuple[float, Condition | None]:
    """The condition of most information gain over the rows ``inside``."""
    p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
    best: tuple[float, Condition | None] = (0.0, None)
    if not p0 or not n0:
        return best
    base = np.log2(p0 / (p0 + n0))
    for feature in FEATURES:
        values, worse = x[feature][inside], bad[inside]
        order = np.argsort(values, kind="stable")
        values, good_sum, bad_sum = values[order], np.cumsum(~worse[order]), np.cumsum(worse[order])
        # Thresholds between distinct values: quantiles of all rows here and of the bad ones.
        at = np.unique(np.concatenate([np.quantile(values, np.linspace(0, 1, cuts)), np.quantile(values[worse[order]], np.linspace(0, 1, cuts))]))
        low, high = np.searchsorted(values, at, "left"), np.searchsorted(values, at, "right")
        for above, p, n in ((True, p0 - np.where(low, bad_sum[low - 1], 0), n0 - np.where(low, good_sum[low - 1], 0)), (False, np.where(high, bad_sum[high - 1], 0), np.where(high, good_sum[high - 1], 0))):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - base), 0)
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), Condition(feature, above, float(at[k])))
    return best


def learn_list(x: dict[str, np.ndarray], bad: np.ndarray, pruning: np.ndarray, precision: float = 0.9, support: int = 5, cuts: int = 64, conditions: int = 5, rules: int = 24) -> list[list[Condition]]:
    """Sequential covering. ``bad`` marks rows to reject, ``pruning`` the rows held back for pruning and acceptance."""
    n, left, found = len(bad), np.ones(len(bad), dtype=bool), []
    while len(found) < rules:
        inside, rule = left & ~pruning, []
        while len(rule) < conditions:
            gain, condition = _best_condition(x, bad, inside, cuts)
            if condition is None:
                break
            rule.append(condition)
            inside &= condition.mask(x)
        best = (-1.0, 0, [])
        for size in range(len(rule), 0, -1):
            hit = _covered(rule[:size], x, n) & left & pruning
            p, q = int(bad[hit].sum()), int((~bad[hit]).sum())
            worth = (p + 1) / (p + q + 2)
            if p >= support and p >= precision * (p + q) and worth > best[0]:
                best = (worth, p, rule[:size])
        if not best[2]:
            break
        found.append(best[2])
        left &= ~_covered(best[2], x, n)
    return found


def learn_rules(labelled: DataFrame, label: str = "quality", doc_id: str = "doc_id", max_labelled: int = MAX_LABELLED, **options) -> list[list[Condition]]:
    """Rules for rows labelled 0, from rows with statistics that the base test passes; at most ``max_labelled`` rows of the smallest id hash come to the driver."""
    rows = labelled.filter(F.col(label).isNotNull() & ~base_failed()).withColumn("_order", F.xxhash64(F.col(doc_id)))
    taken = rows.select("_order", F.col(label).cast("int").alias("_label"), *FEATURES).orderBy("_order", "_label", *FEATURES).limit(max_labelled).toArrow()
    x = {f: taken[f].to_numpy() for f in FEATURES}
    bad = taken["_label"].to_numpy() == 0
    pruning = taken["_order"].to_numpy().astype(np.int64) % 3 == 0
    return learn_list(x, bad, pruning, **options) if len(bad) else []


def kept(rules: list[list[Condition]]) -> Column:
    """The decision list, base test first, as one conditional expression."""
    verdict = F.when(base_failed(), False)
    for rule in rules:
        holds = F.lit(True)
        for c in rule:
            holds = holds & c.column()
        verdict = verdict.when(holds, False)
    return verdict.otherwise(True)


def keep_good(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows of ``df`` that the list learned from their labels keeps, with the columns of ``df``."""
    known = labels.filter(F.col(label).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(label).alias("_label"))
    # At most MAX_LABELLED ids and labels, so texts needn't be moved to find theirs.
    chosen = cut_lineage(known.orderBy(F.xxhash64("_id"), "_id", "_label").limit(MAX_LABELLED))
    marked = df.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    rules = learn_rules(with_statistics(marked, "_text", keep_text=False), "_label", "_id")
    # Columns get names that no statistic has; the text is sent to the workers once.
    columns = {f"_c{k}": c for k, c in enumerate(df.columns)}
    renamed = df.select(*[F.col(f"`{c}`").alias(k) for k, c in columns.items()])
    judged = with_statistics(renamed, next(k for k, c in columns.items() if c.lower() == text.lower())).filter(kept(rules))
    return judged.select(*[F.col(k).alias(c) for k, c in columns.items()])
