"""Personal data: fixed base patterns, and bootstrapped contextual extraction beyond them.

The spans of the base patterns are the seed entities. A seed induces two lexical patterns of its kind: the word before it, for example ``phone:``, and its own
shape, for example ``+9 (999) 999-9999``. Every text is also scanned for slots: identifiers that are loosely written (spaced, bracketed, spelled out) or that the base
patterns lose, as a phone number right before a card number. Patterns and instances form a bipartite graph, scored in rounds: a seed has score 1,
another instance the noisy-or of its patterns, and a pattern the share of scored instances among all its occurrences: of a word, wherever it stands in the whole corpus, so that a
common word that happens to stand before some seeds scores low; of a shape, among all slots. Slots with patterns of high score become spans of that kind. Base spans
always stay; a slot that overlaps one is dropped.

Null texts count as empty. Any length is scanned whole, by patterns that take linear time. Repeated rows are scanned each. Without seeds nothing is added. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.llm.common import BROADCAST_ROWS, broadcast_if_small, cut_lineage, map_batches

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: A pattern needs so many different seeds and this score; an instance this score.
MIN_SEEDS, PATTERN_SCORE, INSTANCE_SCORE = 3, 0.6, 0.6
#: Added to the occurrences of a pattern's word, so that rare words don't score high.
SMOOTHING = 1.0
#: Words that a task counts before it hands on what it has.
COUNTED = 400_000

# Base patterns, equal to the plain ones in what they match; possessive parts and look-behinds only keep them linear.
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Slots: looser forms of each kind.
LOOSE = {
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?[\[(]?\.[\])]? ?[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9]{3,6}(?:[ .-][0-9]{2,6}){2,4}(?![0-9])|(?<![0-9])[0-9]{12,19}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9(+])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}\(?[0-9]{2,5}\)?){1,4}(?![0-9])|(?<![0-9])[0-9]{8,11}(?![0-9])"),
}
# Loose addresses are read from their "at": the local part backwards, the host forwards.
_AT = r" ?(?:@|[\[(]at[\])])"
#: After a blank, a host doesn't go on with the local part of the next address.
_NEXT = rf"(?![\w.+-]++(?:{_AT}| at [\w-]++ dot ))"
NEAR_AT = re.compile(rf"{_AT} ?[\w-]++(?: ?(?:\.|[\[(]dot[\])])(?: {_NEXT})?[\w-]++)+| at [\w-]++(?: dot [\w-]++)+", re.I)
LOCAL = re.compile(r"[\w.+-]")
NUMBERS = re.compile(r"[0-9][0-9 ()\[\].,/-]{5,}[0-9]")
#: A longer word before a slot counts by its end.
WORD = 40
WORD_BEFORE = re.compile(rf"(\S{{1,{WORD}}})[ \t]*$")
#: Places in a word after which a slot may start: what stands before is a context glued to its value, as ``ip=``.
GLUED = re.compile(r"\S(?=[(+])|[^\W\d](?=\d)|[^\w\s](?=[\w.])")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping spans per kind, in code points, ends exclusive; matches that fail their test are dropped."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in EMAIL_LOCAL:
            begin -= 1
        host = EMAIL_HOST.match(text, at + 1) if begin < at else None
        if host:
            found["email"].append((begin, host.end()))
            free = host.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found["ip"].append(m.span())
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
    for m in PHONE.finditer(text):
        if 8 <= sum(map(str.isdigit, m[0])) <= 15:
            found["phone"].append(m.span())
    return found


def _word_before(text: str, at: int) -> str | None:
    m = WORD_BEFORE.search(text[max(0, at - 48) : at])
    return m[1].lower() if m else None


def _addresses(text: str, known: list[tuple[int, int]]):
    """Spans of loose addresses beside the ``known`` ones; a local part reaches back to the end of the address before, at most."""
    free, at = 0, 0
    known = iter(known)
    taken = next(known, None)
    while m := NEAR_AT.search(text, at):
        while taken and taken[1] <= m.start():
            free, taken = max(free, taken[1]), next(known, None)
        if taken and taken[0] <= m.start():
            at = taken[1]
            continue
        begin = m.start()
        while begin > free and LOCAL.match(text[begin - 1]):
            begin -= 1
        if begin < m.start():
            yield begin, m.end()
            free = m.end()
        at = m.end()


def shape(kind: str, value: str) -> str:
    """Digits as 9 and letters as a; of addresses, whose parts vary in length, once per run."""
    out = re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "9", value))
    return re.sub(r"(.)\1+", r"\1", out) if kind in ("email", "ip") else out


def slots(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple]:
    """``kind, start, end, value, before, shape, seed`` of seeds and of loose forms that touch no base span."""
    out, taken = [], []
    for kind in KINDS:
        for a, b in base[kind]:
            taken.append((a, b))
            out.append((kind, a, b, text[a:b].lower(), _word_before(text, a), shape(kind, text[a:b]), True))
    taken.sort()
    # Loose number forms lie inside runs of digits and their separators.
    runs = [(m.start() - (text[m.start() - 1 : m.start()] in ("(", "+")), m.end()) for m in NUMBERS.finditer(text)]
    for kind in KINDS:
        places = _addresses(text, base["email"]) if kind == "email" else (m.span() for a, b in runs for m in LOOSE[kind].finditer(text, a, b))
        last = -1
        for a, b in places:
            if a < last or any(x < b and a < y for x, y in taken):
                continue
            last, value = b, text[a:b]
            digits = sum(map(str.isdigit, value))
            if kind == "phone" and not 7 <= digits <= 15 or kind == "card" and not (12 <= digits <= 19 and luhn(re.sub("[^0-9]", "", value))):
                continue
            out.append((kind, a, b, value.lower(), _word_before(text, a), shape(kind, value), False))
    return out


SLOT = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("before", pa.string()), ("shape", pa.string()), ("seed", pa.bool_())])
SCANNED = "doc_id {}, base array<struct<kind:string,start:bigint,end:bigint>>, slots array<struct<kind:string,start:bigint,end:bigint,value:string,before:string,shape:string,seed:boolean>>"


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, base, slots`` per row."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def make():
        def step(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
            base, found = [], []
            for t in batch.column("text").to_pylist():
                spans = base_spans(t or "")
                base.append([{"kind": k, "start": a, "end": b} for k in KINDS for a, b in spans[k]])
                found.append([dict(zip(SLOT.names, x)) for x in slots(t or "", spans)])
            return [pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, pa.list_(span)), pa.array(found, pa.list_(SLOT))], names=["doc_id", "base", "slots"])]

        return step

    return map_batches(rows, make, SCANNED.format(rows.schema["doc_id"].dataType.simpleString()))


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``before, total``: how often each lower-case word, or the part of a word that a value may be glued to, occurs in all texts."""

    def run(batches):
        total: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["before", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                t = t or ""
                total.update("\n".join([w[-WORD:] for w in t.split()]).lower().split())
                for m in GLUED.finditer(t):
                    total[_word_before(t, m.end())] += 1
                    if len(total) > COUNTED:
                        yield out()
                        total.clear()
                if len(total) > COUNTED:
                    yield out()
                    total.clear()
        if total:
            yield out()

    return df.select(text).mapInArrow(run, "before string, n bigint").groupBy("before").agg(F.sum("n").alias("total"))


def patterns_of(found: DataFrame) -> DataFrame:
    """A row per slot and pattern, word patterns as ``w:...`` and shapes as ``s:...``."""
    both = F.array_compact(F.array(F.concat(F.lit("w:"), "before"), F.concat(F.lit("s:"), "shape")))
    return found.withColumn("pattern", F.explode(both)).drop("before", "shape")


def score_graph(found: DataFrame, words: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Patterns ``pattern, kind, seeds, score`` and instances ``kind, value, score`` after the last round.

    ``found`` has a row per slot and pattern (``kind, value, pattern, seed``), ``words`` the occurrences of each word. Occurrences are added up per edge before anything is joined.
    """
    edges = found.groupBy("pattern", "kind", "value").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("seed").cast("int")).alias("seed"))
    support = edges.groupBy("pattern", "kind").agg(F.sum("seed").alias("seeds"), F.sum("n").alias("slots")).filter(F.col("seeds") >= MIN_SEEDS)
    # What isn't found at MIN_SEEDS different seeds of a kind never becomes a pattern. The few patterns go to the many edges, as
    # one shape may hold most edges of its kind.
    kept = cut_lineage(edges.join(broadcast_if_small(cut_lineage(support)), ["pattern", "kind"]))
    asked = kept.select("pattern", "kind", "slots").distinct()
    total = words.select(F.concat(F.lit("w:"), "before").alias("pattern"), "total")
    # A word occurs at least as often as it stands before slots.
    counted = asked.filter("pattern like 'w:%'").join(total, "pattern", "left").select("pattern", "kind", F.greatest("total", "slots").alias("total"))
    known = cut_lineage(counted.union(asked.filter("pattern like 's:%'").select("pattern", "kind", "slots")))
    instances, to_edges = None, F.broadcast if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else (lambda df: df)
    for _ in range(rounds):
        scored = kept.withColumn("score", F.col("seed").cast("double")) if instances is None else kept.join(instances, ["kind", "value"])
        patterns = scored.groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("mass"), F.max("seeds").alias("seeds"))
        patterns = patterns.join(known, ["pattern", "kind"]).select("pattern", "kind", "seeds", F.least(F.lit(1.0), F.col("mass") / (F.col("total") + SMOOTHING)).alias("p"))
        instances = kept.join(to_edges(patterns.select("pattern", "kind", "p")), ["pattern", "kind"]).groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("p")))))).alias("noisy_or"), F.max("seed").alias("is_seed"))
        instances = instances.select("kind", "value", F.when(F.col("is_seed") == 1, 1.0).otherwise(F.col("noisy_or")).alias("score"))
    return patterns.withColumnRenamed("p", "score"), instances


def personal_spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, base, added`` per row: base spans in order of kind and place, and the spans that high-confidence patterns discover."""
    rows = cut_lineage(scan(df, doc_id, text).withColumn("row", F.monotonically_increasing_id()))
    found = patterns_of(rows.select("row", F.inline("slots")))
    patterns, instances = score_graph(found, word_counts(df, text))
    strong = broadcast_if_small(cut_lineage(patterns.filter(F.col("score") >= PATTERN_SCORE).select("pattern", "kind")))
    believed = instances.filter(F.col("score") >= INSTANCE_SCORE).select("kind", "value")
    new = found.filter("not seed").join(strong, ["pattern", "kind"]).join(believed, ["kind", "value"])
    added = new.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("kind", "start", "end"))).alias("added"))
    return rows.join(added, "row", "left").select("doc_id", "base", F.coalesce("added", F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint>>)")).alias("added"))
