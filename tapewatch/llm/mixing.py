"""Mixing sources to target weights by Pareto order sampling.

A source with target T and S words in all is due r = T / S copies of each document: floor(r) certain whole copies, and one more with probability p, the rest of r (times the document's
``importance``, at most 1). Documents are ranked by random odds divided by inclusion odds, u / (1 - u) * (1 - p) / p with u hashed from the id, and those of lowest rank are taken until their words reach what the
certain copies leave of the target. What the next document in rank would exceed is filled by later documents that fit, in further passes over the ranks.

No ranking is held in one place: a pass finds where running sums cross the target from histograms of ranks (``CELLS`` cells a source, halved further while a cell holds more than
``SORTED`` rows), and only the last cell is sorted.

Documents of equal id have equal ranks and are taken or left together. Null texts have size 0, and a size of 0 is taken 0 times. A null source is a source of its own. A null id counts as empty. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.llm.common import BROADCAST_ROWS, broadcast_if_small, cut_lineage
from tapewatch.llm.ordered import running

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
CELLS, SORTED, FILLS = 4096, 10_000, 2


def word_count(text: Column) -> Column:
    """Words parted by ASCII white space; a null text has none."""
    # A word ends where white space follows or the text ends: blanks are folded to one, and the gaps counted.
    folded = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return F.when(F.coalesce(folded, F.lit("")) == "", 0).otherwise(F.length(folded) - F.length(F.translate(folded, " ", "")) + 1).cast("bigint")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` from one row per source: ``share`` times all words dealt by weight (repeating over the sources in code-point order, null last),
    no target above ``most`` times its source; what is above is dealt to the others by weight until none is."""
    lead = F.struct(F.col("source").isNull(), "source")
    placed = running(sizes.select(F.lit(0).cast("bigint").alias("_all"), "source", "source_size"), "_all", [lead], [lead], keep=["source", "source_size"])
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("seq") - 1) % len(weights) + 1).cast("int")).cast("double")
    placed = cut_lineage(placed.select("source", "source_size", weight.alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap")))
    total = placed.agg(F.sum("source_size")).head()[0] or 0
    level, full = None, F.lit(False)
    while True:
        capped, open_weight = placed.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w")))).head()
        after = (share * total - (capped or 0.0)) / open_weight if open_weight else level
        if after is None or after == level:
            break
        level, full = after, F.col("w") * F.lit(after) > F.col("cap")
    return placed.select("source", "source_size", (F.lit(0.0) if level is None else F.when(full, F.col("cap")).otherwise(F.col("w") * F.lit(level))).alias("target"))


def _crossings(ranked: DataFrame, budgets: DataFrame, cells: int, exact: int, few) -> DataFrame:
    """``key, reached, words``: the highest rank up to which the running words of ``ranked`` (``key, rank, size``) stay within the source's ``due`` of ``budgets``, and these words."""
    left, done = budgets.select("key", "due", F.lit(0.0).alias("least"), F.lit(1.0).alias("last"), F.lit(0).cast("bigint").alias("before")), []
    by_cell, by_rank = Window.partitionBy("key").orderBy("cell"), Window.partitionBy("key").orderBy("rank")
    over = F.col("words") > F.col("due")
    while True:
        inside = ranked.join(few(left), "key").filter("rank between least and last")
        cell = F.least(F.floor((F.col("rank") - F.col("least")) / (F.col("last") - F.col("least")) * cells), F.lit(cells - 1))
        sums = inside.groupBy("key", "due", "before", cell.alias("cell")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min("rank").alias("least"), F.max("rank").alias("last"))
        sums = sums.withColumn("words", F.col("before") + F.sum("size").over(by_cell))  # at most ``cells`` rows a source
        step = cut_lineage(sums.groupBy("key", "due").agg(
            F.max(F.when(~over, F.struct("last", "words"))).alias("under"),
            F.min(F.when(over, F.struct("cell", "least", "last", "n", (F.col("words") - F.col("size")).alias("before")))).alias("open"),
        ))
        done.append(step.select("key", F.col("under.last").alias("reached"), "under.words"))
        opened = step.filter("open.least < open.last").select("key", "due", "open.*").drop("cell")
        small = ranked.join(few(opened.filter(F.col("n") <= exact)), "key").filter("rank between least and last")
        small = small.groupBy("key", "due", "before", "rank").agg(F.sum("size").alias("size")).withColumn("words", F.col("before") + F.sum("size").over(by_rank))
        done.append(small.filter(~over).groupBy("key").agg(F.max("rank").alias("reached"), F.max("words").alias("words")))
        left = opened.filter(F.col("n") > exact).drop("n")
        if left.isEmpty():
            every = done[0]
            for part in done[1:]:
                every = every.union(part)
            return every.groupBy("key").agg(F.max("reached").alias("reached"), F.max("words").alias("words"))


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _rank(doc_id: Column, importance: Column, p: Column, seed: str) -> Column:
    """Random odds o over inclusion odds as o / (1 + o), from 0 (certain) to below 1; null if the document can't be drawn."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10).cast("bigint") + 0.5) / float(1 << 52)
    chance = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p * F.coalesce(importance, F.lit(1.0))))
    odds = u / (1 - u) * ((1 - chance) / chance)
    return F.when(chance > 0, odds / (1 + odds))


class Mix:
    """What a mix takes: ``sources`` has one row per source, with its target, certain copies and the bounds of its draw. Made by ``plan_mix``."""

    def __init__(self, sources: DataFrame, columns: tuple, importance: Column, seed: str):
        self.sources, self.columns, self.importance, self.seed = sources, columns, importance, seed

    def rows(self, df: DataFrame) -> DataFrame:
        """``doc_id, size, source, source_size, target, copies, taken`` of every row of ``df``."""
        doc_id, text, source = self.columns
        own = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), _key(F.col(source)).alias("key"), word_count(F.col(text)).alias("size"), self.importance.alias("importance"))
        return self._decided(own).select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))

    def documents(self, df: DataFrame) -> DataFrame:
        """The rows of ``df``, all columns, each as often as the mix takes it."""
        doc_id, text, source = self.columns
        packed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(doc_id).alias("doc_id"), _key(F.col(source)).alias("key"), word_count(F.col(text)).alias("size"), self.importance.alias("importance"))
        return self._decided(packed).select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")

    def _decided(self, rows: DataFrame) -> DataFrame:
        joined = rows.join(broadcast_if_small(self.sources), "key").withColumn("rank", _rank(F.col("doc_id"), F.col("importance"), F.col("p"), self.seed))
        return joined.withColumn("copies", F.col("whole") + F.expr("coalesce(exists(bounds, b -> rank <= b.reached and size <= b.most), false)").cast("bigint"))


def plan_mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, importance: Column | None = None, seed: str = "mix", cells: int = CELLS, exact: int = SORTED, fills: int = FILLS) -> Mix:
    """The ``Mix`` of ``df``: sources get their ``targets``; ``importance`` (a double, 1 if none) raises or lowers a document's chance within its source."""
    importance = F.lit(1.0) if importance is None else importance
    docs = cut_lineage(df.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), importance.alias("importance")))
    due = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    few = F.broadcast if due.count() <= BROADCAST_ROWS else lambda x: x  # tables of one row per source
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    due = due.withColumn("whole", F.floor(rate)).withColumn("p", rate - F.floor(rate)).withColumn("due", F.col("target") - F.col("whole") * F.col("source_size"))
    state = cut_lineage(due.select(_key(F.col("source")).alias("key"), "source_size", "target", "whole", "p", "due", F.lit(-1.0).alias("reached"), F.expr("cast(array() as array<struct<reached: double, most: double>>)").alias("bounds")))
    ranked = docs.select(_key(F.col("source")).alias("key"), "doc_id", "size", "importance").join(few(state.select("key", "p")), "key")
    ranked = cut_lineage(ranked.select("key", "size", _rank(F.col("doc_id"), F.col("importance"), F.col("p"), seed).alias("rank")).filter("rank is not null"))
    for k in range(1 + fills):
        # The first pass takes any size; what it leaves is for later documents that fit.
        open_rows = ranked.join(few(state.select("key", F.col("due").alias("fits"), F.col("reached").alias("passed"))), "key").filter("rank > passed" + (" and size <= fits" if k else ""))
        found = _crossings(open_rows.select("key", "rank", "size"), state.select("key", "due"), cells, exact, few)
        state = state.join(few(found.withColumnRenamed("reached", "now")), "key", "left")
        bound = F.struct(F.coalesce("now", "reached").alias("reached"), (F.col("due") if k else F.lit(float("inf"))).alias("most"))
        state = cut_lineage(state.select("key", "source_size", "target", "whole", "p", (F.col("due") - F.coalesce("words", F.lit(0))).alias("due"), F.coalesce("now", "reached").alias("reached"), F.concat("bounds", F.array(bound)).alias("bounds")))
    return Mix(state.select("key", "source_size", "target", "whole", "p", "bounds"), (doc_id, text, source), importance, seed)
