"""Benchmark decontamination with a distributed positional inverted index.

Postings ``row, pos, term`` of the training texts are stored once, for every term that the benchmark has, together with one posting of term ``LENGTH``
per text whose position is the text's number of words. A benchmark window of ``WINDOW`` words is looked up by its terms from the rarest on: the postings of its
rarest term, moved back by the term's place in the item, are the alignments under which the item may occur; the lists of the second rarest, moved
likewise, are intersected with them; the lists of all other terms of the item are intersected with the few that remain. A run of ``WINDOW`` or more
places in a row that are in all lists is an exact phrase match. Proximity matches ask only that the two rarest terms stand nearly as far apart as in the item.

Everything is DataFrame operations. Words are runs of ASCII digits, letters and non-ASCII characters; A-Z are lower-cased. Null and empty texts have no words and no hits.
Repeated rows are judged each, as rows get numbers of their own; items of equal id are looked up each and listed once, a null id is listed as empty. Items
without words are left out; items shorter than a window are one window. Empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.llm.common import ascii_lower, broadcast_if_small, cut_lineage, own_name

WINDOW = 10
#: Term of the posting that holds a text's length.
LENGTH = 0
#: Texts with candidates are told apart from others by so many groups of rows; that bounds what is broadcast for it.
GROUPS = 1 << 18
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text in their own case, null as none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def lowered(word: Column) -> Column:
    return F.when(F.lower(word) == word, word).otherwise(ascii_lower(word))


def benchmark_postings(items: DataFrame, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Item postings ``item, item_id, size, p, term``, and the vocabulary ``word, term`` with the empty word for ``LENGTH``."""
    listed = items.select(F.monotonically_increasing_id().alias("item"), F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), words(F.col(text)).alias("words"))
    exploded = cut_lineage(listed.select("item", "item_id", F.size("words").alias("size"), F.posexplode("words").alias("p", "word")).withColumn("word", lowered(F.col("word"))))
    numbered = exploded.select("word").distinct().select("word", (F.monotonically_increasing_id() + LENGTH + 1).alias("term"))
    length = items.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(LENGTH).cast("bigint").alias("term"))
    vocabulary = cut_lineage(numbered.union(length))
    return cut_lineage(exploded.join(vocabulary, "word").drop("word")), vocabulary


def training_postings(docs: DataFrame, vocabulary: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index ``row, doc_id, pos, term``, written once; ``doc_id`` is only in the posting of a text's length."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.array_append(words(F.col(text)), "").alias("words"))
    each = rows.select("row", "doc_id", F.posexplode("words").alias("pos", "word")).withColumn("word", lowered(F.col("word")))
    found = each.join(broadcast_if_small(vocabulary), "word")
    return cut_lineage(found.select("row", F.when(F.col("term") == LENGTH, F.col("doc_id")).alias("doc_id"), "pos", "term"), compression="zstd")


def anchors(postings: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item, p, term, first, second, alone``: places of the items that are the rarest or second rarest of a window."""
    counted = postings.join(counts, "term", "left").select("item", "size", "p", "term", F.coalesce("n", F.lit(0)).alias("n"))
    starts = F.expr(f"sequence(greatest(0, p - {window - 1}), greatest(0, least(p, size - {window})))")
    placed = counted.withColumn("start", F.explode(starts))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("item", "start").orderBy("n", "p"))).filter("rank <= 2 and n > 0")
    return ranked.groupBy("item", "p", "term").agg(F.max(F.col("rank") == 1).alias("first"), F.max(F.col("rank") == 2).alias("second"), F.max(F.col("size") == 1).alias("alone"))


def aligned(index: DataFrame, places: DataFrame) -> DataFrame:
    """``row, item, delta`` and the flags of the anchor for every posting of an anchor term, moved back by the anchor's place."""
    return index.join(broadcast_if_small(places), "term").select("row", "item", (F.col("pos") - F.col("p")).alias("delta"), "first", "second", "alone")


def phrase_matches(index: DataFrame, postings: DataFrame, places: DataFrame, window: int = WINDOW) -> DataFrame:
    """``row, item, item_id, begin, end``: maximal runs of exactly matching words of at least a window; word places, end exclusive."""
    # A window needs the places of its two rarest terms; a place may be the rarest of one window and the second of another.
    both = aligned(index, places).groupBy("row", "item", "delta").agg(F.max("first").alias("first"), F.count(F.lit(1)).alias("places"), F.max("alone").alias("alone"))
    candidates = cut_lineage(both.filter("(first and places >= 2) or alone").select("row", "item", "delta"))
    group = F.pmod(F.xxhash64("row"), F.lit(GROUPS)).alias("group")
    groups = candidates.select(group).distinct()  # at most GROUPS rows
    near = index.filter(F.col("term") != LENGTH).select("row", "pos", "term", group).join(F.broadcast(groups), "group", "left_semi")
    wanted = candidates.join(postings, "item").select("row", "item", "item_id", "size", "delta", "p", (F.col("p") + F.col("delta")).alias("pos"), "term")
    matched = near.join(wanted, ["row", "pos", "term"])
    by_place = Window.partitionBy("row", "item", "delta").orderBy("p")
    runs = matched.withColumn("run", F.col("p") - F.row_number().over(by_place)).groupBy("row", "item", "item_id", "size", "delta", "run").agg(F.min("pos").alias("begin"), (F.max("pos") + 1).alias("end"))
    return runs.filter(F.col("end") - F.col("begin") >= F.least(F.lit(window), F.col("size"))).select("row", "item", "item_id", "begin", "end")


def proximity_matches(index: DataFrame, postings: DataFrame, window: int = WINDOW, slop: int = 2) -> DataFrame:
    """``row, item, item_id, gap``: texts in which the rarest and second rarest terms of an item's window stand at most ``slop`` words closer or
    farther apart than in the item; the smallest such gap (0: as in the item)."""
    counts = index.filter(F.col("term") != LENGTH).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    moved = cut_lineage(aligned(index, anchors(postings, counts, window)))
    width = slop + 1
    cell = F.floor(F.col("delta") / width)
    left = moved.filter("first").select("row", "item", F.col("delta").alias("d"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell")).distinct()
    right = moved.filter("second").select("row", "item", "delta", cell.alias("cell")).distinct()
    near = left.join(right, ["row", "item", "cell"]).withColumn("gap", F.abs(F.col("d") - F.col("delta"))).filter(F.col("gap") <= slop)
    return near.groupBy("row", "item").agg(F.min("gap").alias("gap")).join(postings.select("item", "item_id").distinct(), "item").select("row", "item", "item_id", "gap")


def build_index(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    postings, vocabulary = benchmark_postings(items, item_id, item_text)
    return training_postings(docs, vocabulary, doc_id, text), postings


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``row, doc_id, n_words, n_hit, items`` for every row of ``docs``: words inside any occurrence of a window, and the sorted ids of the items concerned."""
    index, postings = build_index(docs, items, doc_id, text, item_id, item_text)
    counts = index.filter(F.col("term") != LENGTH).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    places = cut_lineage(anchors(postings, counts, window))
    found = cut_lineage(phrase_matches(index, postings, places, window))
    in_order = Window.partitionBy("row").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("row", "begin", "end").distinct().withColumn("before", F.coalesce(F.max("end").over(in_order), F.lit(0)))
    hit = spans.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("begin", "before"))).cast("bigint").alias("n_hit"))
    listed = found.groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    texts = index.filter(F.col("term") == LENGTH).select("row", "doc_id", F.col("pos").cast("bigint").alias("n_words"))
    return texts.join(hit.join(listed, "row"), "row", "left").select("row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def contaminated_rows(docs: DataFrame, items: DataFrame, keep: bool, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` with hits (``keep``), or those without, with their columns.

    A verdict depends on the text alone, so texts are told apart by their MD5 and no copy of the documents is made. Columns of any name stay as they are.
    """
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    found = contamination(docs.select(digest.alias("_digest"), F.col(text).alias("_text")), items, "_digest", "_text", item_id, item_text, window)
    own = own_name(docs, "_digest")
    hit = cut_lineage(found.filter("n_hit > 0").select(F.col("doc_id").alias(f"{own}_hit")).distinct())
    marked = docs.withColumn(own, digest)
    return marked.join(broadcast_if_small(hit), F.col(own) == F.col(f"{own}_hit"), "left_semi" if keep else "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
