"""Secret scans with a random forest that removes false positives.

Candidates are long tokens that are no plain words, and values of any kind that are assigned to a credential's name or stand as the password of an address: one finding
per different token of a text, with its first own place, how often it is a candidate there, and the words around it (where it is assigned, if it is so anywhere). A random forest judges them by
length, character classes and the transitions between them, distinct characters, coverage by words that the corpus uses often, the path or
address around them, and the words beside them. It is grown from labelled findings: a table of the caller's own, or ``silver_labels``, rules that label what is
beyond doubt (issuers' fixed formats and credentials assigned by name against card-like numbers, plain upper-case words and UUIDs) and leave the rest to the forest.

Everything is DataFrame, SQL and Spark ML operations. Null and empty texts have no findings. Repeated rows have their findings each. Growing reads at most
``max_labelled`` labelled findings (those of the smallest hash); counts and verdicts cover all. Without findings of both labels no forest is grown, and a
finding is a secret if its label says so. Empty tables give no findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.llm.common import broadcast_if_small, cut_lineage, own_name

MAX_LABELLED = 20_000
CONTEXT = 48
#: A token of at least 16 characters that is not one lower-case or capitalised word.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?![A-Z]?[a-z]+(?![A-Za-z0-9+/_-]))[A-Za-z0-9+/_-]{16,}={0,2}"
#: Names that credentials are assigned to, and the fixed formats of well-known issuers.
NAMES = r"(?i)(passw(or)?d|passwd|pwd|secret|token|api_?key|access_?key|private_?key|auth|bearer|credential)s?$"
ISSUED = r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36,}$|^sk_(live|test)_[A-Za-z0-9]{16,}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^glpat-[A-Za-z0-9_-]{20}$"
#: A value assigned to such a name: in quotes, right after the sign, or with a digit; and the password of an address.
ASSIGNED = r"(?i)(?:passw(?:or)?d|passwd|pwd|secret|token|api_?key|access_?key|private_?key|credential)s?[\"']?(?:\s{0,4}[:=]\s{0,4}[\"']|=|\s{0,4}[:=]\s{0,4}(?=[^\s\"'`]*[0-9]))([^\s\"'`]{5,}[^\s\"'`.,;:!?)\]}])"
USER_INFO = r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s/:@]*:([^\s/@]{6,})(?=@)"
#: What stands for a value.
PLACEHOLDER = r"(?i)^[$%]?[{(<\[]|^%\w+%$|^\$\w+$|^(.)\1+$|^(null|none|true|false|undefined|required|changeme)$"
NO_SECRET = r"^[0-9_-]+$|^[A-Z]+$|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|^[_/=+-]+$|^[A-Za-z]+([-_/][A-Za-z]+)+$"
FEATURES = ["length", "digit_share", "upper_share", "lower_share", "other_share", "hex_only", "transitions", "distinct_share", "vowel_share", "longest_letters", "dictionary_share", "in_path", "in_address", "assigned", "quoted", "before_rate", "after_rate"]


def _occurrences(rows: DataFrame, pattern: str, group: int, assigned: bool) -> DataFrame:
    """``row, doc_id, candidate, start, before, after, assigned_here`` per match; the value is the end of the match."""
    held = rows.filter(F.col("text").rlike(pattern)).select(
        "row", "doc_id", F.split("text", pattern, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("hits"), F.regexp_extract_all("text", F.lit(pattern), F.lit(group)).alias("values")
    )
    at = lambda c, k: F.coalesce(F.get(F.col(c), k), F.lit(""))

    def one(value: Column, k: Column) -> Column:
        name = F.substring(at("hits", k), F.lit(1), F.length(at("hits", k)) - F.length(value))
        before = F.concat(at("gaps", k - 1), at("hits", k - 1), at("gaps", k), name)
        after = F.concat(at("gaps", k + 1), at("hits", k + 1), at("gaps", k + 2))
        span = F.length(at("gaps", k)) + F.length(at("hits", k))
        return F.struct(k.alias("k"), span.cast("bigint").alias("span"), value.alias("candidate"), F.substring(before, F.greatest(F.lit(1), F.length(before) - CONTEXT + 1), F.lit(CONTEXT)).alias("before"), F.substring(after, 1, CONTEXT).alias("after"))

    found = held.select("row", "doc_id", F.inline(F.transform("values", one)))
    end = F.sum("span").over(Window.partitionBy("row").orderBy("k"))  # a window holds one text's matches
    return found.withColumn("start", end - F.length("candidate")).select("row", "doc_id", "candidate", "start", "before", "after", F.lit(assigned).alias("assigned_here"))


def candidates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row, doc_id, candidate, start, times, before, after``: code-point place of the first occurrence and the text around it."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    every = _occurrences(rows, CANDIDATE, 0, False).union(_occurrences(rows, ASSIGNED, 1, True)).union(_occurrences(rows, USER_INFO, 1, True))
    best = F.min(F.struct(~F.col("assigned_here"), "start", "before", "after")).alias("best")
    found = every.groupBy("row", "doc_id", "candidate").agg(F.min("start").alias("start"), F.count_distinct("start").alias("times"), best)
    return found.select("row", "doc_id", "candidate", "start", "times", "best.before", "best.after")


def silver_labels(findings: DataFrame) -> DataFrame:
    """Add ``label``: 1 for fixed formats and named assignments, 0 for what cannot be a secret, else null."""
    named = F.col("before").rlike(r"[:=]\s*[\"']?$") & F.col("before_word").rlike(NAMES)
    user = F.col("before").rlike(r"://[^\s/:@]*:$") & F.col("after").startswith("@")
    never = F.col("candidate").rlike(NO_SECRET) | F.col("candidate").rlike(PLACEHOLDER)
    return findings.withColumn("label", F.when(F.col("candidate").rlike(ISSUED), 1).when(never, 0).when(named | user, 1))


def _share(pattern: str) -> Column:
    return F.length(F.regexp_replace("candidate", pattern, "")) / F.col("length")


def with_neighbours(findings: DataFrame) -> DataFrame:
    return findings.withColumn("before_word", F.lower(F.regexp_extract("before", r"([A-Za-z_]+)[^A-Za-z_]*$", 1))).withColumn("after_word", F.lower(F.regexp_extract("after", r"^[^A-Za-z_]*([A-Za-z_]+)", 1)))


def with_shape(findings: DataFrame) -> DataFrame:
    """The features that a finding has by itself."""
    runs = F.regexp_extract_all("candidate", F.lit("[A-Za-z]+"), F.lit(0))
    changes = F.regexp_count("candidate", F.lit(r"(?<=[0-9])(?=[^0-9])|(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"))
    flag = lambda c: c.cast("double")
    return (
        findings.withColumn("length", F.length("candidate").cast("double"))
        .withColumn("digit_share", _share("[^0-9]"))
        .withColumn("upper_share", _share("[^A-Z]"))
        .withColumn("lower_share", _share("[^a-z]"))
        .withColumn("other_share", _share("[A-Za-z0-9]"))
        .withColumn("hex_only", flag(F.col("candidate").rlike("^([0-9a-f]+|[0-9A-F]+)$")))
        .withColumn("transitions", changes / F.col("length"))
        .withColumn("distinct_share", F.size(F.array_distinct(F.split("candidate", ""))) / F.col("length"))
        .withColumn("vowel_share", _share("[^aeiouAEIOU]"))
        .withColumn("longest_letters", F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)).cast("double"))
        .withColumn("in_path", flag(F.col("before").rlike(r"[/\\.]$") | F.col("after").rlike(r"^[/\\.][A-Za-z0-9]") | F.col("candidate").contains("/")))
        .withColumn("in_address", flag(F.col("before").rlike(r"[a-z]+://\S*$")))
        .withColumn("assigned", flag(F.col("before").rlike(r"[:=]\s*[\"']?$")))
        .withColumn("quoted", flag(F.col("before").rlike("[\"'`]$")))
    )


def with_dictionary(findings: DataFrame, texts: DataFrame, text: str = "text", at_least: int = 20) -> DataFrame:
    """Add ``dictionary_share``: the share of a candidate in runs of letters that are words which all texts together use at least so often."""
    runs = findings.select("row", "candidate", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    asked = broadcast_if_small(cut_lineage(runs.select("word").distinct()))
    used = texts.select(F.explode(F.split(F.lower(F.col(text)), "[^a-z]+")).alias("word")).filter("length(word) >= 3").join(asked, "word", "left_semi")
    known = used.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= at_least).select("word")
    covered = runs.join(known, "word").groupBy("row", "candidate").agg(F.sum(F.length("word")).alias("covered"))
    return findings.join(covered, ["row", "candidate"], "left").withColumn("dictionary_share", F.coalesce("covered", F.lit(0)) / F.length("candidate")).drop("covered")


def with_neighbour_rates(findings: DataFrame, labelled: DataFrame, weight: float = 4.0) -> DataFrame:
    """Add the smoothed shares of secrets among labelled findings with the same word before, and after; a third stands for unknown words."""
    for word, rate in (("before_word", "before_rate"), ("after_word", "after_rate")):
        rates = labelled.groupBy(word).agg(((F.sum("label") + weight / 3) / (F.count(F.lit(1)) + weight)).alias(rate))
        findings = findings.join(broadcast_if_small(rates), word, "left").withColumn(rate, F.coalesce(rate, F.lit(1 / 3)))
    return findings


def grow_forest(labelled: DataFrame, max_labelled: int = MAX_LABELLED, trees: int = 24, depth: int = 8, seed: int = 7):
    """A random forest from at most ``max_labelled`` labelled findings with all features, those of the smallest hash; None without both labels."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    sample = cut_lineage(labelled.select(F.col("label").cast("double").alias("label"), *FEATURES, F.xxhash64("doc_id", "candidate", "start").alias("order")).orderBy("order").limit(max_labelled))
    if sample.select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(vectors)


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """``row, doc_id, candidate, start, times, score, secret`` for every candidate of every text.

    ``labelled`` may give labelled findings as ``doc_id, candidate, label``; else silver labels are used.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    found = cut_lineage(with_neighbours(candidates(df, doc_id, text)))
    shaped = with_dictionary(with_shape(found), df, text)
    if labelled is None:
        shaped = silver_labels(shaped)
    else:
        own = labelled.groupBy("doc_id", "candidate").agg(F.max("label").cast("int").alias("label"))
        shaped = shaped.join(own, ["doc_id", "candidate"], "left")
    shaped = cut_lineage(shaped)
    known = shaped.filter("label is not null")
    rated = cut_lineage(with_neighbour_rates(shaped, known))
    forest = grow_forest(rated.filter("label is not null"))
    if forest is None:
        judged = rated.withColumn("score", F.coalesce(F.col("label"), F.lit(0)).cast("double"))
    else:
        judged = forest.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rated)).withColumn("score", vector_to_array("probability")[1])
    return judged.select("row", "doc_id", "candidate", "start", "times", "score", (F.col("score") >= threshold).alias("secret"))


def redact(df: DataFrame, findings: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every occurrence of a text's secrets replaced; columns, of any name, and rows stay."""
    own, held = own_name(df, "_id"), own_name(df, "_secrets")
    secrets = findings.filter("secret").groupBy(F.col("doc_id").alias(own)).agg(F.array_sort(F.collect_set("candidate"), lambda a, b: F.length(b) - F.length(a)).alias(held))
    joined = df.join(broadcast_if_small(cut_lineage(secrets)), F.col(doc_id).eqNullSafe(F.col(own)), "left")
    clean = F.aggregate(held, F.col(text), lambda t, s: F.replace(t, s, F.lit(mark)))
    replaced = F.when(F.col(held).isNull(), F.col(text)).otherwise(clean).alias(text)
    return joined.select(*(replaced if c == text else F.col(f"`{c}`") for c in df.columns))
