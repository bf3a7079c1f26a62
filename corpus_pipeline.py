"""From raw documents to token ids, one stage after another.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before kept, and returns a table that is written as Parquet and
read again as the next stage's documents. All but the last return the columns that they got. Every stage keeps clean documents: what leaves is what the quality
rules reject, all but the smallest id of each near-duplicate component, and documents with benchmark passages; secrets are replaced inside their texts.

Null and empty texts fail the quality rules, as they have fewer than 50 words. Documents of equal id are judged by their own texts, except that secrets found in one are
replaced in all of that id. Empty tables stay empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tapewatch.llm.bpe import with_token_ids
from tapewatch.llm.common import cut_lineage, table
from tapewatch.llm.decontaminate import contaminated_rows
from tapewatch.llm.nearcopies import near_copies
from tapewatch.llm.quality import keep_good
from tapewatch.llm.secrets import redact, scan
from tapewatch.llm.simhash import keep_representatives

#: What the tokenizer's file leaves to choose: texts are encoded whole, without special tokens of its own.
TOKENIZER = "word_bpe_49k.json"


def quality_rules(spark, docs, sf_dir):
    """Documents that the base test and the learned decision list keep."""
    return keep_good(docs, table(spark, sf_dir, "labels"), label="quality")


def near_dedup(spark, docs, sf_dir):
    """The document of the smallest id of each component of near copies: five-word shingles, Jaccard similarity of 0.8 or more.

    Candidates come from covering SimHash, then from min-hashing for what covering masks of three bits can't reach; all are compared exactly.
    """
    return keep_representatives(docs, find=near_copies)


def decontamination(spark, docs, sf_dir):
    """Documents in which no benchmark window occurs."""
    return contaminated_rows(docs, table(spark, sf_dir, "benchmark"), keep=False)


def secret_scan(spark, docs, sf_dir):
    """All documents, with every confirmed secret replaced and ``n_chars`` counted anew."""
    clean = redact(docs, scan(docs))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns) if "n_chars" in docs.columns else clean


def bpe_encoding(spark, docs, sf_dir):
    """The columns of documents, the number of ids, and the ids as little-endian unsigned 32-bit integers."""
    return with_token_ids(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("secret scans", secret_scan), ("bpe encoding", bpe_encoding)]

#: No SQL: the learned rules, XXH64 fingerprints and byte-pair merges are beyond it. Tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
