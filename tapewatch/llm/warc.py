"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Reading never trusts a magic string by itself. Tasks cut their split of an archive at every ``WARC/1.``, parse what follows as a header and emit a candidate: where a
record may start, and where its successor must then start. Inside a split candidates are linked to their successors at once (a forest, numbered so that
"lies on the chain from" is an interval test); between splits pointer jumping from the start of each file, doubling its reach every round, finds the one
candidate by which the chain enters each split. Only candidates on that chain are records, so magic inside payloads is rejected, complete embedded records
included. Archives may be plain (then Spark splits them) or compressed.

A payload that itself holds the magic comes in several pieces; those of true records are put together in a second pass. Where the chain of a file breaks, the
records before the break are returned, and one of type ``broken`` at the break (its offset, all else null); a record that ends beyond its file is not a record. Headers may have any length;
one that holds the magic itself must lie in one split (the writer escapes it). Null texts are empty payloads. Pages without id are responses of their own. Repeated pages are written each. Empty tables give empty archives and no records.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.llm.common import broadcast_if_small, cut_lineage

MAGIC = b"WARC/1."
END = "\r\n\r\n"
#: Payloads shorter than this are never replaced by a reference.
REVISIT_BYTES = 1000
#: Bytes of a file that pieces and records are matched by.
CELL = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- writing -----------------------------------------------------------------------------------------------------------


def with_record_types(pages: DataFrame, page_id: str = "page_id", html: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """``page_id, body, payload_digest, payload_bytes, refers_to`` and the other columns: of equal payloads the page of the largest id is the response."""
    body = F.coalesce(F.col(html), F.lit("")).alias("body")
    known = pages.select(F.col(page_id).alias("page_id"), body).select("page_id", F.sha1("body").alias("payload_digest"), F.octet_length("body").cast("bigint").alias("payload_bytes"))
    same = known.filter(F.col("page_id").isNotNull() & (F.col("payload_bytes") >= least)).groupBy("payload_digest", "payload_bytes")
    winners = cut_lineage(same.agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    full = pages.select("*", body).withColumn("payload_digest", F.sha1("body")).withColumn("payload_bytes", F.octet_length("body").cast("bigint"))
    joined = full.join(broadcast_if_small(winners), ["payload_digest", "payload_bytes"], "left")
    return joined.withColumn("refers_to", F.when(F.col("winner") != F.col(page_id), F.col("winner"))).drop("winner")


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", compression: str = "gzip", date: str = "1970-01-01T00:00:00Z") -> None:
    """One WARC record per page, one archive per writing task. ``compression`` is ``gzip`` or ``none``."""
    typed = with_record_types(pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")))
    # Line ends in an address would end its header line; the magic in it would look like a record.
    address = F.replace(F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x1F\x7F]", " "), F.lit("WARC/1."), F.lit("WARC%2F1."))
    revisit = F.col("refers_to").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    content = F.when(revisit, "").otherwise(F.col("body"))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        F.coalesce(line("WARC-Record-ID", name(F.col("page_id"))), F.lit("")),
        line("WARC-Target-URI", address),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        F.coalesce(F.concat(line("WARC-Refers-To", name(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE))), F.lit("")),
        line("Content-Type", F.lit("text/html;charset=utf-8")),
        line("Content-Length", F.octet_length(content).cast("string")),
        F.lit("\r\n"),
        content,
    )
    typed.select(record.alias("value")).write.option("lineSep", END).option("compression", compression).text(folder)


# --- reading -----------------------------------------------------------------------------------------------------------

CANDIDATES = "path string, split bigint, total bigint, rel bigint, next bigint, exit bigint, pre bigint, post bigint, type string, record_id string, uri string, declared_digest string, declared_bytes bigint, refers_to string, length bigint, head bigint, digest string, payload binary"
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
CANDIDATE_SCHEMA = pa.schema([(n, _TYPES[t]) for n, t in (x.split() for x in CANDIDATES.split(", "))])


def pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The archives cut at every magic string, in order within a split; a piece that starts in a split is read to its end."""
    text = spark.read.option("lineSep", MAGIC.decode()).text(folder)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("raw"))


def parse_header(data: bytes) -> tuple[int, dict[str, str]] | None:
    """The length of a header without its magic, blank line included, and its fields; None if this is no record's header."""
    end = data.find(b"\r\n\r\n")
    if end < 0 or data[1:3] != b"\r\n":
        return None
    fields = {}
    for line in data[3:end].split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[key.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return (end + 4, fields) if fields.get("content-length", "").isascii() and fields.get("content-length", "").isdigit() else None


class SplitReader:
    """Candidates of one split, from its pieces in order."""

    def __init__(self, path: str, split: int, payloads: bool):
        self.path, self.split, self.payloads, self.at, self.open, self.found = path, split, payloads, 0, [], []

    def add(self, raw: bytes) -> None:
        start = self.at - len(MAGIC)
        self.at += len(raw) + len(MAGIC)
        # A header that holds the magic goes on in the next piece; what has a line that no header has is given up.
        self.open = [(s, data + MAGIC + raw) for s, data in self.open]
        if self.split or start >= 0:
            self.open.append((start, raw))
        self.open = [x for x in self.open if not self._candidate(*x)]

    def _candidate(self, start: int, data: bytes) -> bool:
        if (parsed := parse_header(data)) is None:
            return data[1:3] != b"\r\n" or b"\r\n\r\n" in data or data.count(b"\n") != data.count(b"\r\n") or not all(b":" in line for line in data[3:].split(b"\r\n")[:-1])
        size, f = parsed
        length, payload = int(f["content-length"]), None
        if len(data) >= size + length:
            payload = data[size : size + length]
        digest, declared = f.get("warc-payload-digest", ""), f.get("warc-payload-length", "")
        page = lambda k: f[k].removeprefix("<urn:page:").removesuffix(">") if k in f else None
        self.found.append({"rel": start, "next": start + len(MAGIC) + size + length + len(END), "type": f.get("warc-type"), "record_id": page("warc-record-id"), "uri": f.get("warc-target-uri"), "declared_digest": digest.removeprefix("sha1:") or None, "declared_bytes": int(declared) if declared.isascii() and declared.isdigit() else None, "refers_to": page("warc-refers-to"), "length": length, "head": len(MAGIC) + size, "digest": None if payload is None else hashlib.sha1(payload).hexdigest(), "payload": payload if self.payloads else None})
        return True

    def batches(self, rows: int = 500):
        """Link candidates to their successors in the split, number the forest, and give all as batches; first the split's size."""
        found = sorted(self.found, key=lambda c: c["rel"])
        place, beyond = {c["rel"]: k for k, c in enumerate(found)}, self.at - len(MAGIC)
        parent = [place.get(c["next"], -1) if c["next"] < beyond else -1 for c in found]
        size = [1] * len(found)
        for k, p in enumerate(parent):  # successors come later, so this adds up whole subtrees
            if p >= 0:
                size[p] += size[k]
        pre, slot, root = [0] * len(found), [0] * len(found), 0
        for k in range(len(found) - 1, -1, -1):
            c, p = found[k], parent[k]
            if p < 0:
                pre[k], root = root, root + size[k]
                c["exit"] = c["next"] if c["next"] >= beyond else None
            else:
                pre[k], slot[p] = slot[p], slot[p] + size[k]
                c["exit"] = found[p]["exit"]
            slot[k] = pre[k] + 1
            c["pre"], c["post"] = pre[k], pre[k] + size[k] - 1
        same = {"path": self.path, "split": self.split}
        yield pa.RecordBatch.from_pylist([same | {"total": self.at}], schema=CANDIDATE_SCHEMA)
        for k in range(0, len(found), rows):
            yield pa.RecordBatch.from_pylist([same | c for c in found[k : k + rows]], schema=CANDIDATE_SCHEMA)


def candidates(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    def run(batches):
        reader = None
        for batch in batches:
            for path, split, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if reader is None or (reader.path, reader.split) != (path, split):
                    if reader:
                        yield from reader.batches()
                    reader = SplitReader(path, split, payloads)
                reader.add(raw)
        if reader:
            yield from reader.batches()

    return pieces(spark, folder).mapInArrow(run, CANDIDATES)


def _with_bases(rows: DataFrame) -> DataFrame:
    """``path, split, base, file_bytes``: where each split's first piece begins."""
    sizes = rows.filter("total is not null").select("path", "split", "total")
    return sizes.selectExpr("path", "split", "sum(total) over (partition by path order by split) - total as base", f"sum(total) over (partition by path) - {len(MAGIC)} as file_bytes")


def _chain_entries(heads: DataFrame) -> DataFrame:
    """Pointer jumping: of ``path, abs, to`` those that the chain from offset 0 of their file reaches."""
    jump = cut_lineage(heads)
    reach, n = cut_lineage(jump.filter("abs = 0").select("path", "abs")), -1
    while (now := reach.count()) != n:
        n = now
        step = reach.join(jump, ["path", "abs"]).select("path", F.col("to").alias("abs")).join(jump.select("path", "abs"), ["path", "abs"], "left_semi")
        reach = cut_lineage(reach.union(step).distinct())
        later = jump.select("path", F.col("abs").alias("to"), F.col("to").alias("far"))
        jump = cut_lineage(jump.join(later, ["path", "to"], "left").select("path", "abs", F.coalesce("far", "to").alias("to")))
    return reach


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """``path, offset, type, record_id, uri, length, digest, declared_digest, declared_bytes, refers_to`` (and ``payload``) of every record on a file's boundary chain.

    ``length`` and ``digest`` (SHA-1) are of the content read; the declared ones are what the header says of the payload.
    """
    rows = cut_lineage(candidates(spark, folder, payloads))
    bases = cut_lineage(_with_bases(rows))
    placed = rows.filter("rel is not null").join(broadcast_if_small(bases), ["path", "split"]).withColumn("abs", F.col("base") + F.col("rel"))
    links = placed.select("path", "split", "abs", (F.col("base") + F.col("exit")).alias("to"), "pre")
    entered = links.filter("to is not null").select("path", F.col("to").alias("abs")).distinct()
    heads = links.join(entered, ["path", "abs"], "left_semi").union(links.filter("abs = 0"))
    reached = _chain_entries(heads.select("path", "abs", "to").distinct())
    entry = links.join(reached, ["path", "abs"]).select("path", "split", F.col("pre").alias("at"))
    whole = placed.join(entry, ["path", "split"]).filter("pre <= at and at <= post and base + next <= file_bytes")
    records = whole.select("path", F.col("abs").alias("offset"), (F.col("base") + F.col("next")).alias("end"), "type", "record_id", "uri", "declared_digest", "declared_bytes", "refers_to", "length", "head", "digest", "payload")
    cut = records.filter("digest is null").select("path", "offset", "end", "head", "length")
    # A file's chain ends at its last byte; else it broke where the last record that it reaches would end.
    known = bases.groupBy("path").agg(F.max("file_bytes").alias("file_bytes")).join(records.groupBy("path").agg(F.max("end").alias("end")), "path", "left")
    broken = known.select("path", F.coalesce("end", F.lit(0)).alias("offset"), "file_bytes").filter("offset < file_bytes").drop("file_bytes").withColumn("type", F.lit("broken"))
    found = records
    if not cut.isEmpty():
        found = records.join(_assembled(spark, folder, bases, cut), ["path", "offset"], "left")
        found = found.withColumn("digest", F.coalesce("digest", F.sha1("content"))).withColumn("payload", F.coalesce("payload", "content") if payloads else F.col("payload"))
    return found.unionByName(broken, allowMissingColumns=True).select("path", "offset", "type", "record_id", "uri", "length", "digest", "declared_digest", "declared_bytes", "refers_to", *["payload"] * payloads)


def _assembled(spark: SparkSession, folder: str, bases: DataFrame, cut: DataFrame) -> DataFrame:
    """``path, offset, content`` of records whose content comes in several pieces."""

    def run(batches):
        key, at = None, 0
        for batch in batches:
            out = []
            for path, split, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if key != (path, split):
                    key, at = (path, split), 0
                out.append({"path": path, "split": split, "rel": at - len(MAGIC), "raw": raw})
                at += len(raw) + len(MAGIC)
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("path", pa.string()), ("split", pa.int64()), ("rel", pa.int64()), ("raw", pa.binary())]))

    parts = pieces(spark, folder).mapInArrow(run, "path string, split bigint, rel bigint, raw binary").join(broadcast_if_small(bases), ["path", "split"])
    parts = parts.select("path", (F.col("base") + F.col("rel")).alias("abs"), "raw").withColumn("cell", F.floor(F.col("abs") / CELL))
    cells = cut.withColumn("cell", F.explode(F.sequence(F.floor(F.col("offset") / CELL), F.floor(F.col("end") / CELL))))
    held = parts.join(broadcast_if_small(cells), ["path", "cell"]).filter("abs >= offset and abs < end")
    joined = held.groupBy("path", "offset", "head", "length").agg(F.expr(f"listagg(raw, X'{MAGIC.hex()}') within group (order by abs)").alias("raw"))
    return joined.select("path", "offset", F.expr(f"substring(raw, cast(head as int) + 1 - {len(MAGIC)}, cast(length as int))").alias("content"))
