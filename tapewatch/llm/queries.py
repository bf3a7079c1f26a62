"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.llm.common import new_folder, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op4_forced_boundary_bpe")
def op4_forced_boundary_bpe(spark: SparkSession, folder: str) -> DataFrame:
    from tapewatch.llm.bpe import with_decoded, with_token_ids

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = with_token_ids(table(spark, folder, "documents").select("doc_id", "text"), path).drop("text")
    return with_decoded(docs, path).select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op10_huffman_token_files")
def op10_huffman_token_files(spark: SparkSession, folder: str) -> DataFrame:
    from tapewatch.llm.huffman import read_token_files, write_token_files

    docs = table(spark, folder, "documents")
    out = new_folder(docs)
    write_token_files(docs, out, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_token_files(spark, out).select("doc_id", "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"))


@query("op5_covering_simhash")
def op5_covering_simhash(spark: SparkSession, folder: str) -> DataFrame:
    from tapewatch.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


@query("op3_decision_list")
def op3_decision_list(spark: SparkSession, folder: str) -> DataFrame:
    from tapewatch.llm.common import cut_lineage
    from tapewatch.llm.quality import COUNTS, base_failed, kept, learn_rules, with_statistics

    docs = cut_lineage(with_statistics(table(spark, folder, "documents").select("doc_id", "text"), keep_text=False))
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    rules = learn_rules(docs.join(labels, "doc_id"))
    return docs.select("doc_id", *COUNTS, base_failed().alias("base_failed"), kept(rules).alias("kept"))


@query("op2_contextual_pii")
def op2_contextual_pii(spark: SparkSession, folder: str) -> DataFrame:
    from tapewatch.llm.pii import KINDS, personal_spans

    found = personal_spans(table(spark, folder, "documents").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    every = F.flatten(F.array(*[F.expr(f"array_sort(filter(concat(base, added), s -> s.kind = '{k}'))") for k in KINDS]))
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"), F.size("added").cast("bigint").alias("n_added"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS k FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS u(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS k FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(s)),
m AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN bw USING (n, k)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(s, s + n)) AS u(p) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query("op7_positional_index", OP7_SQL)
def op7_positional_index(spark: SparkSession, folder: str) -> DataFrame:
    from tapewatch.llm.decontaminate import contamination

    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP6_SHARDS = [f"shard-{k:03d}" for k in range(16)]

# The table is filled turn by turn: the list `free` marks the slots that no shard has claimed.
OP6_SQL = """
WITH RECURSIVE size AS (SELECT 1601 AS m),
place AS (SELECT k, 'shard-' || lpad(CAST(k AS VARCHAR), 3, '0') AS shard FROM range(16) AS r(k)),
pref AS (SELECT k, shard, ('0x' || substr(md5('offset:' || shard), 1, 15))::BIGINT % m AS o, ('0x' || substr(md5('step:' || shard), 1, 15))::BIGINT % (m - 1) + 1 AS s FROM place, size),
ranked AS (SELECT k, list((o + s * j) % 1601 ORDER BY j) AS slots FROM pref, range(1601) AS r(j) GROUP BY k),
fill AS (
  SELECT 0 AS turn, CAST(-1 AS BIGINT) AS slot, list_transform(range(1601), lambda x: true) AS free
  UNION ALL
  SELECT turn + 1, c, list_concat(free[1 : c], [false], free[c + 2 :])
  FROM (SELECT turn, free, list_filter(slots, lambda x: free[x + 1])[1] AS c FROM fill JOIN ranked ON k = turn % 16 WHERE turn < 1601)
)
SELECT d.doc_id, h.slot, p.shard
FROM documents d, LATERAL (SELECT ('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 15))::BIGINT % 1601 AS slot) h
JOIN (SELECT slot, (turn - 1) % 16 AS k FROM fill WHERE turn > 0) f ON f.slot = h.slot JOIN place p USING (k)
"""


@query("op6_lookup_sharding", OP6_SQL)
def op6_lookup_sharding(spark: SparkSession, folder: str) -> DataFrame:
    from tapewatch.llm.sharding import place

    return place(table(spark, folder, "documents").select("doc_id"), OP6_SHARDS).select("doc_id", "slot", "shard")


@query("op9_secret_forest")
def op9_secret_forest(spark: SparkSession, folder: str) -> DataFrame:
    from tapewatch.llm.secrets import scan

    found = scan(table(spark, folder, "documents"))
    return found.select("doc_id", "start", F.length("candidate").cast("bigint").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "times", "score", "secret")


OP1_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS winner FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN winner = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN winner <> page_id THEN winner END AS refers_to FROM w
"""


@query("op1_warc_chain", OP1_SQL)
def op1_warc_chain(spark: SparkSession, folder: str) -> DataFrame:
    from tapewatch.llm.warc import read_archives, write_archives

    pages = table(spark, folder, "pages")
    out = new_folder(pages)
    write_archives(pages, out, compression="none")  # Spark splits plain archives, so chains cross splits
    read = read_archives(spark, out)
    response = F.col("type") == "response"
    return read.select(
        F.col("record_id").cast("bigint").alias("page_id"),
        F.when(response, F.col("length")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest")).otherwise(F.col("declared_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers_to").cast("bigint").alias("refers_to"),
    )


@query("op8_noisy_channel_toxicity")
def op8_noisy_channel_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from tapewatch.llm.toxicity import toxicity

    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 5 == 0, F.lit(True))
    labels = table(spark, folder, "labels").filter(~held_out("doc_id")).select("doc_id", "toxic")
    scores = toxicity(docs, labels)
    return scores.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


# crc32 bit by bit: a zero after each byte's eight steps leaves room for the next byte.
CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"

OP11_SQL = f"""
WITH o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
cv AS (SELECT c, {CRC32.format("CAST(c AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT c FROM o)),
r AS (SELECT cv.c, o.i, role, text FROM cv JOIN o ON o.c = cv.c - cv.c % 100 AND o.i <= h UNION ALL SELECT cv.c, o.i, role, text FROM cv JOIN o ON o.c = cv.c AND o.i > h),
p AS (SELECT c, row_number() OVER w AS d, string_agg(md5(md5(role) || text), '') OVER w AS k, length(text) AS chars FROM r WINDOW w AS (PARTITION BY c ORDER BY i ROWS UNBOUNDED PRECEDING)),
q AS (SELECT c, d, k, chars FROM p UNION ALL SELECT c, 0, '', 0 FROM cv),
n AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(chars) AS own, k[: -33] AS up FROM q GROUP BY d, k),
f AS (SELECT up AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY up),
s AS (SELECT k[: 32 * a] AS k, sum(own) AS saved, count(*) FILTER (WHERE n_children IS NULL) AS leaves FROM (SELECT n.*, n_children FROM n LEFT JOIN f USING (k)), unnest(range(0, d + 1)) AS u(a) GROUP BY 1),
e AS (SELECT k, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(k, d) AS k FROM q GROUP BY c) GROUP BY k)
SELECT n.conv_id, n.d AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN s USING (k) LEFT JOIN f USING (k) LEFT JOIN e USING (k) LEFT JOIN n AS m ON n.d > 0 AND m.k = n.up
"""


@query("op11_prefix_trie", OP11_SQL)
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    from tapewatch.llm.trie import prefix_trie, rebuilt_turns

    return prefix_trie(rebuilt_turns(table(spark, folder, "conversations"))).drop("p1", "p2")


def _op13_sql(passes: int = 3) -> str:
    sql = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1])::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER (ORDER BY cap / w, source) AS k FROM w),
t AS (SELECT source, source_size, least(cap, w * (SELECT arg_min(level, k) FROM l WHERE w * level <= cap)) AS target FROM l),
c AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS whole FROM t),
u AS (SELECT doc_id, d.source, size, c.source_size, target, whole, rate - whole AS p, target - whole * c.source_size AS due, (('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source),
o AS (SELECT *, u / (1 - u) * ((1 - p) / p) AS odds FROM u),
r0 AS (SELECT doc_id, source, size, source_size, target, whole, due, CASE WHEN p > 0 THEN odds / (1 + odds) END AS rank, -1.0::DOUBLE AS reached, false AS extra FROM o)"""
    for k in range(passes):
        fits = " AND size <= due" if k else ""
        sql += f""",
a{k} AS (SELECT source, rank, due, sum(size) OVER (PARTITION BY source ORDER BY rank) AS words FROM r{k} WHERE rank > reached{fits}),
b{k} AS (SELECT source, max(rank) AS now, max(words) AS words FROM a{k} WHERE words <= due GROUP BY source),
r{k + 1} AS (SELECT doc_id, r.source, size, source_size, target, whole, due - coalesce(words, 0) AS due, rank, coalesce(now, reached) AS reached, extra OR coalesce(rank <= now{fits}, false) AS extra FROM r{k} r LEFT JOIN b{k} b ON r.source IS NOT DISTINCT FROM b.source)"""
    return sql + f"\nSELECT doc_id, size, source_size, target, CAST(size * (whole + CAST(extra AS INT)) AS BIGINT) AS taken FROM r{passes}"


@query("op13_pareto_mix", _op13_sql())
def op13_pareto_mix(spark: SparkSession, folder: str) -> DataFrame:
    from tapewatch.llm.mixing import plan_mix

    docs = table(spark, folder, "documents")
    return plan_mix(docs).rows(docs).select("doc_id", "size", "source_size", "target", "taken")


#: Letters beyond ASCII stand for one byte each, as the distance is taken over bytes.
_BYTES = "0123456789!#$%&()*+,-./:;<=>?@ABCDEFGHIJKLMNOPQRSTUVWXYZ[]^_`{|}"
_LETTERS = "".join(map(chr, range(0xC0, 0x100)))

OP12_SQL = f"""
WITH RECURSIVE step8 AS (SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY b) AS t FROM range(256) AS r(b)),
r AS (SELECT CAST(doc_id AS VARCHAR) AS i, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
g AS (SELECT i, w, count(*) AS n FROM r WHERE length(w) >= 7 GROUP BY i, w),
h AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(regexp_replace(hex(encode(coalesce(i, '') || ':' || w)), '(..)', '\\1 ', 'g'), ' ')[: -2], lambda x: ('0x' || x)::BIGINT)), lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS INT) + 1])), 4294967295) AS h FROM g, step8),
v AS (SELECT CASE WHEN h % 31 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, n FROM h),
words AS (SELECT w AS word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
b AS (SELECT word, n, length(word) AS l, translate(word, '{_LETTERS}', '{_BYTES}') AS k FROM words),
near AS (SELECT x.word, y.word AS other, y.n FROM b AS x JOIN b AS y ON x.l = y.l AND levenshtein(x.k, y.k) = 1 UNION ALL SELECT x.word, y.word, y.n FROM b AS x JOIN b AS y ON x.l = y.l + 1 AND levenshtein(x.k, y.k) = 1 UNION ALL SELECT x.word, y.word, y.n FROM b AS x JOIN b AS y ON x.l + 1 = y.l AND levenshtein(x.k, y.k) = 1),
best AS (SELECT word, count(*) AS n_near, max(n) AS bn, min(struct_pack(a := -n, o := other)).o AS other FROM near GROUP BY word),
f AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 10 * words.n THEN other END AS form, CASE WHEN bn >= 10 * words.n THEN bn END AS form_n FROM words LEFT JOIN best USING (word)),
up AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, up.root FROM f JOIN up ON f.form = up.word)
SELECT word, n, form, root, n_near, form_n FROM f JOIN up USING (word)
"""


@query("op12_letter_gram_variants", OP12_SQL)
def op12_letter_gram_variants(spark: SparkSession, folder: str) -> DataFrame:
    from tapewatch.llm.variants import variants, word_counts

    return variants(word_counts(table(spark, folder, "documents")))
