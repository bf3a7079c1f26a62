"""The pipeline stage by stage, against the operators' plain versions."""

import random

import corpus_pipeline
from tests.llm.test_near_copies import plain_least
from tests.llm.test_records import plain_hits
from tests.llm.test_text_rules import plain_counts

FOLDER = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, items = docs.columns, [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, FOLDER))
        left[name] = {r.doc_id: r for r in docs.collect()}
        assert docs.columns[:5] == columns
    rules, dedup, clean, secret, ids = left.values()
    for r in rules.values():
        n, _, _, _, repeat = plain_counts(r.text)
        assert n >= 50 and 100 * repeat <= 50 * n
    assert set(dedup) == set(plain_least([(k, rules[k].text) for k in sorted(rules)]))
    assert set(clean) == {k for k, r in dedup.items() if not plain_hits(r.text, items)[1]}
    assert set(secret) == set(clean) == set(ids) and all(r.n_chars == len(r.text) for r in secret.values())
    assert all("AKIA" not in r.text for r in secret.values()) and all(r.n_tokens > 0 for r in ids.values())
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, FOLDER).collect()) == sorted((k, r.n_tokens) for k, r in ids.items())


def test_odd_and_empty_documents(spark, tmp_path):
    draw = random.Random(1)
    say = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    one, item = say(80), say(12)
    rows = [(1, one), (2, one), (2, one), (3, None), (4, ""), (None, say(70)), (5, say(60) + " " + item + " " + say(9)), (6, say(60) + ' token = "0123456789abcdef0123456789abcdef01234567"'), (7, say(30_000))]
    folder = f"{tmp_path}/t"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == {1, None, 6, 7} and "[SECRET]" in got[6].text
    empty = f"{tmp_path}/e"
    for name, kind in (("documents", schema), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], kind).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
