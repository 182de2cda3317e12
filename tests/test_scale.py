"""Work that must not grow faster than the tables: held against brute force, and against what plans shuffle."""

import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.functions import quotes
from lodestone.jobs import adapters
from lodestone.jobs.registry import QUERIES
from lodestone.operators import audit, chunking, golden, openapi, retrieval
from lodestone.sources import tables


SMOKE = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_holders_leave_texts_where_they_are(spark, monkeypatch):
    dealt = random.Random(5)
    word = lambda: "".join(dealt.choice("abé界") for _ in range(dealt.randint(1, 3)))
    texts = [" ".join(word() for _ in range(dealt.randint(0, 60))) for _ in range(60)]
    asked = [t[dealt.randint(0, 20) :][: dealt.choice([1, 2, 3, 7, 8, 15, 16, 17, 60])] for t in texts] + ["", "no such words", "a  a", texts[7] + "x"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate([*texts, None])], "doc_id long, text string, source string")
    items = spark.createDataFrame([(i, q) for i, q in enumerate([*asked, None])], "item_id long, quote string")
    found = adapters.holders(docs, items)
    assert "Exchange" not in plan(found)  # texts were shuffled, or broadcast, once for each of their words
    want = sorted((d, i) for d, t in enumerate(texts) for i, q in enumerate(asked) if q in t)
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == want
    monkeypatch.setattr(quotes, "QUOTE_BYTES", 700)
    monkeypatch.setattr(quotes, "STEP", 64)
    assert sorted((r.doc_id, r.item_id) for r in adapters.holders(docs, items).collect()) == want


def test_quotes_are_looked_up_where_chunks_are(spark, monkeypatch):
    g = spark.createDataFrame([(i, "faq", "q", "a", [(f"b{i} c", ["c1", "c2"])], ["u"], [], True, "") for i in "123"], tables.GOLDEN)
    chunks = spark.createDataFrame([("c1", "b1 c B2 C", "u"), ("c2", "b1 c b3 c", "u")], "chunk_id string, text string, source_url string").cache()
    chunks.count()
    near = golden.quote_not_in_chunk(g, chunks)
    want = [("2", "c2"), ("3", "c1")]
    monkeypatch.setattr(golden, "BROADCAST", 0)
    far = golden.quote_not_in_chunk(g.hint("merge"), chunks)
    assert sorted((r.id, r.detail) for r in near.collect()) == sorted((r.id, r.detail) for r in far.collect()) == want
    monkeypatch.undo()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in plan(golden.quote_not_in_chunk(g, chunks))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_missing_words_are_compared_where_the_chunk_is(spark):
    dealt = random.Random(8)
    text = lambda n: " ".join(dealt.choice("abcdé") for _ in range(n))
    sections = [(f"s{i}", text(dealt.randint(0, 30))) for i in range(40)] + [("s1", "a a"), (None, "a b"), ("s50", None), ("s51", "x")]
    chunks = [(f"c{i}", [f"s{dealt.randint(0, 40)}" for _ in range(dealt.randint(0, 3))], text(dealt.randint(0, 60))) for i in range(40)]
    chunks += [chunks[3], ("c4", chunks[4][1], text(5)), (None, [None, "s2"], "a"), ("n", None, "a"), ("m", ["s3"], None)]
    want = set()
    for name in {s for s, _ in sections}:
        own = " ".join(t or "" for s, t in sections if s == name).split()
        inside = [w for _, ids, t in chunks for i in ids or [] if i == name and i is not None for w in (t or "").split()]
        want |= {(name, w, own.count(w), inside.count(w)) for w in own if own.count(w) > inside.count(w)}
    one = spark.createDataFrame(sections, "section_id string, content string")
    found = audit.missing_words(one, spark.createDataFrame(chunks, "chunk_id string, section_ids array<string>, text string"))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in found.collect())
    # sections in one chunk: their words, all there, were dealt too
    lone = spark.createDataFrame([(f"s{i}", text(200)) for i in range(20)], "section_id string, content string")
    held = lone.select(F.concat(F.lit("c"), "section_id").alias("chunk_id"), F.array("section_id").alias("section_ids"), F.col("content").alias("text"))
    assert audit.missing_words(lone, held).count() == 0
    assert "MapInArrow" in plan(audit.missing_words(lone, held))


def test_blocks_of_a_small_table_are_split_by_many_tasks(spark):
    made = plan(QUERIES["split_blocks_whole"](spark, SMOKE))
    assert "REPARTITION_BY_NUM" in made  # one file, of one task, makes 300 times its bytes of text


def test_only_glossary_pages_are_joined(spark):
    docs = adapters.sectioned_documents(spark, SMOKE)
    kept = chunking.fold_glossary(chunking.prepared(docs.select("document", "inherited_api", F.inline("sections"))))
    whole = plan(kept)
    assert "Union" in whole.split("Join")[0]  # what is no glossary page goes past the joins


def test_equal_scores_are_cut_in_each_partition(spark):
    dealt = np.random.default_rng(3)
    x = dealt.integers(0, 3, (300, 3)).astype(float) + [0, 0, 1]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = dealt.permutation(300)
    found = list(retrieval._nearest(x[:40], ((ids[i : i + 7], x[i : i + 7]) for i in range(0, 300, 7)), 4))
    assert all(len(at) <= 8 for _, at, _ in found)  # all of the same score came out, for each batch
    for n, at, _ in found:
        first = sorted(range(300), key=lambda i: (-round(float(x[n] @ x[i]), 12), ids[i]))[:4]
        assert {ids[i] for i in first} <= set(at.tolist())
    stored = spark.createDataFrame([(f"c{ids[i]:03d}", x[i].tolist()) for i in range(300)], "chunk_id string, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(n, x[n].tolist()) for n in range(40)], "query_id long, embedding array<double>")
    got = {}
    for r in retrieval.vector_topk(asked, stored, 4, block=15).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {n: [f"c{ids[i]:03d}" for i in sorted(range(300), key=lambda i: (-round(float(x[n] @ x[i]), 12), ids[i]))[:4]] for n in range(40)}


def test_markdown_reads_specifications_once(spark, monkeypatch):
    calls = []
    for name in ("parse_specs", "pointers", "_operations", "_bodies"):
        own = getattr(openapi, name)
        monkeypatch.setattr(openapi, name, lambda *rows, own=own, name=name: calls.append(name) or own(*rows))
    spec = '{"openapi": "3", "info": {"title": "T"}, "paths": {"/x": {"get": {"responses": {"200": {"description": "Ok"}}}}}}'
    made = openapi.openapi_markdown(spark.createDataFrame([("s", "h", spec)], "spec_id string, heading string, code string"))
    assert sorted(calls) == ["_bodies", "_operations", "parse_specs", "pointers"]
    assert made.first().text == "API: T\n\nGET /x\n\nResponses:\n\n- 200: Ok."
