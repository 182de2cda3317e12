"""Stages keep clean documents, take effect, and work on empty tables and odd rows."""

import numpy as np
import pytest

import corpus_pipeline

RNG = np.random.default_rng(8)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n):
    return " ".join(f"word{i}" for i in RNG.integers(0, 5000, n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    item, base, line = words(30), words(90), words(60)
    texts = {i: words(60) for i in range(1, 41)}
    texts |= {i: f"{words(20)} you idiot and moron. {words(20)}" for i in range(100, 160)}
    texts |= {200: "\n".join(" ".join(base.split()[i : i + 9]) for i in range(0, 90, 9)), 201: base, 210: f"{words(20)} {item} {words(20)}", 220: f"{words(9)}\n{line}", 221: f"{words(9)}\n{line}", 230: None, 231: ""}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 160)) for i in texts], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_pipeline(spark, folder):
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(rows) == {*range(1, 41), 200, 220, 221, 230, 231}
    assert "\n" in rows[220].text and "\n" not in rows[221].text and rows[221].n_chars == len(rows[221].text)
    assert rows[1].n_pieces == len(rows[1].piece_ids) > 0


def test_stages_on_an_empty_table(spark, folder):
    docs = spark.createDataFrame([], SCHEMA + ", score string, rep string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == 0
