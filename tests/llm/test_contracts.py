"""Every registered query on small tables: columns and types, held-out rows, odd rows, empty tables, SQL."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm.queries import ORACLE_SQL, QUERIES

RNG = np.random.default_rng(21)
WORDS = [f"word{i}" for i in range(400)]
#: The columns that each contract names, with their types.
COLUMNS = {
    "op1_main_text": "page_id long, url string, text string, n_chars long",
    "op2_vector_search": "query_id long, rank int, vec_id long, score double",
    "op3_token_counts": "doc_id long, n_tokens long",
    "op4_decontamination": "doc_id long, item_id long, similarity double",
    "op5_line_dedup": "doc_id long, line_no int, first_doc long, first_line int, similarity double",
    "op6_near_duplicates": "doc_id long, n_shingles long, component_id long, kept boolean",
    "op7_language_id": "doc_id long, held_out boolean, lang_pred string, score double",
    "op8_language_model": "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    "op9_sentence_pieces": "doc_id long, n_pieces long, piece_ids array<int>, round_trip boolean",
    "op10_toxicity": "doc_id long, held_out boolean, score double, predicted int",
    "op11_ngram_join": "doc_id long, n_shingles long, component_id long",
    "op12_hard_negatives": "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long",
    "op13_merkle_manifest": "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
}
HELD_OUT = {"op7_language_id": (4, 2), "op8_language_model": (5, 1), "op10_toxicity": (5, 0)}


def text(n):
    return " ".join(RNG.choice(WORDS, n))


@pytest.fixture(scope="module")
def rows():
    long = "z" * 3_000 + " " + text(2_000)
    base = text(60)
    docs = [(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in enumerate([None, "", " \n\t ", "one", long, base, base, base + " more", *(text(40) for _ in range(60))])]
    docs += [(5, docs[5][1], "en", "s", 1), (70, None, None, None, None), (71, f"{base}\n{base}", None, "s", 1), (None, "no id", "en", "s", 5)]
    return docs


@pytest.fixture(scope="module")
def folders(spark, rows, tmp_path_factory):
    full, empty = (str(tmp_path_factory.mktemp(x)) for x in ("full", "empty"))
    clash = {c: F.lit("clash") for c in ("score", "rank", "kept", "key", "n", "row", "tree", "label_of", "found")}
    pages = [(1, "http://a/1", "<html><body><nav>m</nav><article><p>" + "t" * 40_000 + "</p></article></body></html>"), (2, None, None), (3, "", ""), (1, "http://a/1", "x"), (None, "http://[", "<p>y")]
    vectors = [(i, RNG.normal(size=8).astype(float).tolist()) for i in range(50)] + [(60, None), (61, [0.0] * 8), (62, [float("inf")] * 8), (63, []), (5, [1.0] * 8), (None, [1.0] * 8)]
    labelled = [(i, v, None if i == 7 else (i or 0) % 3) for i, v in vectors]
    tables = {
        "documents": (rows, "doc_id long, text string, lang string, source string, n_chars long"),
        "pages": (pages, "page_id long, url string, html string"),
        "embeddings": (labelled, "vec_id long, embedding array<float>, label int"),
        "benchmark": ([(0, rows[5][1]), (1, None), (2, ""), (3, "one two"), (0, rows[5][1])], "item_id long, text string"),
        "labels": ([(i, 1, i % 2) for i in range(60)] + [(3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int"),
    }
    for name, (data, schema) in tables.items():
        df = spark.createDataFrame(data, schema).withColumns(clash)
        df.write.parquet(f"{full}/{name}.parquet")
        df.limit(0).write.parquet(f"{empty}/{name}.parquet")
    return full, empty


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_contract(spark, folders, rows, name):
    df = QUERIES[name](spark, folders[0])
    kinds = {k: v for k, v in df.dtypes}
    for column in COLUMNS[name].split(", "):
        c, kind = column.split(" ", 1)
        assert kinds[c] == {"long": "bigint"}.get(kind, kind)
    made = df.collect()
    if "doc_id" in kinds and name not in ("op4_decontamination", "op5_line_dedup"):
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in made) == sorted((r[0] is None, r[0] or 0) for r in rows)
    if name in HELD_OUT:
        parts, rest = HELD_OUT[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % parts == rest) for r in made)
        assert name == "op8_language_model" or all(0 <= r.score <= 1 for r in made)
    if name == "op9_sentence_pieces":
        assert all(r.round_trip for r in made)
    if name == "op2_vector_search":
        assert {r.query_id for r in made} == {0, 20, 40} and all(r.vec_id not in (60, 61, 62, 63, r.query_id) for r in made)
    if name == "op4_decontamination":
        assert {(r.doc_id, r.item_id) for r in made} >= {(5, 0), (6, 0), (7, 0), (71, 0)}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, folders, name):
    assert QUERIES[name](spark, folders[1]).collect() == []


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, folders, rows, name):
    con = duckdb.connect()
    rows_of = "SELECT *" if name == "op13_merkle_manifest" else "SELECT DISTINCT doc_id, text"
    only = "" if name == "op13_merkle_manifest" else "WHERE doc_id IS NOT NULL"
    con.sql(f"CREATE VIEW documents AS {rows_of} FROM '{folders[0]}/documents.parquet/*.parquet' {only}")
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folders[0]}/embeddings.parquet/*.parquet'")
    made = con.sql(ORACLE_SQL[name])
    df = QUERIES[name](spark, folders[0])
    found = {tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*made.columns).collect()}
    want = {tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in made.fetchall()}
    assert {r for r in found if r[0] is not None} == {r for r in want if r[0] is not None}
