"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.decontamination import op4_decontamination
from lodestone.llm.hard_negatives import op12_hard_negatives
from lodestone.llm.html_main_text import op1_main_text
from lodestone.llm.language_id import op7_language_id
from lodestone.llm.language_model import op8_language_model
from lodestone.llm.line_dedup import op5_line_dedup
from lodestone.llm.merkle_manifest import FIELDS, op13_merkle_manifest
from lodestone.llm.near_duplicates import op6_near_duplicates
from lodestone.llm.ngram_join import op11_ngram_join
from lodestone.llm.sentence_pieces import op9_sentence_pieces
from lodestone.llm.token_counts import op3_token_counts
from lodestone.llm.toxicity import op10_toxicity
from lodestone.llm.vector_search import op2_vector_search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_main_text": op1_main_text,
    "op2_vector_search": op2_vector_search,
    "op3_token_counts": op3_token_counts,
    "op4_decontamination": op4_decontamination,
    "op5_line_dedup": op5_line_dedup,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_language_id": op7_language_id,
    "op8_language_model": op8_language_model,
    "op9_sentence_pieces": op9_sentence_pieces,
    "op10_toxicity": op10_toxicity,
    "op11_ngram_join": op11_ngram_join,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(regexp_split_to_array(" + _LOWER + r", '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _components(k: int, more: str) -> str:
    """The components of documents linked by k-word shingles at 0.85."""
    shingle = " || ' ' || ".join(f"ws[i + {j}]" for j in range(k))
    return f"""
WITH RECURSIVE sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {k} THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - {k - 2}), lambda i: {shingle})) END AS sh
  FROM (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents)
), shingles AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), ends AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS node, doc_id AS least FROM documents
  UNION SELECT ends.b, reach.least FROM reach JOIN ends ON ends.a = reach.node WHERE reach.least < ends.b
)
SELECT doc_id, len(any_value(sh)) AS n_shingles, min(least) AS component_id{more} FROM sets JOIN reach ON doc_id = node GROUP BY doc_id"""


def _digest(text: str) -> str:
    """The leaf of a row of ``documents`` in DuckDB, with ``text`` for its text."""
    columns = [text if f == "text" else f"{f}::VARCHAR" for f in FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in columns) + ")"


#: 5 divides the crc32 of the id as text; the table of the checksum is made from its polynomial.
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({}, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT)"
_CRC_TABLE = "(SELECT list(list_reduce(list_concat([i::BIGINT], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"


def _levels(name: str, leaves: str) -> str:
    """A recursive table of all nodes of the trees over ``leaves`` (g, i, n, h), sixteen to a parent."""
    return f"""{name}(k, g, i, n, h) AS (
  SELECT 0::BIGINT, g, i, n, h FROM {leaves}
  UNION ALL SELECT k + 1, g, i // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY k, g, i // 16
)"""


def _steps(leaves: str, nodes: str) -> str:
    """The digests left and right of each node on the way from a leaf to the top of its tree."""
    own = "(x.i >> (4 * y.k))"
    side = lambda op: f"coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i {op} {own}), '')"
    return f"SELECT x.g, x.i, y.k, {side('<')} AS l, {side('>')} AS r FROM {leaves} x JOIN {nodes} y ON x.g = y.g AND y.n > 1 AND y.i // 16 = {own} // 16 GROUP BY 1, 2, 3"


#: The others learn, search approximately, or decode: the tests hold them against brute force, an exact
#: round trip or held-out texts.
ORACLE_SQL: dict[str, str] = {
    "op5_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10)))))::INT AS line_no FROM documents
), sets AS (
  SELECT doc_id, line_no, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(line), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))) AS ws FROM lines
), firsts AS (
  SELECT ws, min({{'d': doc_id, 'l': line_no}}) AS spot FROM sets WHERE len(ws) > 0 GROUP BY 1
), words AS (
  SELECT spot, len(ws) AS n, unnest(ws) AS w FROM firsts
), pairs AS (
  SELECT y.spot AS b, x.spot AS a, count(*) / (any_value(x.n) + any_value(y.n) - count(*)) AS similarity
  FROM words x JOIN words y ON x.w = y.w AND x.spot < y.spot AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)
  GROUP BY 1, 2 HAVING 9 * count(*) >= 4 * (any_value(x.n) + any_value(y.n))
), earliest AS (
  SELECT ws, coalesce(e.a, f.spot) AS a, coalesce(e.similarity, 1.0::DOUBLE) AS similarity
  FROM firsts f LEFT JOIN (SELECT b, min({{'a': a, 'similarity': similarity}}) AS e FROM pairs GROUP BY 1) ON b = f.spot
)
SELECT doc_id, line_no, a.d AS first_doc, a.l AS first_line, similarity FROM sets JOIN earliest USING (ws) WHERE NOT (doc_id = a.d AND line_no = a.l)""",
    "op6_near_duplicates": _components(3, ", doc_id = min(least) AS kept"),
    "op11_ngram_join": _components(4, ""),
    "op12_hard_negatives": """
WITH rows AS (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.id AS a, a.label AS own, x.id, x.label, list_inner_product(a.v, x.v)::BIGINT AS s FROM rows a JOIN rows x ON a.id % 100 = 0 AND len(a.v) = len(x.v)
), positives AS (
  SELECT a, own, id, s FROM scored WHERE own = label AND id <> a QUALIFY row_number() OVER (PARTITION BY a, own ORDER BY s DESC, id) <= 5
)
SELECT p.a AS anchor_id, p.id AS positive_id, (row_number() OVER (PARTITION BY p.a, p.own, p.id ORDER BY n.s DESC, n.id))::INT AS rank, n.id AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM positives p JOIN scored n ON n.a = p.a AND n.own = p.own AND n.label <> p.own AND 80 * p.s <= 100 * n.s AND n.s <= p.s
QUALIFY row_number() OVER (PARTITION BY p.a, p.own, p.id ORDER BY n.s DESC, n.id) <= 5""",
    "op13_merkle_manifest": f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS g, {_digest("text")} AS h,
    CASE WHEN {_CRC.format("doc_id::VARCHAR")} % 5 = 0 THEN {_digest("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_digest("text")} END AS later
  FROM documents, {_CRC_TABLE}
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM hashed
), {_levels("nodes", "leaves")}, tops AS (
  SELECT g AS name, h, '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
), {_levels("upper", "tops")}, steps AS (
  {_steps("leaves", "nodes")}
  UNION ALL SELECT leaves.g, leaves.i, 1000 + k, l, r FROM leaves JOIN tops ON tops.name = leaves.g JOIN ({_steps("tops", "upper")}) s ON s.i = tops.i
), paths AS (
  SELECT g, i, string_agg(l || r, '' ORDER BY k) AS proof, list({{'l': l, 'r': r}} ORDER BY k) AS path FROM steps GROUP BY 1, 2
), folded AS (
  SELECT doc_id, leaves.h AS leaf, tops.h AS subroot, (SELECT h FROM upper WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_concat([{{'l': later, 'r': ''}}], coalesce(path, [])), lambda a, s: {{'l': sha256(s.l || a.l || s.r), 'r': ''}}).l AS folded_root
  FROM leaves JOIN tops ON tops.name = leaves.g LEFT JOIN paths ON paths.g = leaves.g AND paths.i = leaves.i
)
SELECT *, folded_root = root AS verified FROM folded""",
}
