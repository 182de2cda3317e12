"""Queries of the library over the given tables, with their SQL for another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.jobs import adapters as A
from lodestone.jobs.catalog import query
from lodestone.operators import answers as answers_
from lodestone.operators import audit, chunking, golden, index, retrieval, scoring, sections, urls
from lodestone.sources.tables import checksum


# ---- URL index -------------------------------------------------------------------------------------

_URLS = r"(SELECT DISTINCT regexp_replace(regexp_replace(u, '[.,;:]+$', ''), '\.md$', '') AS url FROM (SELECT unnest(regexp_extract_all('- see (' || url || '.md) for more.', 'https?://[^\s)]+')) AS u FROM pages))"
_CATEGORY = "CASE " + " ".join(f"WHEN contains(url, '{r.fragment}') THEN '{r.category}'" for r in A.RULES) + " END"
_KEPT = " AND ".join(f"NOT contains(url, '{p}')" for p in A.EXCLUDED)
_MATCHED = " UNION ALL ".join(f"SELECT url, '{r.category}' AS category, {r.cap if r.cap is not None else 'NULL'} AS cap FROM {_URLS} WHERE contains(url, '{r.fragment}') AND {_KEPT}" for r in A.RULES)
_SELECTED = f"(SELECT DISTINCT url FROM (SELECT url FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY url) AS place FROM ({_MATCHED})) WHERE cap IS NULL OR place <= cap UNION ALL SELECT * FROM (VALUES {', '.join(f'({s!r})' for s in A.SEEDS)}) v(url)))"


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.extract_urls(A.url_lines(spark, sf_dir))


@query(f"SELECT url FROM {_URLS}")
def url_extract(spark, sf_dir):
    return _found(spark, sf_dir)


@query(f"SELECT url, {_CATEGORY} AS category FROM {_URLS}")
def url_categorize(spark, sf_dir):
    return urls.categorize(_found(spark, sf_dir), A.RULES)


@query(f"SELECT coalesce({_CATEGORY}, 'other') AS category, count(*) AS n_urls FROM {_URLS} WHERE {_KEPT} GROUP BY 1")
def url_category_counts(spark, sf_dir):
    return urls.count_by_category(_found(spark, sf_dir), A.RULES, A.EXCLUDED)


@query(f"SELECT category, place, url FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY url)::INT AS place FROM (SELECT url, {_CATEGORY} AS category FROM {_URLS})) WHERE category IS NOT NULL AND place <= 5")
def url_sample_per_category(spark, sf_dir):
    return urls.sample_per_category(_found(spark, sf_dir), A.RULES)


@query(f"SELECT url FROM {_SELECTED}")
def url_select_capped(spark, sf_dir):
    return urls.select_urls(_found(spark, sf_dir), A.RULES, A.EXCLUDED, A.SEEDS)


@query(f"SELECT coalesce({_CATEGORY}, 'seed/other') AS category, count(*) AS n_urls FROM {_SELECTED} GROUP BY 1")
def url_selection_breakdown(spark, sf_dir):
    return urls.selection_breakdown(url_select_capped(spark, sf_dir), A.RULES)


@query(f"SELECT url FROM {_SELECTED} WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0 AND length(html) > 0)")
def url_pending(spark, sf_dir):
    stored = A.table(spark, sf_dir, "pages").filter("page_id % 2 = 0").select("url", F.col("html").alias("text"))
    return urls.pending_urls(url_select_capped(spark, sf_dir), stored)


_PATH = r"regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+/?', ''), '[?#].*$', ''), '(/$|\.md$|\.html$)', '')"


@query(f"SELECT url, {_PATH} || '.md' AS path, translate({_PATH}, '/', ':') AS document_id, 'https://site/' || {_PATH} AS site_url FROM pages")
def url_paths(spark, sf_dir):
    path = urls.url_to_path(F.col("url"))
    return A.table(spark, sf_dir, "pages").select("url", path.alias("path"), urls.document_id(path).alias("document_id"), urls.path_to_url(path, "https://site/").alias("site_url"))


# ---- cleaning --------------------------------------------------------------------------------------


def visible_sql(x: str) -> str:
    bare = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for entity, char in T.ENTITIES:
        bare = "replace({}, '{}', '{}')".format(bare, entity, char.replace("'", "''"))
    return f"trim(regexp_replace({bare}, '[ \\t\\r\\n\\f]+', ' ', 'g'))"


@query(f"SELECT page_id, {visible_sql('html')} AS visible FROM pages")
def html_visible_text(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("page_id", T.html_visible_text(F.col("html")).alias("visible"))


_TIDY = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), ' +([.,;:!?])', '\1', 'g'), '[ \t]+\n', chr(10), 'g'), '\n[ \t]+', chr(10), 'g')"
_CLEAN = rf"regexp_replace(regexp_replace(regexp_replace(replace({_TIDY}, '\_', '_'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\s\x{{85}}\p{{Z}}]+', ''), '[\s\x{{85}}\p{{Z}}]+$', '')"


@query(f"SELECT doc_id, {_CLEAN} AS clean FROM documents")
def clean_whitespace(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", T.normalize_whitespace(F.col("text")).alias("clean"))


@query(f"SELECT doc_id, {_CLEAN} AS clean FROM documents")
def clean_pages(spark, sf_dir):
    """The full cleaning of texts that were wrapped in page boilerplate, which must go without a trace."""
    notice = "> For the complete documentation index, see x. For agents this page is available as y.\n"
    wrapped = F.concat(F.lit(notice + "{% hint style=\"info\" %}"), F.lit("\n"), "text", F.lit("\n{% endhint %}\n---\n# Agent Instructions\nread this"))
    return A.table(spark, sf_dir, "documents").select("doc_id", T.clean_markdown(wrapped, [("product", "Product")]).alias("clean"))


TOKENS_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))"


@query(f"SELECT doc_id, {TOKENS_SQL} AS n_tokens FROM documents")
def token_counts(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", T.count_tokens(F.col("text")).alias("n_tokens"))


@query(
    r"""SELECT CASE WHEN starts_with(b, '```') THEN 'code' WHEN starts_with(b, '|') AND contains(b, chr(10)) THEN 'table'
    WHEN regexp_matches(b, '\A(?:[-*+]|\d+[.)])\s') THEN 'list' ELSE 'paragraph' END AS kind, count(*) AS n
    FROM (SELECT trim(unnest(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)))) AS b FROM documents) WHERE b <> '' GROUP BY 1"""
)
def block_types(spark, sf_dir):
    blocks = A.table(spark, sf_dir, "documents").select(F.explode(T.split_blocks(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")))).alias("block"))
    return blocks.groupBy(T.classify_block(F.col("block")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# ---- sections --------------------------------------------------------------------------------------

_H1 = visible_sql("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")
_PARAGRAPHS = f"list_transform(regexp_extract_all(html, '<p>([^<]+)</p>', 1), lambda x: {visible_sql('x')})"


@query(
    f"""SELECT translate({_PATH}, '/', ':') || ':section:1' AS section_id, {_H1} AS heading, array_to_string({_PARAGRAPHS}, chr(10) || chr(10)) AS content
    FROM pages WHERE len({_PARAGRAPHS}) > 0"""
)
def html_sections(spark, sf_dir):
    return sections.parse_sections(A.markdown_pages(spark, sf_dir)).select("section_id", "heading", "content")


@query(
    f"""WITH t AS (SELECT regexp_extract(url, '^([a-z]+://[^/]+/[a-z]+)/', 1) AS above, min({_H1}) AS title FROM pages GROUP BY 1)
    SELECT url, coalesce(title, '') AS crumbs FROM (SELECT url, regexp_extract(url, '^([a-z]+://[^/]+/[a-z]+)/', 1) AS above FROM pages) LEFT JOIN t USING (above)"""
)
def breadcrumbs(spark, sf_dir):
    pages = A.table(spark, sf_dir, "pages").select("url")
    return sections.breadcrumbs(pages, A.page_titles(spark, sf_dir)).select("url", F.array_join("breadcrumb", " > ").alias("crumbs"))


@query("SELECT url, min_by(title, page_id) AS title FROM (SELECT 'http://t/' || (page_id % 100) AS url, 'page ' || page_id AS title, page_id FROM pages) GROUP BY 1")
def page_titles(spark, sf_dir):
    line = F.concat(F.lit("* [page "), "page_id", F.lit("](http://t/"), F.col("page_id") % 100, F.lit(".md)"))
    return sections.page_titles(A.table(spark, sf_dir, "pages").select(F.col("page_id").alias("pos"), line.alias("value")))


# ---- chunks and their audit ------------------------------------------------------------------------


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(A.sectioned_documents(spark, sf_dir))


@query()
def chunks(spark, sf_dir):
    return _chunks(spark, sf_dir)


@query()
def chunk_totals(spark, sf_dir):
    return chunking.chunk_totals(A.sectioned_documents(spark, sf_dir))


@query("SELECT 'x' AS chunk_id, 'x' AS \"check\" WHERE 1 = 0")
def chunk_problems(spark, sf_dir):
    """No chunk of tables, code, lists and prose lacks a field, repeats an id or fails one of the seven checks."""
    made = chunking.chunk_documents(A.mixed_documents(spark, sf_dir))
    rows = audit.row_checks(made).select("chunk_id", "check")
    twice = audit.duplicate_chunk_ids(made).select("chunk_id", F.lit("duplicate").alias("check"))
    return rows.unionByName(twice).unionByName(audit.missing_fields(made).select("chunk_id", "check"))


def _section_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sectioned_documents(spark, sf_dir).select(F.inline("sections"))


@query("SELECT 'x' AS section_id WHERE 1 = 0")
def chunk_uncovered_sections(spark, sf_dir):
    return audit.uncovered_sections(_section_rows(spark, sf_dir), _chunks(spark, sf_dir))


@query("SELECT 'x' AS section_id, 'x' AS word, 0::BIGINT AS n_section, 0::BIGINT AS n_chunks WHERE 1 = 0")
def chunk_missing_words(spark, sf_dir):
    return audit.missing_words(_section_rows(spark, sf_dir), _chunks(spark, sf_dir))


_DOCS = f"(SELECT doc_id::VARCHAR AS chunk_id, 'http://' || source AS source_url, lang, text, {TOKENS_SQL} AS n FROM documents)"


@query(
    f"""SELECT count(*) AS chunks, count(DISTINCT source_url) AS documents, sum(n)::BIGINT AS tokens, min(n) AS least, median(n) AS median, max(n) AS most,
    (SELECT n FROM (SELECT n, row_number() OVER (ORDER BY n) AS r, count(*) OVER () AS k FROM {_DOCS}) WHERE r = floor(0.9 * k) + 1) AS p90 FROM {_DOCS}"""
)
def chunk_stats(spark, sf_dir):
    return audit.chunk_stats(A.document_chunks(spark, sf_dir))


@query(
    "SELECT lower, upper, (SELECT count(*) FROM " + _DOCS + " WHERE n > lower AND n <= coalesce(upper, 1000000000) OR lower = 0 AND n <= 0) AS n FROM (VALUES "
    + ", ".join(f"({a}, {b if b is not None else 'NULL'})" for a, b in [(0, audit.BUCKETS[0]), *zip(audit.BUCKETS, audit.BUCKETS[1:]), (audit.BUCKETS[-1], None)])
    + ") v(lower, upper)"
)
def token_histogram(spark, sf_dir):
    return audit.token_histogram(A.document_chunks(spark, sf_dir))


@query(f"SELECT lang AS block_type, count(*) AS n FROM {_DOCS} GROUP BY 1")
def block_type_counts(spark, sf_dir):
    return audit.block_type_counts(A.document_chunks(spark, sf_dir))


@query(f"SELECT source_url, count(*) AS chunks FROM {_DOCS} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_documents(spark, sf_dir):
    return audit.documents_with_most_chunks(A.document_chunks(spark, sf_dir))


@query(
    f"""SELECT * FROM (SELECT 'smallest' AS "end", chunk_id, n AS token_count FROM {_DOCS} ORDER BY n, chunk_id LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'largest' AS "end", chunk_id, n AS token_count FROM {_DOCS} ORDER BY n DESC, chunk_id LIMIT 5)"""
)
def extreme_chunks(spark, sf_dir):
    return audit.extreme_chunks(A.document_chunks(spark, sf_dir))


@query("SELECT doc_id::VARCHAR AS chunk_id FROM documents ORDER BY md5('42:' || doc_id), 1 LIMIT 10")
def sample_chunks(spark, sf_dir):
    return audit.sample_chunks(A.document_chunks(spark, sf_dir), 10, 42).select("chunk_id")


@query(f"SELECT chunk_id, source_url, n AS token_count, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM {_DOCS} WHERE contains(source_url, 'src1')")
def chunks_of_source(spark, sf_dir):
    return audit.chunks_of(A.document_chunks(spark, sf_dir), "src1")


@query(
    f"""WITH p AS (SELECT chunk_id, 'over the maximum' AS c FROM {_DOCS} WHERE n > 800 UNION ALL
    SELECT chunk_id, 'ends with a lead-in' FROM (SELECT chunk_id, trim(list_last(string_split(regexp_replace(text, '\\s+$', ''), chr(10)))) AS l, text FROM {_DOCS}) WHERE trim(text) <> '' AND l LIKE '%:' AND NOT regexp_matches(l, '^[-|]'))
    SELECT c AS "check", count(*) AS n, list_sort(list(chunk_id ORDER BY chunk_id))[1:5]::VARCHAR AS examples FROM p GROUP BY 1"""
)
def problem_summary(spark, sf_dir):
    found = audit.row_checks(A.document_chunks(spark, sf_dir)).filter("check in ('over the maximum', 'ends with a lead-in')")
    return audit.problem_summary(found).select("check", "n", F.concat(F.lit("["), F.array_join("examples", ", "), F.lit("]")).alias("examples"))


# ---- embeddings and retrieval ----------------------------------------------------------------------


@query("SELECT DISTINCT sha256(text) AS key, text FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)")
def embedding_cache_misses(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents")
    cache = index.embedding_keys(docs.filter("doc_id % 3 = 0"), "m").select("model", "key")
    return index.embedding_cache_misses(docs, cache, "m").select("key", "text")


@query("SELECT count(DISTINCT text) AS texts, count(DISTINCT text) FILTER (t) AS cached, count(DISTINCT text) FILTER (NOT t) AS \"new\" FROM (SELECT text, bool_or(doc_id % 3 = 0) AS t FROM documents GROUP BY 1)")
def embedding_cache_counts(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents")
    return index.cache_counts(docs, index.embedding_keys(docs.filter("doc_id % 3 = 0"), "m").select("model", "key"), "m")


@query(
    """SELECT coalesce(d, v) AS id, CASE WHEN d IS NULL THEN 'no document' ELSE 'no vector' END AS problem
    FROM (SELECT doc_id AS d FROM documents) FULL JOIN (SELECT vec_id AS v FROM embeddings) ON d = v WHERE d IS NULL OR v IS NULL"""
)
def verify_index(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return index.verify_index(docs, A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))


@query("SELECT 'x' AS id, 'x' AS \"check\" WHERE 1 = 0")
def document_round_trip(spark, sf_dir):
    """Chunks as flat documents come back the same."""
    made = _chunks(spark, sf_dir)
    return index.check_documents(made, index.chunk_to_document(made))


@query(f"SELECT count(*) AS n_rows FROM {_DOCS}")
def manifest_rows(spark, sf_dir):
    return checksum(A.document_chunks(spark, sf_dir), ["chunk_id", "text"]).select("n_rows")


@query()
def manifest_checksum(spark, sf_dir):
    return checksum(A.document_chunks(spark, sf_dir), ["chunk_id", "text"])


TOPK_SQL = """(SELECT query_id, rank, chunk_id, score, qlabel, clabel FROM (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, q.label AS qlabel, c.label AS clabel,
    list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 12) DESC, c.vec_id)::INT AS rank
    FROM embeddings q JOIN embeddings c ON q.vec_id % 50 = 0 AND c.vec_id % 50 <> 0) WHERE rank <= 5)"""


def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.vector_topk(*A.vectors(spark, sf_dir))


@query(f"SELECT query_id, rank, chunk_id, round_even(score, 4) AS score FROM {TOPK_SQL}")
def vector_topk(spark, sf_dir):
    return top_k(spark, sf_dir).withColumn("score", F.bround("score", 4))


@query(f"SELECT query_id, 'label ' || ((query_id // 50) % 10) AS expected, min(rank) FILTER (clabel = (query_id // 50) % 10) AS found_rank FROM {TOPK_SQL} GROUP BY 1, 2")
def expected_page_check(spark, sf_dir):
    chunks_ = A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("/label "), "label").alias("source_url"))
    results = top_k(spark, sf_dir).join(chunks_, "chunk_id")
    asked = A.vectors(spark, sf_dir)[0].select("query_id", F.concat(F.lit("label "), F.floor(F.col("query_id") / 50) % 10).alias("expected"))
    return retrieval.expected_page_check(results, asked)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the vector queries: evidence is any chunk of the query's label, the type is the label."""
    asked, stored = A.vectors(spark, sf_dir)
    found = top_k(spark, sf_dir).join(stored.select("chunk_id", F.col("label").alias("clabel")), "chunk_id").join(asked.select("query_id", "label"), "query_id")
    first = found.groupBy("query_id", "label").agg(F.min(F.when(F.col("label") == F.col("clabel"), F.col("rank"))).alias("first_evidence_rank"))
    rank = F.col("first_evidence_rank")
    nothing = {m: F.lit(None).cast("double") for m in scoring.JUDGED}
    return first.select(
        F.col("query_id").cast("string").alias("id"),
        F.concat(F.lit("label "), "label").alias("type"),
        F.lit(True).alias("answerable"),
        F.lit(None).cast("string").alias("error"),
        "first_evidence_rank",
        *(F.coalesce(rank <= n, F.lit(False)).alias(f"hit_at_{n}") for n in (1, 3, 5)),
        F.coalesce(1 / rank, F.lit(0.0)).alias("reciprocal_rank"),
        rank.isNotNull().cast("long").alias("evidence_items_found"),
        F.lit(1).cast("long").alias("evidence_items_total"),
        rank.isNotNull().cast("double").alias("evidence_recall"),
        F.lit(None).cast("boolean").alias("required_terms_ok"),
        rank.isNotNull().alias("cites_evidence_chunk"),
        F.array().cast("array<bigint>").alias("invalid_citation_numbers"),
        F.array().cast("array<string>").alias("required_terms_missing"),
        F.array().cast("array<string>").alias("judge_errors"),
        F.lit(None).cast("string").alias("declines"),
    ).withColumns(nothing)


_RANKS = f"(SELECT query_id, 'label ' || qlabel AS type, min(rank) FILTER (qlabel = clabel) AS r FROM {TOPK_SQL} GROUP BY 1, 2)"
_METRICS = "count(*) AS questions, " + ", ".join(f"round_even(avg((coalesce(r, 9) <= {n})::INT), 3) AS hit_at_{n}" for n in (1, 3, 5)) + ", round_even(avg(coalesce(1.0 / r, 0)), 3) AS mrr"


@query(f"SELECT type, {_METRICS} FROM {_RANKS} GROUP BY GROUPING SETS ((), (type))")
def retrieval_metrics_by_type(spark, sf_dir):
    return scoring.summary(_scored(spark, sf_dir)).select("type", "questions", "hit_at_1", "hit_at_3", "hit_at_5", "mrr")


@query(
    f"""SELECT query_id::VARCHAR AS id, type, CASE WHEN r IS NULL THEN 'evidence not retrieved in top 5; evidence 0/1' ELSE 'evidence at rank ' || r END AS reasons
    FROM {_RANKS} WHERE coalesce(r, 9) > 1"""
)
def failures(spark, sf_dir):
    return scoring.failures(_scored(spark, sf_dir))


@query(f"SELECT type, 'mrr' AS metric, printf('%.3f', round_even(avg(coalesce(1.0 / r, 0)), 3)) AS score FROM {_RANKS} GROUP BY GROUPING SETS ((), (type))")
def report_rows(spark, sf_dir):
    return scoring.report_rows(scoring.summary(_scored(spark, sf_dir)), [], ["mrr"])


# ---- answers, cost, runs ---------------------------------------------------------------------------

_ANSWERS = (
    "(SELECT concat_ws('-', conv_id, turn) AS id, conv_id, turn, text || ' [' || (turn % 7) || '] [' || (conv_id % 4 + 1) || '] [' || (turn % 7) || ']' AS answer, "
    + TOKENS_SQL
    + " AS n, ['small', 'large', 'unpriced'][conv_id % 3 + 1] AS model FROM conversations WHERE role = 'assistant')"
)
_NUMBERS = r"list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda x: try_cast(x AS BIGINT))"


@query(
    f"""SELECT id, number, id || '/' || number AS chunk_id, min(i) - 1 AS place FROM (SELECT id, unnest({_NUMBERS} || [2, 9]) AS number, unnest(range(1, len({_NUMBERS}) + 3)) AS i FROM {_ANSWERS})
    WHERE number BETWEEN 1 AND 5 GROUP BY 1, 2"""
)
def citations(spark, sf_dir):
    """The cited sources of each answer; place is where the number first appears."""
    asked = A.answers(spark, sf_dir)
    made = answers_.build_citations(asked, A.sources_of(asked))
    numbers = F.concat(scoring.marker_numbers(F.col("answer")), F.array(F.lit(2), F.lit(9)).cast("array<bigint>"))
    return made.join(asked.select("id", numbers.alias("n")), "id").select("id", "number", "chunk_id", (F.array_position("n", F.col("number")) - 1).alias("place"))


@query(f"SELECT id, array_to_string(list_sort(list_distinct(list_filter({_NUMBERS}, lambda x: x NOT BETWEEN 1 AND 5))), ',') AS invalid FROM {_ANSWERS}")
def invalid_citations(spark, sf_dir):
    found = scoring.invalid_citations(F.col("answer"), F.lit(5))
    return A.answers(spark, sf_dir).select("id", F.array_join(found.cast("array<string>"), ",").alias("invalid"))


@query(f"SELECT id AS query_id, array_to_string(list_transform(range(1, 6), lambda r: '[' || r || '] (source: http://s/' || r || ')' || chr(10) || 'text ' || r), chr(10) || chr(10)) AS sources FROM {_ANSWERS}")
def prompt_sources(spark, sf_dir):
    return answers_.format_sources(A.sources_of(A.answers(spark, sf_dir)))


@query(f"SELECT id, 'Use these:' || chr(10) || 'S' || chr(10) || 'Question: ' || answer AS \"user\" FROM {_ANSWERS}")
def prompts(spark, sf_dir):
    templates = spark.createDataFrame([("v1", "You answer.", "Use these:\n{sources}\nQuestion: {question}")], "version string, system string, user string")
    asked = A.answers(spark, sf_dir).select("id", F.col("answer").alias("question"), F.lit("S").alias("sources"))
    return answers_.render_prompt(asked, templates, "v1").select("id", "user")


_PRICE = " ".join(f"WHEN '{m}' THEN ((3 * n - n // 2) * {i!r}::DOUBLE + (n // 2) * {c!r}::DOUBLE + n * {o!r}::DOUBLE) / 1000000" for m, i, c, o in A.PRICES)
_COST = f"CASE model {_PRICE} END"


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.createDataFrame(A.PRICES, "model string, input double, cached_input double, output double")
    return answers_.estimate_cost(A.answers(spark, sf_dir), prices)


@query(f"SELECT id, model, round_even({_COST}, 8) AS cost_usd FROM {_ANSWERS}")
def llm_cost(spark, sf_dir):
    return _calls(spark, sf_dir).select("id", "model", F.bround("cost_usd", 8).alias("cost_usd"))


@query(f"SELECT model, count(*) AS calls, sum(3 * n)::BIGINT AS input_tokens, sum(n)::BIGINT AS output_tokens, CASE WHEN count({_COST}) = count(*) THEN round_even(sum({_COST}), 6) END AS cost_usd FROM {_ANSWERS} GROUP BY ROLLUP (model)")
def judge_usage(spark, sf_dir):
    prices = spark.createDataFrame(A.PRICES, "model string, input double, cached_input double, output double")
    return scoring.judge_usage(A.answers(spark, sf_dir), prices)


_OK = "FILTER (event_type <> 'error' AND value IS NOT NULL)"


@query(
    f"""SELECT run_name, count(*) AS questions, count(*) FILTER (NOT bad) AS answered, count(*) FILTER (bad) AS errors,
    round_even(avg(value) FILTER (NOT bad), 3) AS latency_mean, round_even(median(value) FILTER (NOT bad), 3) AS latency_p50, round_even(quantile_cont(value, 0.95) FILTER (NOT bad), 3) AS latency_p95
    FROM (SELECT 'run ' || (user_id % 5) AS run_name, value, event_type = 'error' AS bad FROM events) GROUP BY 1"""
)
def run_totals(spark, sf_dir):
    rows = A.table(spark, sf_dir, "events").select(
        F.concat(F.lit("run "), F.col("user_id") % 5).alias("run_name"),
        F.col("value").alias("latency_seconds"),
        F.when(F.col("event_type") == "error", "failed").alias("error"),
        F.struct(*(F.lit(0).cast("bigint").alias(c) for c in answers_.COUNTERS)).alias("llm_token_usage"),
        F.lit(None).cast("double").alias("llm_cost_usd"),
    )
    return scoring.run_totals(rows).select("run_name", "questions", "answered", "errors", "latency_mean", "latency_p50", "latency_p95")


@query(
    """WITH m AS (SELECT 'label ' || quality AS type, round_even(avg(toxic) FILTER (doc_id % 2 = 0), 3) AS before, round_even(avg(toxic) FILTER (doc_id % 2 = 1), 3) AS after,
    round_even(avg(toxic) FILTER (doc_id % 2 = 1) - avg(toxic) FILTER (doc_id % 2 = 0), 3) AS change FROM labels GROUP BY 1)
    SELECT type, 'toxic' AS metric, before, after, change, abs(change) < 0.1 AS is_noise FROM m"""
)
def compare_runs(spark, sf_dir):
    rows = A.table(spark, sf_dir, "labels").select(F.concat(F.lit("run "), F.col("doc_id") % 2).alias("run_name"), F.concat(F.lit("label "), "quality").alias("type"), F.lit("toxic").alias("metric"), F.col("toxic").cast("double").alias("value"))
    return scoring.compare_runs(rows, "run 0", "run 1")


@query(
    """SELECT question_id, round_even(avg(found::INT::DOUBLE), 2) AS recall, coalesce(string_agg('claim ' || doc_id, ',' ORDER BY doc_id) FILTER (NOT found), '') AS missing
    FROM (SELECT doc_id % 50 AS question_id, doc_id, quality = 1 AS found FROM labels) GROUP BY 1"""
)
def claim_recall(spark, sf_dir):
    rows = A.table(spark, sf_dir, "labels").select((F.col("doc_id") % 50).alias("question_id"), F.col("doc_id").alias("claim_no"), F.concat(F.lit("claim "), "doc_id").alias("claim"), (F.col("quality") == 1).alias("found"))
    return scoring.claim_recall(rows).select("question_id", "recall", F.array_join("missing", ",").alias("missing"))


@query(
    """SELECT doc_id AS question_id, CASE WHEN doc_id % 5 > 1 THEN quality::DOUBLE END AS faithfulness, CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END AS declines,
    CASE WHEN doc_id % 5 = 0 THEN 'faithfulness' ELSE '' END AS judge_errors FROM labels"""
)
def judge_scores(spark, sf_dir):
    labels = A.table(spark, sf_dir, "labels")
    value = F.when(F.col("doc_id") % 5 == 1, F.lit(float("nan"))).otherwise(F.col("quality").cast("double"))
    one = labels.select(F.col("doc_id").alias("question_id"), F.lit("faithfulness").alias("metric"), value.alias("value"), F.lit(None).cast("string").alias("label"), F.when(F.col("doc_id") % 5 == 0, "timeout").alias("error"))
    two = labels.select(F.col("doc_id").alias("question_id"), F.lit("declines").alias("metric"), F.lit(None).cast("double").alias("value"), F.when(F.col("toxic") == 1, "yes").otherwise("no").alias("label"), F.lit(None).cast("string").alias("error"))
    return scoring.clean_judge_scores(one.unionByName(two)).select("question_id", "faithfulness", "declines", F.array_join("judge_errors", ",").alias("judge_errors"))


# ---- golden set ------------------------------------------------------------------------------------

_GOLDEN = "(SELECT item_id, any_value(b.text) AS quote, count(d.doc_id) > 0 AS ok, list_sort(list(DISTINCT 'http://' || source) FILTER (d.doc_id IS NOT NULL)) AS urls FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY 1)"


@query(
    f"""SELECT 'q' || item_id AS id, 'required terms not in the expected answer' AS "check", 'zzz' AS detail FROM {_GOLDEN} WHERE item_id % 4 = 0 AND NOT contains(lower(quote), 'zzz')
    UNION ALL SELECT 'q' || item_id, 'source urls differ from the evidence', array_to_string(urls, ', ') FROM {_GOLDEN} WHERE item_id % 10 = 0 AND ok"""
)
def golden_problems(spark, sf_dir):
    return golden.golden_problems(*A.golden_set(spark, sf_dir))


_TYPES = ", ".join(f"('{t}')" for t in golden.TYPES)


@query(
    f"""SELECT t.type, count(item_id) AS questions, 0::BIGINT AS several_evidence, count(item_id) FILTER (item_id % 4 = 0) AS with_required_terms
    FROM (VALUES {_TYPES}) t(type) LEFT JOIN (SELECT *, CASE WHEN ok THEN 'faq' ELSE 'unanswerable' END AS type FROM {_GOLDEN}) g ON t.type = g.type GROUP BY 1"""
)
def golden_counts(spark, sf_dir):
    return golden.golden_counts(A.golden_set(spark, sf_dir)[0])
