"""Queries whose input holds planted faults or cases, so that SQL can say which rows must come out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.jobs import adapters as A
from lodestone.jobs.base import TOKENS_SQL, TOPK_SQL, top_k, visible_sql
from lodestone.jobs.catalog import query
from lodestone.operators import answers, audit, golden, index, retrieval, scoring
from lodestone.sources.tables import checksum, read_page_tree, read_rebuilt, rebuild_table, shared_folder, write_page_tree

# ---- audit


@query(
    """SELECT * FROM (SELECT doc_id::VARCHAR AS chunk_id, 'missing fields' AS "check", concat_ws(', ', CASE WHEN doc_id % 7 = 0 THEN 'source_url' END, CASE WHEN doc_id % 11 = 0 OR text IS NULL THEN 'text' END) AS detail
    FROM documents) WHERE detail <> ''"""
)
def audit_missing_fields(spark, sf_dir):
    n = F.col("chunk_id").cast("long")
    rows = A.document_chunks(spark, sf_dir).withColumns({"source_url": F.when(n % 7 != 0, F.col("source_url")), "text": F.when(n % 11 != 0, F.col("text"))})
    return audit.missing_fields(rows, ("chunk_id", "source_url", "text", "token_count"))


@query("SELECT doc_id::VARCHAR AS chunk_id, (1 + (doc_id % 39 = 0)::INT)::BIGINT AS extra FROM documents WHERE doc_id % 13 = 0")
def audit_duplicate_ids(spark, sf_dir):
    rows, n = A.document_chunks(spark, sf_dir), F.col("chunk_id").cast("long")
    return audit.duplicate_chunk_ids(rows.unionByName(rows.filter(n % 13 == 0)).unionByName(rows.filter(n % 39 == 0)))


@query(
    rf"""WITH c AS (SELECT doc_id::VARCHAR AS chunk_id, doc_id % 4 AS k, {TOKENS_SQL} AS n FROM documents)
    SELECT chunk_id, 'over the maximum' AS "check" FROM c WHERE n > 800 UNION ALL SELECT chunk_id, 'invalid source_url' FROM c WHERE k = 0
    UNION ALL SELECT chunk_id, 'token_count mismatch' FROM c WHERE k = 1 UNION ALL SELECT chunk_id, 'unbalanced code fence' FROM c WHERE k = 2
    UNION ALL SELECT chunk_id, 'ends with a heading' FROM c WHERE k = 3"""
)
def audit_row_checks(spark, sf_dir):
    """A fault of another kind in each fourth of the chunks: URL, count, fence, last line."""
    k = F.col("chunk_id").cast("long") % 4
    rows = A.document_chunks(spark, sf_dir).withColumn("plain", F.regexp_replace(F.coalesce("text", F.lit("")), "`", ""))
    tail = F.when(k == 2, "\n```\nend.").when(k == 3, "\n## end").otherwise("\nend.")
    made = rows.withColumn("text", F.concat("plain", tail)).withColumn("source_url", F.when(k == 0, "ftp://x").otherwise(F.col("source_url")))
    own = rows.select("chunk_id", F.col("token_count").alias("own"))
    made = made.withColumn("token_count", T.count_tokens(F.col("text")) + F.when(k == 1, 1).otherwise(0))
    found = audit.row_checks(made.drop("plain"), max_tokens=1 << 40).select("chunk_id", "check")
    long = audit.row_checks(A.document_chunks(spark, sf_dir), recount=False).filter("check = 'over the maximum'").select("chunk_id", "check")
    return found.unionByName(long.join(own, "chunk_id", "left_semi"))


@query("SELECT doc_id::VARCHAR AS section_id FROM documents WHERE doc_id % 5 = 0")
def audit_uncovered(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents")
    name = F.col("doc_id").cast("string")
    chunks = docs.filter("doc_id % 5 <> 0").select(F.array(name, F.lit("other")).alias("section_ids"))
    return audit.uncovered_sections(docs.select(name.alias("section_id")), chunks)


@query(
    r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS word FROM documents),
    s AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY 1, 2),
    c AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '^\S+', ''), '[\p{L}\p{N}_]+')) AS word FROM documents) GROUP BY 1, 2)
    SELECT doc_id::VARCHAR AS section_id, word, s.n AS n_section, coalesce(c.n, 0) AS n_chunks FROM s LEFT JOIN c USING (doc_id, word) WHERE s.n > coalesce(c.n, 0)"""
)
def audit_lost_words(spark, sf_dir):
    """Chunks that lack the first word of their section."""
    docs = A.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("section_id"), F.col("text").alias("content"))
    chunks = docs.select(F.col("section_id").alias("chunk_id"), F.array("section_id").alias("section_ids"), F.regexp_replace("content", r"^[^\s]+", "").alias("text"))
    return audit.missing_words(docs, chunks)


@query("SELECT count(*) FILTER (doc_id % 3 = 0) AS merged FROM documents")
def audit_merged_count(spark, sf_dir):
    n = F.col("chunk_id").cast("long")
    rows = A.document_chunks(spark, sf_dir)
    return audit.merged_chunk_count(rows.withColumn("section_ids", F.when(n % 3 == 0, F.array("chunk_id", "source_url")).otherwise(F.array("chunk_id"))))


# ---- index and retrieval


@query(
    """WITH d AS (SELECT doc_id, text IS NULL AS none, unnest(range(0, 1 + (doc_id % 19 = 0)::INT)) AS copy FROM documents)
    SELECT doc_id::VARCHAR AS id, 'duplicate id' AS "check" FROM documents WHERE doc_id % 19 = 0
    UNION ALL SELECT doc_id::VARCHAR, 'null field' FROM d WHERE doc_id % 23 = 0 OR none
    UNION ALL SELECT doc_id::VARCHAR, 'not the same again' FROM d WHERE doc_id % 17 = 0 OR doc_id % 23 = 0"""
)
def index_document_faults(spark, sf_dir):
    """Flat documents of which some are changed, repeated or lack a field."""
    chunks, n = A.document_chunks(spark, sf_dir), F.col("chunk_id").cast("long")
    flat = index.chunk_to_document(chunks)
    flat = flat.withColumns({"page_content": F.when(n % 17 == 0, F.concat("page_content", F.lit("!"))).otherwise(F.col("page_content")), "source_url": F.when(n % 23 != 0, F.col("source_url"))})
    return index.check_documents(chunks, flat.unionByName(flat.filter(n % 19 == 0)))


@query("SELECT doc_id, ascii(source)::BIGINT AS e0, length(text)::BIGINT AS e1, doc_id % 2 = 0 AS cached FROM documents WHERE text IS NOT NULL")
def embed_with_cache(spark, sf_dir):
    """Vectors come from the cache or from the embedder; here of texts by their length, stored ones for even ids."""
    docs = A.table(spark, sf_dir, "documents").filter("text is not null").withColumn("text", F.concat("source", F.lit(" "), F.col("doc_id").cast("string"), F.lit(" "), "text"))
    embedder = lambda texts: [[float(ord(t[0])), float(len(t))] for t in texts]
    vector = F.array(F.ascii("text").cast("float"), F.length("text").cast("float"))
    cache = index.embedding_keys(docs.filter("doc_id % 2 = 0"), "m").select("model", "key", vector.alias("embedding"))
    made, full = index.embed_with_cache(docs.select("doc_id", "source", "text"), cache, "m", embedder)
    own = F.length("source") + F.length(F.col("doc_id").cast("string")) + 2
    hit = index.embedding_keys(made, "m").join(cache.select("key", F.lit(True).alias("hit")), "key", "left")
    return hit.select("doc_id", F.col("embedding")[0].cast("long").alias("e0"), (F.col("embedding")[1].cast("long") - own).alias("e1"), F.coalesce("hit", F.lit(False)).alias("cached"))


@query(f"SELECT query_id, rank, round_even(score, 4) AS score, chunk_id, 'http://' || source AS source_url, string_split(text, chr(10))[1] AS header FROM {TOPK_SQL} JOIN documents ON doc_id = chunk_id")
def retrieval_listing(spark, sf_dir):
    about = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("http://"), "source").alias("source_url"), "text")
    return retrieval.retrieval_summary(top_k(spark, sf_dir), about)


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR coalesce(text, '') = '' THEN source ELSE text END AS body FROM documents")
def chunk_bodies(spark, sf_dir):
    full = F.when(F.col("doc_id") % 5 == 0, F.col("source")).otherwise(F.concat("source", F.lit("\n\n"), F.coalesce("text", F.lit(""))))
    return A.table(spark, sf_dir, "documents").select("doc_id", answers.chunk_body(full).alias("body"))


@query(f"SELECT conv_id, turn, {TOKENS_SQL} AS input_tokens, 0::BIGINT AS output_tokens, CASE WHEN turn % 2 = 0 THEN turn ELSE 0 END::BIGINT AS cached_input_tokens, 0::BIGINT AS reasoning_tokens FROM conversations")
def token_usage(spark, sf_dir):
    none = F.lit(None).cast("bigint")
    usage = F.struct(T.count_tokens(F.col("text")).alias("input_tokens"), none.alias("output_tokens"), F.when(F.col("turn") % 2 == 0, F.col("turn")).alias("cached_input_tokens"), none.alias("reasoning_tokens"))
    return A.table(spark, sf_dir, "conversations").select("conv_id", "turn", usage.alias("usage")).select("conv_id", "turn", F.inline(F.array(answers.token_usage(F.col("usage")))))


# ---- cleaning


@query("SELECT doc_id, 'See ' || source || ' and ' || lang || ' code [Image: a] x' AS plain FROM documents WHERE lang IS NOT NULL")
def inline_markdown(spark, sf_dir):
    parts = [F.lit("See ["), F.col("source"), F.lit("](http://x) and **"), F.col("lang"), F.lit("** `code` ![a](b) <b>x</b>")]
    return A.table(spark, sf_dir, "documents").filter("lang is not null").select("doc_id", T.inline_text(F.concat(*parts)).alias("plain"))


@query(f"SELECT page_id, 'é é A € ' || {visible_sql('html')} AS visible FROM pages WHERE html IS NOT NULL")
def html_entities(spark, sf_dir):
    """Visible text with all character references decoded."""
    return A.table(spark, sf_dir, "pages").filter("html is not null").select("page_id", T.html_visible_text(F.concat(F.lit("&eacute; &#233; &#x41; &euro; "), "html"), every_entity=True).alias("visible"))


# ---- runs and scores


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "conv_id", "turn", F.col("text").alias("question"))


@query("SELECT concat_ws('-', conv_id, turn) AS id, text AS question, text || '?' AS now FROM conversations WHERE turn % 3 = 0 UNION ALL SELECT concat_ws('-', conv_id, turn), text, NULL FROM conversations WHERE turn % 3 = 1")
def changed_questions(spark, sf_dir):
    """Every third question is asked otherwise now, another third is gone."""
    rows = _questions(spark, sf_dir)
    now = rows.filter("turn % 3 <> 1").select("id", F.when(F.col("turn") % 3 == 0, F.concat("question", F.lit("?"))).otherwise(F.col("question")).alias("question"))
    return scoring.changed_questions(rows, now)


@query("SELECT concat_ws('-', conv_id, turn) AS id, text AS question FROM conversations WHERE conv_id < 2 AND turn < 2 UNION ALL SELECT 'none', NULL")
def selected_questions(spark, sf_dir):
    found, gone = scoring.select_questions(_questions(spark, sf_dir), ["0-0", "0-1", "1-0", "1-1", "none"])
    return found.select("id", "question").unionByName(gone.select("id", F.lit(None).cast("string").alias("question")))


@query("SELECT * FROM (VALUES ('same', true), ('changed', false), ('shorter', false)) v(what, matches) WHERE (SELECT count(*) FROM documents) > 0")
def corpus_matches(spark, sf_dir):
    """The checksum of a corpus against the one recorded of itself, of a changed and of a shorter one."""
    rows = A.document_chunks(spark, sf_dir).select("chunk_id", "text")
    first = rows.agg(F.min("chunk_id").alias("first"))
    changed = rows.join(F.broadcast(first)).select("chunk_id", F.when(F.col("chunk_id") == F.col("first"), "other").otherwise(F.col("text")).alias("text"))
    shorter = rows.join(F.broadcast(first)).filter("chunk_id <> first").select("chunk_id", "text")
    cases = {"same": rows.repartition(3), "changed": changed, "shorter": shorter}
    recorded = [scoring.corpus_matches(rows, checksum(other, ["chunk_id", "text"]), ["chunk_id", "text"]).select(F.lit(what).alias("what"), "matches") for what, other in cases.items()]
    return recorded[0].unionByName(recorded[1]).unionByName(recorded[2])


_CASES = """(SELECT concat_ws('-', conv_id, turn) AS id, conv_id, turn, text, conv_id % 4 <> 0 AS answerable, list_transform(range(1, 6), lambda r: (conv_id * 5 + turn + r) % 20) AS found,
    [turn % 7, conv_id % 4 + 1, turn % 7] AS marks FROM conversations WHERE role = 'assistant')"""
_ITEMS = f"""(SELECT *, CASE WHEN answerable THEN nullif(list_position(found, conv_id % 20), 0) END AS r1,
    CASE WHEN answerable THEN list_min(list_filter([nullif(list_position(found, turn % 20), 0), nullif(list_position(found, (turn + 1) % 20), 0)], lambda x: x IS NOT NULL)) END AS r2 FROM {_CASES})"""


@query(
    f"""SELECT id, 'turn ' || (turn % 3) AS type, least(r1, r2) AS first_evidence_rank, CASE WHEN answerable THEN coalesce(least(r1, r2) <= 3, false) END AS hit_at_3,
    CASE WHEN answerable THEN round_even(coalesce(1.0 / least(r1, r2), 0), 4)::DOUBLE END AS reciprocal_rank, CASE WHEN answerable THEN (r1 IS NOT NULL)::BIGINT + (r2 IS NOT NULL)::BIGINT END AS evidence_items_found,
    CASE WHEN answerable THEN list_contains([conv_id % 20, turn % 20, (turn + 1) % 20], found[turn % 5 + 1]) END AS cites_evidence_chunk,
    turn % 2 = 0 AS required_terms_ok, CASE WHEN turn % 2 = 1 THEN 'zq zq' ELSE '' END AS missing,
    array_to_string(list_sort(list_distinct(list_filter(marks, lambda x: x NOT BETWEEN 1 AND 5))), ',') AS invalid FROM {_ITEMS}"""
)
def scored_answers(spark, sf_dir):
    """Answers of the assistant through all checks: ranks of evidence, citations, required terms, markers."""
    made = _score_records(spark, sf_dir)
    return made.select(
        "id", "type", "first_evidence_rank", "hit_at_3", F.bround("reciprocal_rank", 4).alias("reciprocal_rank"), "evidence_items_found", "cites_evidence_chunk", "required_terms_ok",
        F.array_join("required_terms_missing", ",").alias("missing"), F.array_join(F.col("invalid_citation_numbers").cast("array<string>"), ",").alias("invalid"),
    )


def _score_records(spark: SparkSession, sf_dir: str, judged: bool = False) -> DataFrame:
    """score_records of the assistant's turns; ``judged``: with verdicts and with runs that failed."""
    turns = A.table(spark, sf_dir, "conversations").filter("role = 'assistant'").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    chunk = lambda c: (c % 20).cast("string")
    retrieved = F.array(*(F.struct(F.lit(r).alias("rank"), chunk(F.col("conv_id") * 5 + F.col("turn") + r).alias("chunk_id")) for r in range(1, 6)))
    marks = F.concat(*(x for c in (F.col("turn") % 7, F.col("conv_id") % 4 + 1, F.col("turn") % 7) for x in (F.lit(" ["), c.cast("string"), F.lit("]"))))
    error = F.when(F.lit(judged) & (F.col("conv_id") % 11 == 3), "boom").alias("error")
    asked = turns.select("id", F.concat(F.lit("the `answer` "), F.regexp_replace("text", r"\[|\]", ""), marks).alias("answer"), retrieved.alias("retrieved"), "turn", error)
    asked = asked.withColumn("citations", F.array(F.struct(F.get("retrieved", (F.col("turn") % 5).cast("int"))["chunk_id"].alias("chunk_id"))))
    items = F.array(F.struct(F.lit("q").alias("quote"), F.array(chunk(F.col("conv_id"))).alias("chunk_ids")), F.struct(F.lit("q").alias("quote"), F.array(chunk(F.col("turn")), chunk(F.col("turn") + 1)).alias("chunk_ids")))
    answerable = F.col("conv_id") % 4 != 0
    known = turns.select(
        "id", F.concat(F.lit("turn "), F.col("turn") % 3).alias("type"), answerable.alias("answerable"), F.when(answerable, items).otherwise(F.slice(items, 1, 0)).alias("evidence"),
        F.when(F.col("turn") % 2 == 1, F.array(F.lit("THE answer"), F.lit("zq zq"))).otherwise(F.array(F.lit("THE answer"))).alias("required_terms"),
    )
    if not judged:
        return scoring.score_records(asked, known)
    verdict = lambda metric, value, label: F.struct(F.lit(metric).alias("metric"), value.cast("double").alias("value"), label.cast("string").alias("label"), F.when(F.lit(metric == "context_recall") & (F.col("conv_id") % 5 == 0), "timeout").alias("error"))
    none = F.lit(None)
    verdicts = F.array(
        verdict("faithfulness", F.col("turn") % 5 / 4, none), verdict("answer_recall", 1 - F.col("conv_id") % 2 * 0.5, none), verdict("context_recall", F.lit(float("nan")), none),
        verdict("declines", none, F.when(F.col("conv_id") % 3 == 0, "yes").otherwise("no")),
    )
    return scoring.score_records(asked, known, scoring.clean_judge_scores(turns.select(F.col("id").alias("question_id"), F.inline(verdicts))))


_SCORED = f"""(SELECT *, 'turn ' || (turn % 3) AS type, conv_id % 11 = 3 AS bad, least(r1, r2) AS r, (r1 IS NOT NULL)::INT + (r2 IS NOT NULL)::INT AS items, conv_id % 3 = 0 AS declined,
    list_sort(list_distinct(list_filter(marks, lambda x: x NOT BETWEEN 1 AND 5))) AS odd FROM {_ITEMS})"""


def _mean(value: str, where: str = "answerable") -> str:
    return f"round_even(avg({value}) FILTER (NOT bad AND {where}), 3)"


_SUMMARY = f"""(SELECT type, count(*) AS questions, count(*) FILTER (NOT bad) AS graded, count(*) FILTER (NOT bad AND answerable) AS answerable, count(*) FILTER (NOT bad AND NOT answerable) AS unanswerable,
    {_mean('(coalesce(r, 9) <= 1)::INT')} AS hit_at_1, {_mean('(coalesce(r, 9) <= 3)::INT')} AS hit_at_3, {_mean('(coalesce(r, 9) <= 5)::INT')} AS hit_at_5, {_mean('coalesce(1.0 / r, 0)')} AS mrr,
    {_mean('items / 2.0')} AS evidence_recall, {_mean('(items = 2)::INT')} AS all_evidence_found_multi, {_mean('(turn % 2 = 0)::INT', 'true')} AS required_terms_ok,
    {_mean('list_contains([conv_id % 20, turn % 20, (turn + 1) % 20], found[turn % 5 + 1])::INT')} AS cites_evidence_chunk, count(*) FILTER (NOT bad AND len(odd) > 0) AS invalid_citation_answers,
    {_mean('(turn % 5) / 4.0')} AS faithfulness, {_mean('1 - (conv_id % 2) * 0.5')} AS answer_recall, NULL::DOUBLE AS context_recall, {_mean('declined::INT', 'NOT answerable')} AS refusal_accuracy,
    {_mean('declined::INT')} AS false_refusal_rate FROM {_SCORED} s GROUP BY GROUPING SETS ((), (type)))"""


@query(f"SELECT * FROM {_SUMMARY}")
def answers_summary(spark, sf_dir):
    """All means and rates of judged answers, overall and by type; runs that failed aren't graded."""
    return scoring.summary(_score_records(spark, sf_dir, True))


@query(
    f"""SELECT id, type, reasons FROM (SELECT id, type, CASE WHEN bad THEN 'run error: boom' ELSE concat_ws('; ',
    CASE WHEN answerable AND r IS NULL THEN 'evidence not retrieved in top 5' END, CASE WHEN answerable AND r > 1 THEN 'evidence at rank ' || r END,
    CASE WHEN answerable AND items < 2 THEN 'evidence ' || items || '/2' END, CASE WHEN answerable AND declined THEN 'false refusal' END,
    CASE WHEN answerable AND conv_id % 2 = 1 THEN 'answer recall 0.50' END, CASE WHEN NOT answerable AND NOT declined THEN 'answered instead of declining' END,
    CASE WHEN turn % 5 < 4 THEN 'faithfulness ' || printf('%.2f', (turn % 5) / 4.0) END, CASE WHEN turn % 2 = 1 THEN 'missing terms zq zq' END,
    CASE WHEN len(odd) > 0 THEN 'invalid citations ' || array_to_string(odd, ', ') END, CASE WHEN conv_id % 5 = 0 THEN 'judge errors: context_recall' END) END AS reasons FROM {_SCORED}) WHERE reasons <> ''"""
)
def answers_failures(spark, sf_dir):
    """Every reason for which an answer can lose marks."""
    return scoring.failures(_score_records(spark, sf_dir, True))


@query(
    f"""SELECT type, metric, CASE WHEN value IS NULL THEN '–' WHEN metric IN ('hit_at_1', 'false_refusal_rate') THEN round_even(100 * value, 0)::BIGINT || '%' ELSE printf('%.3f', value) END AS score
    FROM (SELECT type, unnest(['hit_at_1', 'false_refusal_rate', 'mrr', 'context_recall', 'answer_recall']) AS metric, unnest([hit_at_1, false_refusal_rate, mrr, context_recall, answer_recall]) AS value FROM {_SUMMARY})"""
)
def answers_report(spark, sf_dir):
    return scoring.report_rows(scoring.summary(_score_records(spark, sf_dir, True)), ["hit_at_1", "false_refusal_rate"], ["mrr", "context_recall", "answer_recall"])


_RUN = """(SELECT concat_ws('-', conv_id, turn) AS id, conv_id, turn, text, conv_id % 6 = 1 AS bad, turn % 4 + 1 AS number FROM conversations WHERE role = 'assistant')"""


@query(
    f"""SELECT id, CASE WHEN bad THEN 'failed' ELSE 'ok' END AS state, CASE WHEN NOT bad THEN text || ' [' || number || ']' END AS answer, CASE WHEN NOT bad THEN id || '/' || number END AS cited, CASE WHEN NOT bad THEN 3 END::BIGINT AS n_retrieved,
    round_even(turn / 8.0, 3) AS latency_seconds, CASE WHEN NOT bad THEN round_even((10 * 0.75 + 5 * 4.5) / 1000000, 8) END AS cost, 5 AS top_k,
    CASE WHEN NOT bad THEN number <= 3 END AS known, CASE WHEN NOT bad THEN 'body of ' || id END AS body FROM {_RUN}"""
)
def saved_answers(spark, sf_dir):
    """A run as it is saved and as it is sent back: citations, lists, cost and settings; failures keep their error."""
    turns = A.table(spark, sf_dir, "conversations").filter("role = 'assistant'").withColumns({"id": F.concat_ws("-", "conv_id", "turn"), "number": F.col("turn") % 4 + 1})
    bad = F.col("conv_id") % 6 == 1
    asked = turns.select("id", F.concat("text", F.lit(" ["), F.col("number").cast("string"), F.lit("]")).alias("answer"), F.array().cast("array<int>").alias("cited_numbers"), (F.col("turn") / 8).alias("latency_seconds"), F.lit("t").alias("trace_id"), F.when(bad, "failed").alias("error"))
    found = turns.select(F.col("id").alias("query_id"), F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("rank")).select("query_id", "rank", (1 / F.col("rank")).alias("score"), F.concat_ws("/", "query_id", "rank").alias("chunk_id"), F.lit("http://s").alias("source_url"))
    zero = F.lit(0).cast("bigint")
    usage = F.struct(F.lit(10).cast("bigint").alias("input_tokens"), F.lit(5).cast("bigint").alias("output_tokens"), zero.alias("cached_input_tokens"), zero.alias("reasoning_tokens"))
    prices = spark.createDataFrame([("m", 0.75, 0.075, 4.5)], "model string, input double, cached_input double, output double")
    calls = answers.estimate_cost(turns.select("id", F.lit("m").alias("model"), usage.alias("usage")), prices)
    settings = {"retrieval_mode": "vector", "top_k": 5, "llm_model": "m", "prompt_version": "v1"}
    rows = answers.answer_rows(turns.select("id", F.lit("faq").alias("type"), F.col("text").alias("question")), asked, answers.build_citations(asked, found), found.filter("rank <= 3"), calls, settings)
    chunks = found.select("chunk_id", F.lit("T").alias("document_title"), F.array(F.lit("Up")).alias("breadcrumb"), F.array(F.lit("T"), F.lit("H")).alias("heading_path"), F.concat(F.lit("head\n\nbody of "), "query_id").alias("text"))
    sent = answers.response_json(rows, chunks)
    at = lambda path: F.get_json_object("response", path)
    return rows.join(sent, "id", "left").select(
        "id", F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("state"), "answer", F.get("citations", F.lit(0))["chunk_id"].alias("cited"), F.size("retrieved").cast("bigint").alias("n_retrieved"), "latency_seconds",
        F.bround("llm_cost_usd", 8).alias("cost"), F.col("settings.top_k").alias("top_k"), F.exists(F.from_json(at("$.retrieved[*].chunkId"), "array<string>"), lambda c: c == at("$.citations[0].chunkId")).alias("known"), at("$.citations[0].text").alias("body"),
    )


# ---- golden set


@query(
    """WITH g AS (SELECT item_id AS i, 'q' || item_id AS id FROM benchmark)
    SELECT id, 'unknown type' AS "check", 'odd' AS detail FROM g WHERE i % 8 = 0 UNION ALL SELECT id, 'empty question or answer', NULL FROM g WHERE i % 10 = 0
    UNION ALL SELECT id, 'unknown chunk', 'none' FROM g WHERE i % 6 = 0 UNION ALL SELECT id, 'quote not in chunk', i::VARCHAR FROM g WHERE i % 7 = 0 AND i % 6 <> 0
    UNION ALL SELECT id, 'source urls differ from the evidence', '' FROM g WHERE i % 6 = 0
    UNION ALL SELECT 'twice', 'duplicate id', (count(*) FILTER (i % 9 = 0))::VARCHAR FROM g HAVING count(*) FILTER (i % 9 = 0) > 1"""
)
def golden_faults(spark, sf_dir):
    """A golden set about the benchmark's items with planted faults of each kind."""
    items, i = A.table(spark, sf_dir, "benchmark"), F.col("item_id")
    name = i.cast("string")
    rows = items.select(
        F.concat(F.lit("q"), name).alias("id"),
        F.when(i % 8 == 0, "odd").otherwise("faq").alias("type"),
        F.when(i % 10 == 0, " ").otherwise("what").alias("question"),
        F.lit("that").alias("expected_answer"),
        F.array(F.struct(F.when(i % 7 == 0, "not in there \x01").otherwise(F.substring("text", 1, 30)).alias("quote"), F.array(F.when(i % 6 == 0, "none").otherwise(name)).alias("chunk_ids"))).alias("evidence"),
        F.array(F.lit("http://b")).alias("source_urls"),
        F.array().cast("array<string>").alias("required_terms"),
        F.lit(True).alias("answerable"),
        F.lit("").alias("notes"),
    )
    chunks = items.select(name.alias("chunk_id"), "text", F.lit("http://b").alias("source_url"))
    own = golden.golden_problems(rows, chunks)
    twice = golden.duplicate_questions(items.filter(i % 9 == 0).select(F.lit("twice").alias("id")))
    return own.unionByName(twice)


@query(
    """WITH g AS (SELECT item_id AS i, 'q' || item_id AS id FROM benchmark)
    SELECT '<no id>' AS id, 'not a record' AS "check", '[' || i || ']' AS detail FROM g WHERE i % 13 = 0
    UNION ALL SELECT id, 'missing or wrong type', 'required_terms: not a list' FROM g WHERE i % 5 = 0 AND i % 13 <> 0
    UNION ALL SELECT id, 'missing or wrong type', 'answerable: not a boolean' FROM g WHERE i % 7 = 0 AND i % 13 <> 0
    UNION ALL SELECT id, 'missing or wrong type', 'question: not a text' FROM g WHERE i % 11 = 0 AND i % 13 <> 0
    UNION ALL SELECT '<no id>', 'missing or wrong type', 'id: not a text' FROM g WHERE i % 17 = 0 AND i % 13 <> 0
    UNION ALL SELECT id, 'unknown chunk', 'gone' FROM g WHERE i % 3 = 0 AND NOT (i % 5 = 0 OR i % 7 = 0 OR i % 11 = 0 OR i % 13 = 0 OR i % 17 = 0)
    UNION ALL SELECT id, 'source urls differ from the evidence', '' FROM g WHERE i % 3 = 0 AND NOT (i % 5 = 0 OR i % 7 = 0 OR i % 11 = 0 OR i % 13 = 0 OR i % 17 = 0)"""
)
def golden_wrong_types(spark, sf_dir):
    """A stored golden set in which lists are texts, flags are numbers, ids are numbers, fields and records are missing."""
    items, i = A.table(spark, sf_dir, "benchmark"), F.col("item_id")
    name = i.cast("string")
    chunk = F.when(i % 3 == 0, "gone").otherwise(name)
    parts = {
        "id": F.when(i % 17 == 0, name).otherwise(F.concat(F.lit('"q'), name, F.lit('"'))),
        "type": F.lit('"faq"'),
        "question": F.when(i % 11 == 0, "null").otherwise('"what"'),
        "expected_answer": F.lit('"that"'),
        "evidence": F.to_json(F.array(F.struct(F.substring("text", 1, 30).alias("quote"), F.array(chunk).alias("chunk_ids")))),
        "source_urls": F.lit('["http://b"]'),
        "required_terms": F.when(i % 5 == 0, '"that"').otherwise("[]"),
        "answerable": F.when(i % 7 == 0, "1").otherwise("true"),
        "notes": F.lit('""'),
    }
    record = F.concat(F.lit("{"), F.concat_ws(", ", *(F.concat(F.lit(f'"{k}": '), v) for k, v in parts.items())), F.lit("}"))
    lines = items.select(F.when(i % 13 == 0, F.concat(F.lit("["), name, F.lit("]"))).otherwise(record).alias("value"))
    chunks = items.select(name.alias("chunk_id"), "text", F.lit("http://b").alias("source_url"))
    return golden.golden_problems_of_lines(lines, chunks)


# ---- stored tables


@query(r"SELECT regexp_extract(url, '^[a-z]+://([^/]+)/', 1) AS host, (page_id % 3)::VARCHAR AS part, url AS text FROM pages WHERE regexp_extract(url, '^[a-z]+://([^/]+)/', 1) <> ''")
def page_tree(spark, sf_dir):
    """Pages as a tree of files, a file for each, and read back with what their paths say."""
    root = f"{shared_folder(spark)}/page-tree-{uuid.uuid4().hex}"
    host = F.regexp_extract("url", r"^[a-z]+://([^/]+)/", 1)
    pages = A.table(spark, sf_dir, "pages").select(host.alias("host"), (F.col("page_id") % 3).cast("string").alias("part"), F.col("url").alias("text")).filter("host <> ''")
    write_page_tree(pages, root, "host", "part")
    of = lambda c: F.url_decode(F.regexp_extract("path", f"/{c}=([^/]+)/", 1)).alias(c)
    return read_page_tree(spark, root, "*.txt").select(of("host"), of("part"), F.replace("text", F.lit("\x00"), F.lit("")).alias("text"))


@query("SELECT doc_id, 'second' AS made FROM documents WHERE doc_id % 2 = 0")
def index_rebuild(spark, sf_dir):
    """A table that is built, rebuilt with fewer rows, and rebuilt once more but broken off before its commit."""
    path = f"{shared_folder(spark)}/rebuilt-{uuid.uuid4().hex}"
    docs = A.table(spark, sf_dir, "documents").select("doc_id")
    rebuild_table(docs.withColumn("made", F.lit("first")), path)
    last = rebuild_table(docs.filter("doc_id % 2 = 0").withColumn("made", F.lit("second")), path)
    docs.withColumn("made", F.lit("broken off")).write.parquet(f"{path}/versions/{last + 1}")
    return read_rebuilt(spark, path)
