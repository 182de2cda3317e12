"""Prompts, citations, token usage and cost: the data on both sides of an answering model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.scoring import marker_numbers

COUNTERS = ("input_tokens", "output_tokens", "cached_input_tokens", "reasoning_tokens")


def format_sources(retrieved: DataFrame) -> DataFrame:
    """query_id, sources: all retrieved chunks as numbered sources in order of rank.

    retrieved: query_id, rank, source_url, text.
    """
    entry = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] (source: "), F.col("source_url"), F.lit(")\n"), F.col("text"))
    entries = F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry"))))
    return retrieved.groupBy("query_id").agg(F.array_join(F.transform(entries, lambda e: e["entry"]), "\n\n").alias("sources"))


def render_prompt(questions: DataFrame, prompts: DataFrame, version: str) -> DataFrame:
    """Adds system and user messages of a template version; an unknown version is an error.

    questions: question, sources; prompts: version, system, user with {sources} and {question}.
    """
    template = prompts.filter(F.col("version") == version).select("system", "user").first()
    if template is None:
        raise ValueError(f"there is no prompt version {version!r}")
    filled = F.replace(F.replace(F.lit(template.user), F.lit("{sources}"), F.col("sources")), F.lit("{question}"), F.col("question"))
    return questions.withColumns({"system": F.lit(template.system), "user": filled})


def chunk_body(text: Column) -> Column:
    """The text below its header line and the empty line; the header if there is nothing below."""
    at = F.instr(text, "\n\n")
    body = F.when(at > 0, F.substr(text, at + 2))
    head = F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(text)
    return F.coalesce(F.nullif(body, F.lit("")), head)


def build_citations(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    """id, place, number, chunk_id, source_url: the sources that an answer cites, in order of appearance.

    Numbers come from the [n] of the text, then from ``cited_numbers``; each once, within what was retrieved.
    answers: id, answer, cited_numbers array<int>; retrieved: query_id, rank, chunk_id, source_url.
    """
    numbers = F.array_distinct(F.concat(marker_numbers(F.col("answer")), F.coalesce(F.col("cited_numbers").cast("array<bigint>"), F.array().cast("array<bigint>"))))
    cited = answers.select("id", F.posexplode(F.filter(numbers, lambda n: n >= 1)).alias("pos", "number"))
    sources = retrieved.select(F.col("query_id").alias("id"), F.col("rank").cast("bigint").alias("number"), "chunk_id", "source_url")
    return cited.join(sources, ["id", "number"]).select("id", "pos", "number", "chunk_id", "source_url")


def token_usage(usage: Column) -> Column:
    """The four counters of a usage record, missing ones 0."""
    return F.struct(*(F.coalesce(usage[c].cast("bigint"), F.lit(0).cast("bigint")).alias(c) for c in COUNTERS))


def cost_usd(usage: Column) -> Column:
    """Cost by the columns input, cached_input and output (USD per million tokens); null without a price."""
    count = lambda c: F.coalesce(usage[c], F.lit(0))
    fresh = count("input_tokens") - count("cached_input_tokens")
    return (fresh * F.col("input") + count("cached_input_tokens") * F.col("cached_input") + count("output_tokens") * F.col("output")) / 1_000_000


def estimate_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds cost_usd; prices: model, input, cached_input, output, a short list."""
    return calls.join(F.broadcast(prices), "model", "left").withColumn("cost_usd", cost_usd(F.col("usage"))).drop("input", "cached_input", "output")


def answer_rows(questions: DataFrame, answers: DataFrame, citations: DataFrame, retrieved: DataFrame, calls: DataFrame, settings: dict[str, str | int]) -> DataFrame:
    """One row a question of a run, as it is saved: the answer with its citations, what was retrieved, time, usage, cost and
    the run's settings.  A question that failed keeps its error and time, and nothing of an answer.

    questions: id, type, question; answers: id, answer, cited_numbers, latency_seconds, trace_id, error; citations: of
    build_citations; retrieved: query_id, rank, score, chunk_id, source_url; calls: of estimate_cost with id.
    """
    cites = citations.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "number", "chunk_id", F.col("source_url").alias("url")))).alias("c"))
    lists = retrieved.groupBy(F.col("query_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", F.bround("score", 4).alias("score"), "chunk_id", "source_url"))).alias("r"))
    rows = questions.select("id", "type", "question").join(answers, "id", "left").join(cites, "id", "left").join(lists, "id", "left").join(calls.select("id", "usage", "cost_usd"), "id", "left")
    fine = F.col("error").isNull()
    cited = F.coalesce(F.transform("c", lambda c: F.struct(c["number"], c["chunk_id"], c["url"])), F.array().cast("array<struct<number: bigint, chunk_id: string, url: string>>"))
    return rows.select(
        "id", "type", "question", F.when(fine, F.col("answer")).alias("answer"), F.when(fine, cited).alias("citations"), F.when(fine, F.col("cited_numbers")).alias("cited_numbers_from_llm"),
        F.when(fine, F.col("r")).alias("retrieved"), F.bround("latency_seconds", 3).alias("latency_seconds"), F.when(fine, token_usage(F.col("usage"))).alias("llm_token_usage"),
        F.when(fine, F.col("cost_usd")).alias("llm_cost_usd"), F.when(fine, F.col("trace_id")).alias("trace_id"), "error", F.struct(*(F.lit(v).alias(k) for k, v in settings.items())).alias("settings"),
    )


def response_json(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, response: answered rows in the shape that is sent back to a caller, the cited chunks with their place and body.

    rows: of answer_rows, with retrieval_mode, top_k, llm_model and prompt_version in its settings; chunks: chunk_id,
    document_title, breadcrumb, heading_path, text.
    """
    answered = rows.filter("error is null")
    about = chunks.select("chunk_id", F.col("document_title").alias("title"), "breadcrumb", "heading_path", chunk_body(F.col("text")).alias("body"), F.substring_index("text", "\n", 1).alias("header"))
    cited = answered.select("id", F.posexplode("citations").alias("pos", "c")).select("id", "pos", "c.*").join(about, "chunk_id")
    one = F.struct("number", F.col("chunk_id").alias("chunkId"), "title", "breadcrumb", F.col("heading_path").alias("headingPath"), "url", F.col("body").alias("text"))
    citations = cited.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", one.alias("c")))).alias("cited")).select("id", F.col("cited.c").alias("cited"))
    found = answered.select("id", F.explode("retrieved").alias("r")).select("id", "r.*").join(about.select("chunk_id", "header"), "chunk_id")
    lists = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "score", F.col("chunk_id").alias("chunkId"), F.col("source_url").alias("url"), "header"))).alias("found"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    shown = answered.select("id", "answer", "settings", "latency_seconds", "trace_id").join(citations, "id", "left").join(lists, "id", "left")
    kinds = {f.name: f.dataType for f in shown.schema.fields}
    meta = {"retrievalMode": "settings.retrieval_mode", "topK": "settings.top_k", "llmModel": "settings.llm_model", "promptVersion": "settings.prompt_version"}
    return shown.select(
        "id",
        F.to_json(
            F.struct(
                "answer", none(F.col("cited"), kinds["cited"]).alias("citations"), none(F.col("found"), kinds["found"]).alias("retrieved"),
                F.struct(*(F.col(v).alias(k) for k, v in meta.items()), F.bround("latency_seconds", 2).alias("latencySeconds"), F.col("trace_id").alias("traceId")).alias("meta"),
            ),
            {"ignoreNullFields": "false"},
        ).alias("response"),
    )
