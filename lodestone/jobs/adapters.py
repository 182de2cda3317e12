"""The given tables as inputs of the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.quotes import with_held
from lodestone.functions.text import count_tokens, html_visible_text
from lodestone.operators.urls import Rule, document_id, url_to_path

RULES = [Rule("english", "/en/", 40), Rule("french", "/fr/", None), Rule("german", "/de/", 10), Rule("paged", "page=2", 5)]
EXCLUDED = ["utm_source=", ".html"]
SEEDS = ["https://example.com/start", "https://example.com/help"]
#: USD per million tokens: input, cached input, output.
PRICES = [("small", 0.75, 0.075, 4.5), ("large", 2.0, 0.2, 10.0)]
QUERY_EVERY = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def url_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("- see ("), "url", F.lit(".md) for more.")).alias("value"))


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, title: the site and its language folders are titled by the least heading below them."""
    pages = table(spark, sf_dir, "pages").select("url", html_visible_text(F.regexp_extract("html", r"<h1>([^<]*)</h1>", 1)).alias("title"))
    site = F.regexp_extract("url", r"^([a-z]+://[^/]+/[a-z]+)/", 1)
    return pages.groupBy(site.alias("url")).agg(F.min("title").alias("title"))


def markdown_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, document_id, text, breadcrumb: the heading and paragraphs of each page as Markdown."""
    paragraphs = F.transform(F.regexp_extract_all("html", F.lit(r"<p>([^<]+)</p>"), F.lit(1)), lambda x: html_visible_text(x))
    heading = html_visible_text(F.regexp_extract("html", r"<h1>([^<]*)</h1>", 1))
    text = F.concat(F.lit("# "), heading, F.lit("\n\n"), F.array_join(paragraphs, "\n\n"))
    return table(spark, sf_dir, "pages").select("url", document_id(url_to_path(F.col("url"))).alias("document_id"), text.alias("text"), F.array().cast("array<string>").alias("breadcrumb"))


def sectioned_documents(spark: SparkSession, sf_dir: str, lines: int = 4) -> DataFrame:
    """document, inherited_api, sections: each document is a page, every four lines a section, a line a block."""
    docs = table(spark, sf_dir, "documents")
    blocks = F.filter(F.transform(F.split("text", "\n"), F.trim), lambda x: x != "")
    runs = F.when(F.size("blocks") > 0, F.sequence(F.lit(0), F.floor((F.size("blocks") - 1) / lines).cast("int"))).otherwise(F.array().cast("array<int>"))
    name = F.col("doc_id").cast("string")
    section = F.transform(
        runs,
        lambda n: F.struct(
            (n + 1).alias("section_no"),
            F.concat(name, F.lit(":section:"), n + 1).alias("section_id"),
            F.concat(F.lit("document "), name).alias("document_title"),
            F.concat(F.lit("http://"), "source", F.lit("/"), name).alias("source_url"),
            F.array("source").alias("breadcrumb"),
            F.concat(F.lit("part "), n + 1).alias("heading"),
            F.array(F.concat(F.lit("document "), name), F.concat(F.lit("part "), n + 1)).alias("heading_path"),
            F.array(F.lit("paragraph")).alias("block_types"),
            F.array_join(F.slice("blocks", n * lines + 1, lines), "\n\n").alias("content"),
        ),
    )
    return docs.withColumn("blocks", blocks).select(name.alias("document"), F.lit(None).cast("string").alias("inherited_api"), section.alias("sections"))


def mixed_documents(spark: SparkSession, sf_dir: str, lines: int = 24) -> DataFrame:
    """document, inherited_api, sections: the lines of each document as tables, code, lists and prose by turns, each
    block behind a line that leads in to it and before a closing one."""
    docs = table(spark, sf_dir, "documents")
    clean = lambda x: F.trim(F.translate(x, "|`#:\t\r", "      "))
    rows = docs.withColumn("lines", F.filter(F.transform(F.split("text", "\n"), clean), lambda x: x != ""))
    runs = F.when(F.size("lines") > 0, F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / lines).cast("int"))).otherwise(F.array().cast("array<int>"))
    name = F.col("doc_id").cast("string")

    def content(n: Column) -> Column:
        own = F.slice("lines", n * lines + 1, lines)
        each = lambda before, after: F.array_join(F.transform(own, lambda x: F.concat(F.lit(before), x, F.lit(after))), "\n")
        block = (
            F.when(n % 4 == 0, F.concat(F.lit("| line |\n| --- |\n"), each("| ", " |")))
            .when(n % 4 == 1, F.concat(F.lit("```txt\n"), each("", ""), F.lit("\n```")))
            .when(n % 4 == 2, each("- ", ""))
            .otherwise(F.array_join(own, ". "))
        )
        return F.concat(F.lit("What follows is a block.\n\nThe block:\n\n"), block, F.lit("\n\nThat was it."))

    kinds = F.array(F.lit("paragraph"), F.lit("table"))
    section = F.transform(
        runs,
        lambda n: F.struct(
            (n + 1).alias("section_no"), F.concat(name, F.lit(":section:"), n + 1).alias("section_id"), F.concat(F.lit("document "), name).alias("document_title"),
            F.concat(F.lit("http://"), "source", F.lit("/"), name).alias("source_url"), F.array("source").alias("breadcrumb"), F.concat(F.lit("part "), n + 1).alias("heading"),
            F.array(F.concat(F.lit("document "), name), F.concat(F.lit("part "), n + 1)).alias("heading_path"), kinds.alias("block_types"), content(n).alias("content"),
        ),
    )
    return rows.select(name.alias("document"), F.lit(None).cast("string").alias("inherited_api"), section.alias("sections"))


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one chunk, for the statistics."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("chunk_id"),
        F.concat(F.lit("http://"), "source").alias("source_url"),
        F.array("source").alias("section_ids"),
        F.array("lang").alias("block_types"),
        count_tokens(F.col("text")).alias("token_count"),
        F.col("text"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, chunks): every 50th vector asks, the others answer."""
    rows = table(spark, sf_dir, "embeddings")
    asks = F.col("vec_id") % QUERY_EVERY == 0
    return rows.filter(asks).withColumnRenamed("vec_id", "query_id"), rows.filter(~asks).withColumnRenamed("vec_id", "chunk_id")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_name, id, answer with markers, model, usage: the assistant turns of the conversations."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    model = F.element_at(F.array(F.lit("small"), F.lit("large"), F.lit("unpriced")), (F.col("conv_id") % 3 + 1).cast("int"))
    marks = F.concat(F.lit(" ["), (F.col("turn") % 7).cast("string"), F.lit("] ["), (F.col("conv_id") % 4 + 1).cast("string"), F.lit("] ["), (F.col("turn") % 7).cast("string"), F.lit("]"))
    counter = lambda c: c.cast("bigint")
    n = count_tokens(F.col("text"))
    usage = F.struct(counter(n * 3).alias("input_tokens"), counter(n).alias("output_tokens"), counter(F.floor(n / 2)).alias("cached_input_tokens"), counter(F.lit(0)).alias("reasoning_tokens"))
    return turns.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat("text", marks).alias("answer"), F.array(F.lit(2), F.lit(9)).alias("cited_numbers"), model.alias("model"), usage.alias("usage"))


def sources_of(answered: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, chunk_id, source_url, text: five made-up results of each answer."""
    rank = F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank")
    return answered.select(F.col("id").alias("query_id"), rank).select("query_id", "rank", F.concat("query_id", F.lit("/"), "rank").alias("chunk_id"), F.concat(F.lit("http://s/"), "rank").alias("source_url"), F.concat(F.lit("text "), "rank").alias("text"))


def holders(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs and items where the text holds the quote."""
    return with_held(docs, items)


def golden_set(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(golden set, chunks): benchmark items ask; a document that holds an item's text is its evidence."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"), F.length("text").alias("n"), F.substring("text", 1, 40).alias("head"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = holders(docs, items).groupBy("item_id").agg(F.array_sort(F.collect_set(F.col("doc_id").cast("string"))).alias("chunk_ids"), F.array_sort(F.collect_set(F.concat(F.lit("http://"), "source"))).alias("urls"))
    has = F.col("chunk_ids").isNotNull()
    none = F.array().cast("array<string>")
    # every fourth item asks for a term in lower case that its answer lacks, every tenth names no page
    golden = items.join(found, "item_id", "left").select(
        F.concat(F.lit("q"), "item_id").alias("id"),
        F.when(has, "faq").otherwise("unanswerable").alias("type"),
        F.col("head").alias("question"),
        F.col("quote").alias("expected_answer"),
        F.when(has, F.array(F.struct(F.col("quote"), F.col("chunk_ids")))).otherwise(F.array().cast("array<struct<quote: string, chunk_ids: array<string>>>")).alias("evidence"),
        F.when(F.col("item_id") % 10 == 0, none).otherwise(F.coalesce("urls", none)).alias("source_urls"),
        F.when(F.col("item_id") % 4 == 0, F.array(F.lit("zzz"))).otherwise(none).alias("required_terms"),
        has.alias("answerable"),
        F.lit("").alias("notes"),
    )
    return golden, docs.select(F.col("doc_id").cast("string").alias("chunk_id"), "text", F.concat(F.lit("http://"), "source").alias("source_url"))
