"""Pages, sections and chunks made of the suppliers, of which SQL can say what must come out."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.jobs import adapters as A
from lodestone.jobs.base import TOKENS_SQL
from lodestone.jobs.catalog import query
from lodestone.operators import chunking, retrieval, sections
from lodestone.sources import tables

_MARKS = (("@KEY", "s_suppkey"), ("@NAME", "s_name"))


def _column(text: str) -> Column:
    """A text with the marks filled in."""
    out = F.lit(text)
    for mark, name in _MARKS:
        out = F.replace(out, F.lit(mark), F.col(name).cast("string"))
    return out


def _sql(text: str) -> str:
    text = "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for mark, name in _MARKS:
        text = text.replace(mark, f"' || {name} || '")
    return f"({text})"


def _rows(rows: list[tuple], names: str, where: str = "true") -> str:
    cell = lambda v: _sql(v) if isinstance(v, str) else "NULL" if v is None else str(v)
    return " UNION ALL ".join("SELECT " + ", ".join(f"{cell(v)} AS {n}" for v, n in zip(row, names.split(", "))) + f" FROM supplier WHERE {where}" for row in rows)


# ---- cleaning and sections


@query(_rows([(i, t) for i, t in enumerate(["run ls -l of @NAME now", "both marks of @NAME", "Product (@NAME) and Product 9, space.vars.other_x", "kept @NAME"])], "case_no, clean"))
def inline_code_and_variables(spark, sf_dir):
    """Inline HTML unwrapped, variables by their texts: longer names first, escaped or not, any case."""
    cases = ["run <code class=\"x\">ls -l</code> of @NAME now", "both <mark style=\"a\">marks</mark> of @NAME", "space.vars.product\\_name (@NAME) and <code class=\"expression\">SPACE.VARS.product</code> 9, space.vars.other\\_x", "{% tab title=\"a\" %}kept @NAME{% endtab %}"]
    variables = [("product", "Product"), ("product_name", "Product")]
    made = A.table(spark, sf_dir, "supplier").select(F.posexplode(F.array(*map(_column, cases))).alias("case_no", "text"))
    return made.select("case_no", T.clean_markdown(F.col("text"), variables).alias("clean"))


_PAGE = "before @NAME\n# Top @KEY\nfirst [line](http://a)\nsecond\n\n## Deep\n\n```py\n# no heading\n\nx = @KEY\n```\n\n### Deeper\n| a | b |\n|---|---|\n| @KEY |\n\n## Empty\n\n## Lists\n- i @NAME\n- *j*\n\n1. one\n\n# Second top\nend"


@query(
    _rows(
        [
            ("p@KEY:section:1", "Top @KEY", "", "paragraph", "before @NAME"),
            ("p@KEY:section:2", "Top @KEY", "Top @KEY", "paragraph", "first line\nsecond"),
            ("p@KEY:section:3", "Deep", "Top @KEY > Deep", "code", "```py\n# no heading\n\nx = @KEY\n```"),
            ("p@KEY:section:4", "Deeper", "Top @KEY > Deep > Deeper", "table", "| a | b |\n| --- | --- |\n| @KEY |  |"),
            ("p@KEY:section:5", "Lists", "Top @KEY > Lists", "list", "- i @NAME\n- j\n\n1. one"),
            ("p@KEY:section:6", "Second top", "Second top", "paragraph", "end"),
        ],
        "section_id, heading, path, kinds, content",
    )
)
def markdown_sections(spark, sf_dir):
    """Headings of several levels, code that looks like a heading, a short table row, lists, an empty section."""
    name = F.concat(F.lit("p"), F.col("s_suppkey").cast("string"))
    pages = A.table(spark, sf_dir, "supplier").select(F.concat(F.lit("http://x/"), name).alias("url"), name.alias("document_id"), _column(_PAGE).alias("text"), F.array().cast("array<string>").alias("breadcrumb"))
    return sections.parse_sections(pages).select("section_id", "heading", F.array_join("heading_path", " > ").alias("path"), F.array_join("block_types", ",").alias("kinds"), "content")


# ---- chunks: small sections that merge, a glossary, an API page with a page above it

_G = "http://x/@KEY/glossary-of-terms"
#: document, url, breadcrumb, heading path, kinds, content.
_SECTIONS = [
    ("m@KEY", "http://x/@KEY/m", "", "T > A > x", "paragraph", "first @NAME"),
    ("m@KEY", "http://x/@KEY/m", "", "T > A > y", "paragraph", "second"),
    ("m@KEY", "http://x/@KEY/m", "", "T > B", "list", "- tail\n- end"),
    ("m@KEY", "http://x/@KEY/m", "", "T > C", "html", "nav"),
    ("m@KEY", "http://x/@KEY/m", "", "T > D", "paragraph", " "),
    ("g@KEY", _G, "Up", "T", "paragraph", "A B C"),
    ("g@KEY", _G, "Up", "T > LB", "paragraph", "See Balancer."),
    ("g@KEY", _G, "Up", "T > Balancer (ALB)", "paragraph", "It balances @NAME."),
    ("g@KEY", _G, "Up", "T > L", "paragraph", "See Nothing"),
    ("r@KEY", "http://x/@KEY/r", "Up", "Page", "paragraph", "text of @NAME"),
    ("s@KEY", "http://x/@KEY/r/n", "Up", "Make", "api_spec", 'API: Store @KEY\n\nGET /n\n\nbody\n\n```json\n{"openapi": "3"}\n```'),
]
_CHUNKS = [
    ("m@KEY:chunk:0", "m@KEY:section:1,m@KEY:section:2,m@KEY:section:3", "T", "list,paragraph", "T\n\n## A > x\n\nfirst @NAME\n\n## A > y\n\nsecond\n\n## B\n\n- tail\n- end"),
    ("g@KEY:chunk:0", "g@KEY:section:3,g@KEY:section:2", "T > Balancer (ALB)", "paragraph", "Up > T > Balancer (ALB)\n\nIt balances @NAME.\n\nAlso known as: LB."),
    ("g@KEY:chunk:1", "g@KEY:section:4", "T > L", "paragraph", "Up > T > L\n\nSee Nothing"),
    ("r@KEY:chunk:0", "r@KEY:section:1", "Page", "paragraph", "Up > Store @KEY > Page\n\ntext of @NAME"),
    ("s@KEY:chunk:0", "s@KEY:section:1", "Make", "paragraph", "Up > Store @KEY > Make (GET /n)\n\nAPI: Store @KEY\n\nGET /n\n\nbody"),
]


def planted_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, n = [], {}
    for document, url, crumbs, path, kinds, content in _SECTIONS:
        n[document] = n.get(document, 0) + 1
        steps = path.split(" > ")
        made.append(
            F.struct(
                _column(f"{document}:section:{n[document]}").alias("section_id"), F.lit("T").alias("document_title"), F.lit("").alias("source_file"), _column(url).alias("source_url"),
                F.array(*map(F.lit, [crumbs] if crumbs else [])).cast("array<string>").alias("breadcrumb"), F.lit(steps[-1]).alias("heading"), F.array(*map(F.lit, steps)).alias("heading_path"),
                F.array(F.lit(kinds)).alias("block_types"), _column(content).alias("content"), F.lit(n[document]).alias("section_no"),
            )
        )
    return A.table(spark, sf_dir, "supplier").select(F.inline(F.array(*made)))


@query(f"SELECT chunk_id, section_ids, path, kinds, text, {TOKENS_SQL}::INT AS token_count FROM ({_rows(_CHUNKS, 'chunk_id, section_ids, path, kinds, text')})")
def chunks_of_sections(spark, sf_dir):
    """The whole job over stored sections: merged and absorbed ones, aliases, inherited API titles, drops."""
    made = chunking.chunk_sections(planted_sections(spark, sf_dir))
    return made.select("chunk_id", F.array_join("section_ids", ",").alias("section_ids"), F.array_join("heading_path", " > ").alias("path"), F.array_join("block_types", ",").alias("kinds"), "text", "token_count")


@query("SELECT what, n * (SELECT count(*) FROM supplier) AS n FROM (VALUES ('documents', 4), ('sections', 11), ('chunks', 5), ('dropped: html without a link', 1), ('dropped: empty', 1), ('dropped: glossary index', 1), ('dropped: folded into its target', 1), ('dropped: raw specification', 1)) v(what, n)")
def chunk_drops(spark, sf_dir):
    """What chunking counts: documents, sections, chunks, and drops by their reason."""
    documents = chunking.by_document(planted_sections(spark, sf_dir)).withColumn("inherited_api", F.lit(None).cast("string"))
    return chunking.chunk_totals(documents)


_WORDS = 150
#: Suppliers to a task, each of four blocks.
_BLOCKS = 250


@query(
    f"""WITH s AS (SELECT s_suppkey, unnest(range(0, {_WORDS})) AS i FROM supplier)
    SELECT 'prose' AS kind, s_suppkey AS key, i, 'Sentence ' || i || ' of ' || s_suppkey || ' has w w w w w w w w.' AS unit FROM s
    UNION ALL SELECT 'code', s_suppkey, i, 'x' || i || ' = ' || s_suppkey || ' + w w w w w w w w w' FROM s
    UNION ALL SELECT 'list', s_suppkey, i, '- item ' || i || ' of ' || s_suppkey || ' w w w w w w w w' FROM s
    UNION ALL SELECT 'table', s_suppkey, i, '| row ' || i || ' | ' || s_suppkey || ' w w w w w w w w |' FROM s"""
)
def split_blocks_whole(spark, sf_dir):
    """Blocks over the maximum: each sentence, line, item and row is in some chunk, whole; once, but for the overlap."""
    base = A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"))
    # a small file, read by one task, makes much text
    base = base.repartition(max(spark.sparkContext.defaultParallelism, -(-base.count() // _BLOCKS)), "key")
    key, numbers = F.col("key").cast("string"), F.sequence(F.lit(0), F.lit(_WORDS - 1))
    unit = {
        "prose": lambda i: F.concat(F.lit("Sentence "), i, F.lit(" of "), key, F.lit(" has w w w w w w w w.")),
        "code": lambda i: F.concat(F.lit("x"), i, F.lit(" = "), key, F.lit(" + w w w w w w w w w")),
        "list": lambda i: F.concat(F.lit("- item "), i, F.lit(" of "), key, F.lit(" w w w w w w w w")),
        "table": lambda i: F.concat(F.lit("| row "), i, F.lit(" | "), key, F.lit(" w w w w w w w w |")),
    }
    around = {"prose": ("", " ", ""), "code": ("```txt\n", "\n", "\n```"), "list": ("", "\n", ""), "table": ("| h | i |\n| --- | --- |\n", "\n", "")}
    parts = []
    for kind, (before, glue, after) in around.items():
        block = F.concat(F.lit("The block:\n\n"), F.lit(before), F.array_join(F.transform(numbers, unit[kind]), glue), F.lit(after))
        section = F.struct(
            F.lit(1).alias("section_no"), F.concat(F.lit(f"{kind}:"), key).alias("section_id"), F.lit("T").alias("document_title"), F.lit("http://x").alias("source_url"), F.array().cast("array<string>").alias("breadcrumb"),
            F.lit("H").alias("heading"), F.array(F.lit("T"), F.lit("H")).alias("heading_path"), F.array(F.lit("paragraph")).alias("block_types"), block.alias("content"),
        )
        parts.append(F.struct(F.concat(F.lit(f"{kind}:"), key).alias("document"), F.lit(None).cast("string").alias("inherited_api"), F.array(section).alias("sections")))
    made = chunking.chunk_documents(base.select(F.inline(F.array(*parts))))
    kind, own = (F.regexp_extract("chunk_id", r"^(\w+):(\d+):", group) for group in (1, 2))
    pattern = r"(?m)(Sentence \d+ of \d+ has[ w]+\.|^x\d+ = \d+ \+[ w]+$|^- item \d+ of \d+[ w]+$|^\| row \d+ \| \d+[ w]+ \|$)"
    # the kind comes first, so that each chunk's text is made and counted for one of the two only
    units = lambda of: made.filter(of).filter(f"token_count <= {chunking.MAXIMUM}").select(kind.alias("kind"), own.cast("long").alias("key"), F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("unit"))
    once = units(kind != "prose").unionByName(units(kind == "prose").distinct())
    return once.select("kind", "key", F.regexp_extract("unit", r"(\d+)", 1).cast("long").alias("i"), "unit")


# ---- stored tables, index, retrieval


@query("SELECT doc_id, source, lang, text FROM documents")
def json_lines_round_trip(spark, sf_dir):
    """Rows written as JSON lines with blank lines among them, and read by a declared schema."""
    path = f"{tables.shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    docs = A.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    tables.write_table(docs, f"{path}/rows", "json")
    spark.read.text(f"{path}/rows").select(F.explode(F.array("value", F.lit(""))).alias("value")).write.text(f"{path}/lines")
    return tables.read_json_lines(spark, f"{path}/lines", "doc_id long, source string, lang string, text string")


@query("SELECT '- see (' || url || '.md)' AS value FROM pages")
def url_index_lines(spark, sf_dir):
    path = f"{tables.shared_folder(spark)}/index-{uuid.uuid4().hex}"
    A.table(spark, sf_dir, "pages").select(F.concat(F.lit("- see ("), "url", F.lit(".md)")).alias("value")).write.text(path)
    return tables.read_url_index(spark, path)


@query("SELECT 'docs' AS collection, 'm' AS embedding_model, 'cosine' AS distance, (SELECT count(*) FROM documents) AS documents, (SELECT max(len(embedding)) FROM embeddings)::INT AS embedding_dimension, true AS dated, true AS same")
def index_manifest(spark, sf_dir):
    """What a built index says of itself; the checksum is that of the same rows in any order."""
    docs = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("page_content"))
    made = tables.index_manifest(docs, A.table(spark, sf_dir, "embeddings"), "docs", "m")
    again = tables.checksum(docs.repartition(7, "page_content"), ["id", "page_content"]).select("checksum")
    return made.join(F.broadcast(again)).select("collection", "embedding_model", "distance", "documents", "embedding_dimension", F.col("created_at").isNotNull().alias("dated"), (F.col("chunks_sha256") == F.col("checksum")).alias("same"))


_AXES = "[(x % 7)::DOUBLE, (x % 5)::DOUBLE, 1.0]"


@query(
    f"""WITH q AS (SELECT conv_id || '-' || turn AS query_id, conv_id + turn AS x FROM conversations WHERE turn = 0), c AS (SELECT doc_id, doc_id AS x FROM documents)
    SELECT query_id, rank, chunk_id, round_even(score, 4) AS score FROM (SELECT query_id, doc_id AS chunk_id, list_cosine_similarity(q.v, c.v) AS score,
    (row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q.v, c.v), 12) DESC, doc_id))::INT AS rank
    FROM (SELECT query_id, {_AXES} AS v FROM q) q, (SELECT doc_id, {_AXES} AS v FROM c) c) WHERE rank <= 3"""
)
def retrieve_questions(spark, sf_dir):
    """The retrieval job from question texts: embedded by a function (here of the number that a text holds), then top k."""

    def embedder(texts: list[str]) -> list[list[float]]:
        return [[float(int(t) % 7), float(int(t) % 5), 1.0] for t in texts]

    asked = A.table(spark, sf_dir, "conversations").filter("turn = 0").select(F.concat_ws("-", "conv_id", "turn").alias("id"), (F.col("conv_id") + F.col("turn")).cast("string").alias("question"))
    docs = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("http://"), "source").alias("source_url"), F.col("doc_id").cast("string").alias("text"))
    return retrieval.retrieve(asked, retrieval.embed(docs, embedder), embedder, 3).select("query_id", "rank", "chunk_id", "score")
