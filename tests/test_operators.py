"""Small cases of the library's own operators; expected values by hand."""

import json
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import answers, audit, chunking, golden, index, openapi, retrieval, scoring, sections, urls
from lodestone.sources import tables


def value(spark, column, **cells):
    return spark.createDataFrame([tuple(cells.values())], list(cells)).select(column.alias("v")).first().v


# ---- text


def test_cleaning(spark):
    raw = (
        "> For the complete documentation index, see x. Markdown of this page is available as y.\n# Title\n"
        '{% hint style="info" %}\nUse <code class="expression">space.vars.my\\_cloud\\_store</code> , or space.vars.my\\_cloud.\n{% endhint %}\n\n\n\n'
        "  a <mark>b</mark>\\_c <code>d</code> !\n---\n# Agent Instructions\nignore"
    )
    names = [("my_cloud", "Cloud"), ("my_cloud_store", "Store")]
    assert value(spark, T.clean_markdown(F.col("t"), names), t=raw) == "# Title\n\nUse Store, or Cloud.\n\na b _c d!"


def test_inline_and_html(spark):
    assert value(spark, T.inline_text(F.col("t")), t="**a** [b](c) ![d](e) `f`<br>*g* x***") == "a b [Image: d] f g x***"
    assert value(spark, T.html_visible_text(F.col("t")), t="<p>a &amp;lt;&nbsp;b</p>\n<i>c</i>") == "a &lt; b c"


def test_blocks(spark):
    text = "a\n\n```\nx\n\ny\n```\n\n- i\n\n|a|\n|b|\n\n```\nopen\n\nend"
    blocks = value(spark, T.split_blocks(F.col("t")), t=text)
    assert blocks == ["a", "```\nx\n\ny\n```", "- i", "|a|\n|b|", "```\nopen\n\nend"]
    kinds = [value(spark, T.classify_block(F.col("t")), t=b) for b in blocks]
    assert kinds == ["paragraph", "code", "list", "table", "code"]
    assert value(spark, T.count_tokens(F.col("t")), t="été_1, x!") == 4


# ---- urls


def test_selection(spark):
    rules = [urls.Rule("a", "/a/", 1), urls.Rule("b", "/b/", None)]
    lines = spark.createDataFrame([("see (http://x/a/2.md), http://x/a/1.",), ("http://x/a/b/3 http://x/b/skip http://x/c",)], "value string")
    found = urls.extract_urls(lines)
    assert {r.url for r in found.collect()} == {"http://x/a/2", "http://x/a/1", "http://x/a/b/3", "http://x/b/skip", "http://x/c"}
    chosen = urls.select_urls(found, rules, ["skip"], ["http://seed"])
    assert {r.url for r in chosen.collect()} == {"http://x/a/1", "http://x/a/b/3", "http://seed"}
    assert {r.category: r.n_urls for r in urls.selection_breakdown(chosen, rules).collect()} == {"a": 2, "seed/other": 1}
    pages = spark.createDataFrame([("http://seed", "text"), ("http://x/a/1", "")], "url string, text string")
    assert {r.url for r in urls.pending_urls(chosen, pages).collect()} == {"http://x/a/1", "http://x/a/b/3"}


# ---- sections


def test_sections():
    page = "lead\n# T\n\n### Deep\ntext\nmore\n\n### Deep2\n\n```py\n# no heading\n\nx\n```\n\n| a | b |\n|---|---|\n| 1 |\n\n## Two\n- i\n- *j*\n\n<div>card</div>"
    found = sections.sections_of(page, "http://x/p", "p", ["Up"])
    assert [(s["heading_path"], s["block_types"]) for s in found] == [([], ["paragraph"]), (["T", "Deep"], ["paragraph"]), (["T", "Deep", "Deep2"], ["code", "table"]), (["T", "Two"], ["html", "list"])]
    assert found[2]["content"] == "```py\n# no heading\n\nx\n```\n\n| a | b |\n| --- | --- |\n| 1 |  |"
    assert found[3]["content"] == "- i\n- j\n\ncard" and {s["document_title"] for s in found} == {"T"} and found[0]["section_id"] == "p:section:1"
    assert sections.sections_of("", "http://x/p", "p", []) == []


def test_breadcrumbs(spark):
    pages = spark.createDataFrame([("http://x/a/b/c?q",), ("http://x/a",)], "url string")
    titles = spark.createDataFrame([("http://x/a", "A"), ("http://x/a/b", "B")], "url string, title string")
    assert {r.url: r.breadcrumb for r in sections.breadcrumbs(pages, titles).collect()} == {"http://x/a/b/c?q": ["A", "B"], "http://x/a": []}


# ---- api specifications

def specs_of(spark, **known):
    rows = [(k, heading, json.dumps(spec) if isinstance(spec, dict) else spec) for k, (heading, spec) in known.items()]
    return spark.createDataFrame(rows, "spec_id string, heading string, code string")


def ref(name, kind="schemas"):
    return {"$ref": f"#/components/{kind}/{name}"}


#: References of all kinds: chains, cycles, parts of parts, bodies, parameters and responses behind references.
DEEP = {
    "openapi": "3.1.0",
    "info": {"title": "Deep"},
    "servers": [{"url": "http://s", "description": "The **only** one"}],
    "security": [{"key": [], "basic": []}, {"odd": []}],
    "paths": {
        "/x/{id}": {
            "parameters": [ref("Id", "parameters")],
            "put": {
                "description": "Change",
                "parameters": [{"name": "v", "in": "query", "schema": ref("Mode"), "description": ""}],
                "requestBody": ref("Body", "requestBodies"),
                "responses": {"200": ref("Ok", "responses"), "404": {}},
            },
            "trace": {"responses": {}},
        }
    },
    "components": {
        "securitySchemes": {"key": {"type": "apiKey", "name": "X-Key", "in": "header", "description": "Ask [us](http://u)."}, "basic": {"type": "http", "scheme": "basic"}},
        "parameters": {"Id": {"name": "id", "in": "path", "required": True, "schema": {"type": ["integer", "null"], "minimum": 1}}},
        "requestBodies": {"Body": {"required": True, "content": {"text/x": {"schema": ref("Alias")}}}},
        "responses": {"Ok": {"description": "Done", "content": {"application/json": {"schema": {"type": "array", "items": {"oneOf": [ref("Thing"), {"type": "string", "format": "uri"}]}}}}}},
        "schemas": {
            "Alias": ref("Thing"),
            "Mode": {"type": "string", "enum": ["a", 1, None], "default": "a", "description": "How\n\n| v | m |\n|---|---|\n| a | the  first |\n| b | second |\n| | no |"},
            "Base": {"allOf": [{"properties": {"id": {"type": "string"}, "old": {"type": "string"}}, "required": ["old"]}], "properties": {"id": {"type": "integer", "format": "int64"}}, "required": ["id"]},
            "Thing": {
                "description": "A thing",
                "allOf": [ref("Base"), {"properties": {"self": ref("Alias"), "mode": {**ref("Mode"), "readOnly": True}}}],
                "properties": {"parts": {"type": "array", "items": {"type": "object", "properties": {"n": {"type": "number"}, "up": ref("Thing")}}}, "made": {"type": "object", "readOnly": True, "properties": {"by": {"type": "string"}}}, "gone": ref("None")},
            },
        },
    },
}


def chain(n):
    return {"type": "object", "properties": {f"d{n}": chain(n - 1)}} if n else {"type": "string"}


def test_openapi_follows_references(spark):
    specs = specs_of(spark, s=("x", DEEP), n=("x", "{}"), b=("x", '{"openapi": '), z=(None, None))
    (end,) = openapi.openapi_endpoints(specs).collect()
    assert (end.endpoint, end.method, end.api, end.servers, end.summary) == ("/x/{id}", "PUT", "Deep", ["http://s (The only one)"], "Change")
    assert end.authentication == "API key in the X-Key header. Ask us. HTTP basic authentication. odd."
    assert [tuple(p)[1:] for p in end.parameters] == [("id", "path", "integer or null", True, ["min: 1"], ""), ("v", "query", "string", False, ["possible values: a, 1, null", "default: a"], "How")]
    assert tuple(end.body) == ("Thing object", True, "A thing")
    assert [tuple(r)[1:] for r in end.responses] == [("200", "Done.", "array of Thing object or string, uri"), ("404", "No description.", None)]

    rows = openapi.openapi_body_fields(specs).orderBy("places").collect()
    thing = ["id", "old", "self", "mode", "parts", "parts.n", "parts.up", "made", "gone"]
    below = [f"{p}.{x}" for p in ("self", "parts.up") for x in thing]  # opened once on each way, as Thing is open below
    got = [".".join(r.path) for r in rows]
    assert [p for p in got if p.count(".") == 0] == ["id", "old", "self", "mode", "parts", "made", "gone"] and set(got) == {*thing, *below}
    assert got.index("self.id") == got.index("self") + 1 and got.index("parts.up.id") == got.index("parts.up") + 1
    by = {".".join(r.path): r for r in rows}
    assert (by["id"].type, by["id"].required, by["old"].required, by["gone"].type, by["self"].type) == ("integer, int64", True, True, "any", "Thing object")
    assert by["mode"].facts[-1] == "read-only" and by["mode"].description == "How"
    assert [(r.path, r.value, r.meaning) for r in openapi.value_meanings(openapi.openapi_body_fields(specs)).filter("path = 'mode'").orderBy("value_no").collect()] == [("mode", "a", "the first"), ("mode", "b", "second")]


def test_openapi_models(spark):
    models = {k: v for k, v in DEEP.items() if k != "paths"}
    text = {"openapi": "3", "components": {"schemas": {"Mode": DEEP["components"]["schemas"]["Mode"]}}}
    deep = {"openapi": "3", "components": {"schemas": {"Deep": chain(12)}}}
    specs = specs_of(spark, m=("The Thing object", models), first=("The Nothing object", models), v=("y", text), d=("", deep))
    found = {r.spec_id: r for r in openapi.openapi_models(specs).collect()}
    assert (found["m"].schema, found["first"].schema, found["v"].type, found["v"].is_value) == ("Thing", "Alias", "string (enum)", True)
    assert found["v"].description == "How\n\n| v | m |\n|---|---|\n| a | the first |\n| b | second |\n| | no |"
    fields = openapi.openapi_fields(specs)
    got = {".".join(r.path) for r in fields.filter("spec_id = 'm' and schema = 'Thing'").collect()}
    assert got == {"id", "old", "self", "mode", "parts", "parts.n", "parts.up", "made", "made.by", "gone"}  # named objects have rows of their own
    assert fields.filter("spec_id = 'd'").count() == 10


def test_openapi_as_text(spark):
    text = {r.spec_id: r.text for r in openapi.openapi_markdown(specs_of(spark, s=("x", DEEP), v=("y", {"openapi": "3", "info": {"title": "V", "version": "2"}, "components": {"schemas": {"Mode": {"type": "integer", "minimum": 2}}}}))).collect()}
    assert text["v"] == "API: V (version 2)\n\nType: integer\nMin: 2"
    parts = text["s"].split("\n\n")
    assert parts[:7] == ["API: Deep", "PUT /x/{id}", "Servers:", "- http://s (The only one)", "Authentication: API key in the X-Key header. Ask us. HTTP basic authentication. odd.", "Path parameters:", "- id (integer or null; required; min: 1)"]
    lines = parts[parts.index("Request body fields:") + 1].split("\n")
    assert lines[:3] == ["- id (integer, int64; required)", "- old (string; required)", "- self (Thing object; optional): A thing"]
    assert lines[3] == "  - id (integer, int64; required)" and "  - a: the first" in lines
    assert parts[-2:] == ["Responses:", "- 200: Done. Returns: array of Thing object or string, uri.\n- 404: No description."]


# ---- chunking


def row(n, content, path, kinds=("paragraph",), url="http://x/p", crumbs=()):
    return {"section_no": n, "section_id": f"p:section:{n}", "document_title": "T", "source_url": url, "breadcrumb": list(crumbs), "heading": path[-1], "heading_path": list(path), "block_types": list(kinds), "content": content}


def chunks_of(spark, rows, inherited=None):
    documents = spark.createDataFrame([("p", inherited, [tuple(r.values()) for r in rows])], f"document string, inherited_api string, sections array<{chunking.SECTION}>")
    totals = {r.what: r.n for r in chunking.chunk_totals(documents).collect()}
    return [r.asDict() for r in chunking.chunk_documents(documents).orderBy("chunk_index").collect()], totals


def test_small_sections_merge_and_tails_are_absorbed(spark):
    long = "word " * 300
    made, totals = chunks_of(spark, [row(1, long, ["T", "A", "x"]), row(2, long, ["T", "A", "y"]), row(3, "tail", ["T", "B"]), row(4, "nav", ["T", "C"], ["html"]), row(5, " ", ["T", "D"])])
    assert [c["section_ids"] for c in made] == [["p:section:1", "p:section:2", "p:section:3"]]
    assert made[0]["heading_path"] == ["T"] and "## A > y" in made[0]["text"] and made[0]["text"].startswith("T\n\n")
    assert totals == {"documents": 1, "sections": 5, "chunks": 1, "dropped: html without a link": 1, "dropped: empty": 1}


def test_oversized_blocks_split_by_kind(spark):
    table = "| h |\n| --- |\n" + "\n".join(f"| {'cell ' * 20}|" for _ in range(60))
    code = "```py\n" + "\n".join("x = 1 # " + "y " * 20 for _ in range(60)) + "\n```"
    items = "\n".join(f"- item {'w ' * 30}" for _ in range(60))
    prose = " ".join(f"Sentence {i} {'w ' * 30}." for i in range(60))
    for kind, block in (("table", table), ("code", code), ("list", items), ("paragraph", prose), ("paragraph", "a" + "-b" * 3000)):
        made, _ = chunks_of(spark, [row(1, "Intro.\n\nThe block:\n\n" + block, ["T", "A"], [kind])])
        assert len(made) > 1 and all(c["token_count"] <= chunking.MAXIMUM for c in made)
        bodies = [c["text"].split("\n\n", 1)[1] for c in made]
        assert not any(b.rstrip().endswith("The block:") for b in bodies)
        if kind == "table":
            assert all("| h |\n| --- |" in b for b in bodies if "cell" in b)
        if kind == "code":
            assert all(b.count("```") == 2 for b in bodies if "x = 1" in b)
    made, _ = chunks_of(spark, [row(1, prose, ["T", "A"])])
    assert set(made[1]["text"].split("\n\n")[1].split(". ")[:1]) & set(made[0]["text"].split(". "))


def test_oversized_blocks_start_in_the_space_that_is_left(spark):
    prose = " ".join(f"Sentence {i} {'w ' * 17}." for i in range(60))  # 20 tokens each
    for lead, starts in ((400, True), (650, True), (720, False)):
        made, _ = chunks_of(spark, [row(1, "intro " * lead + "\n\n" + prose, ["T", "A"])])
        assert ("Sentence 0 " in made[0]["text"]) == starts, lead
        assert all(c["token_count"] <= chunking.MAXIMUM for c in made)
        assert not starts or made[0]["token_count"] > chunking.MAXIMUM - 30
    items = "\n".join(f"- item {i} {'w ' * 17}" for i in range(60))
    made, _ = chunks_of(spark, [row(1, "intro " * 500 + "\n\nThe items:\n\n" + items, ["T", "A"])])
    assert "The items:\n\n- item 0 " in made[0]["text"]
    made, _ = chunks_of(spark, [row(1, "intro " * 750 + "\n\nThe items:\n\n" + items, ["T", "A"])])
    assert "The items:" not in made[0]["text"] and "The items:\n\n- item 0 " in made[1]["text"]


def test_split_lists_repeat_the_items_that_hold_them(spark):
    nested = "\n".join(f"- top {i}\n  - middle {i}\n" + "\n".join(f"    - leaf {i}.{k} {'w ' * 15}" for k in range(30)) for i in range(4))
    made, _ = chunks_of(spark, [row(1, nested, ["T", "A"], ["list"])])
    bodies = [c["text"].split("\n\n", 1)[1] for c in made]
    assert len(made) > 2 and all(c["token_count"] <= chunking.MAXIMUM for c in made)
    for body in bodies:
        lines = body.split("\n")
        first = re.search(r"(\d)\.", next(x for x in lines if "leaf" in x)).group(1)
        assert lines[:2] == [f"- top {first}", f"  - middle {first}"]
        assert "leaf" in lines[-1]
    leaves = [x for b in bodies for x in b.split("\n") if "leaf" in x]
    assert [x.split()[2] for x in leaves] == [f"{i}.{k}" for i in range(4) for k in range(30)]
    # a table head and parents that take over half of the room are cut like other lines, and nothing is lost
    wide = "| " + "h " * 500 + "|\n| --- |\n" + "\n".join("| c |" for _ in range(100))
    deep = "- " + "p " * 500 + "\n" + "\n".join(f"  - c{i} {'w ' * 20}" for i in range(30))
    for kind, text in (("table", wide), ("list", deep)):
        made, _ = chunks_of(spark, [row(1, text, ["T", "A"], [kind])])
        assert all(c["token_count"] <= chunking.MAXIMUM for c in made)
        assert sum(c["text"].count("h " if kind == "table" else "p ") for c in made) == 500
    items = chunking.list_items(F.lit("- a\n  - b\n  more\n    - c\n    - d\n- e"))
    got = spark.range(1).select(F.inline(items)).collect()
    assert [(r.parents, r.run) for r in got] == [([], 0), (["- a"], 1), (["- a", "  - b"], 0), (["- a", "  - b"], 0), ([], 0)]


def test_glossary_and_api_header(spark):
    url = "http://x/glossary-of-terms"
    rows = [row(1, "A B C D E F", ["T"], url=url), row(2, "See Balancer.", ["T", "LB"], url=url), row(3, "It balances.", ["T", "Balancer (ALB)"], url=url), row(4, "See Nothing", ["T", "L"], url=url)]
    made, totals = chunks_of(spark, rows)
    assert len(made) == 2 and "Also known as: LB." in made[0]["text"] and made[0]["section_ids"] == ["p:section:3", "p:section:2"] and made[0]["text"].startswith("T > Balancer (ALB)")
    assert totals["dropped: glossary index"] == totals["dropped: folded into its target"] == 1
    api = [row(1, "API: Store\n\nGET /n\n\nbody", ["Make"], ["api_spec"], "http://x/r/n", ["Up"]), row(1, "text", ["Page"], url="http://x/r")]
    api[1]["section_id"], api[0]["section_id"] = "q:section:1", "p:section:1"
    made = {c.chunk_id: c.text for c in chunking.chunk_sections(spark.createDataFrame([{**r, "source_file": ""} for r in api], tables.SECTIONS)).collect()}
    assert made["p:chunk:0"].startswith("Up > Store > Make (GET /n)") and made["q:chunk:0"].startswith("Store > Page")


def test_audit(spark):
    rows = [("a", "http://x", ["s1"], 1, "w:"), ("a", "ftp", ["s1"], 900, "```\nx"), ("b", "http://x", ["s2"], 2, "w\n## h"), ("c", None, None, None, None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, source_url string, section_ids array<string>, token_count int, text string")
    found = {(r.chunk_id, r.check) for r in audit.row_checks(chunks).collect()}
    assert {("a", "ends with a lead-in"), ("a", "invalid source_url"), ("a", "over the maximum"), ("a", "unbalanced code fence"), ("b", "ends with a heading"), ("a", "token_count mismatch")} <= found
    assert audit.duplicate_chunk_ids(chunks).collect()[0].chunk_id == "a" and audit.missing_fields(chunks, ("text",)).collect()[0].chunk_id == "c"
    sections_ = spark.createDataFrame([("s1", "w w x"), ("s9", "q")], "section_id string, content string")
    assert [r.section_id for r in audit.uncovered_sections(sections_, chunks).collect()] == ["s9"]
    assert {(r.section_id, r.word): (r.n_section, r.n_chunks) for r in audit.missing_words(sections_, chunks).collect()} == {("s1", "w"): (2, 1), ("s9", "q"): (1, 0)}


# ---- retrieval, answers


def test_topk_and_cache(spark):
    chunks = spark.createDataFrame([(f"c{i}", "h\n\nbody", "http://x", [float(i), 1.0]) for i in range(6)], "chunk_id string, text string, source_url string, embedding array<float>")
    questions = spark.createDataFrame([("q", "10")], "id string, question string")
    embedder = lambda texts: [[float(t), 1.0] for t in texts]
    top = retrieval.retrieve(questions, chunks, embedder, 2).orderBy("rank").collect()
    assert [r.chunk_id for r in top] == ["c5", "c4"] and top[0].header == "h"
    asked = questions.select(F.col("id").alias("query_id"), F.array(F.lit(1.0)).cast("array<float>").alias("embedding"))
    assert retrieval.vector_topk(asked.limit(0), chunks.select("chunk_id", "embedding")).count() == 0
    texts = spark.createDataFrame([("1",), ("2",), ("2",)], "text string")
    cache = index.embedding_keys(spark.createDataFrame([("1",)], "text string"), "m").select("model", "key", F.array(F.lit(9.0)).cast("array<float>").alias("embedding"))
    both, full = index.embed_with_cache(texts, cache, "m", embedder)
    assert sorted((r.text, r.embedding[0]) for r in both.collect()) == [("1", 9.0), ("2", 2.0), ("2", 2.0)] and full.count() == 2


def test_answers(spark):
    assert [value(spark, answers.chunk_body(F.col("t")), t=t) for t in ("h\n\nb\n\nc", "h\n\n", "h")] == ["b\n\nc", "h", "h"]
    with pytest.raises(ValueError):
        answers.render_prompt(spark.createDataFrame([("q", "s")], "question string, sources string"), spark.createDataFrame([("v1", "", "")], "version string, system string, user string"), "v2")
    prices = spark.createDataFrame([("m", 0.75, 0.075, 4.5), ("j", 2.0, 0.2, 10.0)], "model string, input double, cached_input double, output double")
    calls = spark.createDataFrame([("m", (124_223, 4_596, 0, 0)), ("j", (725_099, 61_761, None, None)), ("?", (1, 1, 0, 0))], f"model string, usage {tables.USAGE}")
    cost = {r.model: r.cost_usd for r in answers.estimate_cost(calls, prices).collect()}
    assert round(cost["m"], 6) == 0.113849 and round(cost["j"], 4) == 2.0678 and cost["?"] is None
    assert {r.model: r.cost_usd for r in scoring.judge_usage(calls, prices).collect()}[None] is None


def test_checks_of_answers(spark):
    assert value(spark, scoring.invalid_citations(F.col("a"), F.lit(5)), a="[6] [1] [6] [99999999999999999999] [0]") == [0, 6, 2**63 - 1]
    assert value(spark, scoring.required_terms_missing(F.col("a"), F.array(F.lit("Foo"), F.lit("bar"))), a="use `foo`") == ["bar"]
    assert value(spark, scoring.required_terms_ok(F.col("a"), F.array().cast("array<string>")), a="x") is None
    assert value(spark, F.bround(F.lit(Decimal("0.0625")).cast("double"), 3), a=1) == 0.062


# ---- the golden fixture: (type, questions) and the questions that lost marks

SIZES = {"api_fact": 8, "exact_identifier": 7, "how_to": 7, "faq": 6, "paraphrased": 6, "multi_chunk": 5, "definition": 3, "unanswerable": 8}
LOST = [
    ("exact_identifier", 3, 0.80), ("api_fact", 2, None), ("exact_identifier", 2, None), ("how_to", 1, 0.67), ("api_fact", 1, 0.50), ("multi_chunk", 3, 0.88), ("exact_identifier", 4, None),
    ("faq", 5, None), ("paraphrased", 3, None), ("multi_chunk", 3, 0.56), ("exact_identifier", 3, 0.75), ("exact_identifier", 4, None), ("api_fact", None, 0.0), ("how_to", 1, 0.50), ("faq", 3, None),
    ("paraphrased", 1, 0.33), ("multi_chunk", 1, 0.60), ("api_fact", None, 0.14), ("how_to", 1, 0.67), ("faq", 1, 0.50), ("paraphrased", 1, 0.50), ("multi_chunk", 2, None), ("definition", 1, 0.83),
]


def test_published_summary_comes_out_again(spark):
    questions = [(f"l{i}", t, rank, recall) for i, (t, rank, recall) in enumerate(LOST)]
    for kind, n in SIZES.items():
        questions += [(f"{kind}{i}", kind, 1, None) for i in range(n - sum(t == kind for _, t, *_ in questions))]
    golden_rows, answer_rows, judged = [], [], []
    several = 6
    for i, kind, rank, recall in questions:
        answerable = kind != "unanswerable"
        two = answerable and (i == "l9" or several > 1 and kind == "multi_chunk") and i not in ("x",)
        several -= bool(two and i != "l9")
        evidence = [("q", [f"{i}e"]), ("q", ["lost" if i == "l9" else f"{i}e"])] if two else [("q", [f"{i}e"])]
        golden_rows.append((i, kind, answerable, evidence if answerable else [], []))
        answer_rows.append((i, "see [1]", [(1, "x", "u")], [(r, 0.5, f"{i}e" if answerable and r == rank else f"{i}-{r}", "u") for r in range(1, 6)], None))
        declines = "yes" if not answerable and i != "unanswerable0" or i in ("l12", "l17") else "no"
        judged.append((i, 1.0, 1.0 if answerable and recall is None else recall, None, declines, []))
    g = spark.createDataFrame(golden_rows, "id string, type string, answerable boolean, evidence array<struct<quote: string, chunk_ids: array<string>>>, required_terms array<string>")
    a = spark.createDataFrame(answer_rows, "id string, answer string, citations array<struct<number: int, chunk_id: string, url: string>>, retrieved array<struct<rank: int, score: double, chunk_id: string, source_url: string>>, error string")
    j = spark.createDataFrame(judged, "question_id string, faithfulness double, answer_recall double, context_recall double, declines string, judge_errors array<string>")
    scores = scoring.score_records(a, g, j)
    rows = {r.type: r for r in scoring.summary(scores).collect()}
    top = rows[None]
    assert (top.questions, top.answerable, top.hit_at_1, top.hit_at_3, top.hit_at_5, top.mrr) == (50, 42, 0.667, 0.881, 0.952, 0.767)
    assert (top.answer_recall, top.refusal_accuracy, top.false_refusal_rate, top.evidence_recall) == (0.839, 0.875, 0.048, 0.94)
    assert [rows["exact_identifier"][c] for c in ("hit_at_1", "hit_at_3", "hit_at_5", "mrr", "answer_recall")] == [0.286, 0.714, 1.0, 0.524, 0.936]
    assert rows["unanswerable"].hit_at_1 is None and rows["multi_chunk"].mrr == 0.633
    reasons = {r.id: r.reasons for r in scoring.failures(scores).collect()}
    assert reasons["l12"] == "evidence not retrieved in top 5; evidence 0/1; false refusal; answer recall 0.00" and reasons["l1"] == "evidence at rank 2" and len(reasons) == len(LOST) + 1


def test_golden_problems(spark):
    rows = [
        ("ok", "faq", "q", "the Answer", [("Quote", ["c1"])], ["u1"], ["answer"], True, ""),
        ("ok", "nope", " ", "a", [("zzz", ["c1", "c9"])], [], ["b"], True, ""),
        ("n", None, "q", "a", [], [], [], True, ""),
        ("u", "unanswerable", "q", "a", [(" ", [])], [], [], True, ""),
    ]
    g = spark.createDataFrame(rows, tables.GOLDEN)
    chunks = spark.createDataFrame([("c1", "a quote", "u1")], "chunk_id string, text string, source_url string")
    found = {(r.id, r.check) for r in golden.golden_problems(g, chunks).collect()}
    assert found == {
        ("ok", "unknown type"), ("ok", "empty question or answer"), ("ok", "required terms not in the expected answer"), ("ok", "unknown chunk"), ("ok", "quote not in chunk"),
        ("ok", "source urls differ from the evidence"), ("ok", "duplicate id"), ("n", "missing fields"), ("u", "type and answerable disagree"), ("u", "evidence without quote or chunks"),
    }


# ---- sources


def test_tables_round_trip(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_text("# A\nx")
    (tmp_path / "b.txt").write_text("no")
    assert [r.text for r in tables.read_page_tree(spark, str(tmp_path)).collect()] == ["# A\nx"]
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, page_content string")
    for form in ("json", "parquet"):
        tables.write_table(df, str(tmp_path / form), form)
        tables.write_table(df.limit(1), str(tmp_path / form), form)
    assert tables.read_json_lines(spark, str(tmp_path / "json"), "id int, page_content string").count() == 1
    sums = {tables.checksum(x, ["id", "page_content"]).first().checksum for x in (df, df.repartition(3), df.orderBy(F.desc("id")))}
    assert len(sums) == 1
    vectors = spark.createDataFrame([(1, [1.0, 2.0])], "id int, embedding array<double>")
    assert tables.index_manifest(df, vectors, "c", "m").first().embedding_dimension == 2
    assert {(r.id, r.problem) for r in index.verify_index(df, vectors).collect()} == {(2, "no vector")}
