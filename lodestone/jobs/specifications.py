"""API specifications made of the suppliers, and what must come out of them.

Each supplier has one specification, with references of all kinds, parts of parts, a cycle and a chain of objects.
Those of odd numbers have no endpoints and are pages of a model.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.jobs import adapters as A
from lodestone.jobs.catalog import query
from lodestone.operators import openapi


def _to(name: str, kind: str = "schemas") -> dict:
    return {"$ref": f"#/components/{kind}/{name}"}


def _chain(n: int) -> dict:
    return {"type": "object", "properties": {f"d{n}": _chain(n - 1)}} if n else {"type": "string"}


_TABLE = "| v | m |\n|---|---|\n| a | the first |\n| b | of @NAME |"
_SPEC = {
    "openapi": "3.0.0",
    "info": {"title": "@NAME", "version": "@KEY"},
    "servers": [{"url": "http://s/@KEY", "description": "The **only** one"}],
    "security": [{"key": []}],
    "paths": {
        "/things/{id}": {
            "parameters": [_to("Id", "parameters")],
            "post": {
                "summary": "Change [it](http://x)",
                "parameters": [{"name": "mode", "in": "query", "schema": _to("Mode")}],
                "requestBody": _to("Body", "requestBodies"),
                "responses": {"200": _to("Ok", "responses"), "404": {}},
            },
            "get": {"security": [{"token": []}], "servers": [{"url": "http://other"}], "responses": {"default": {"description": "What?"}}},
        }
    },
    "components": {
        "securitySchemes": {"key": {"type": "apiKey", "name": "X-Key", "in": "header"}, "token": {"type": "http", "scheme": "bearer", "bearerFormat": "JWT", "description": "Ask @NAME."}},
        "parameters": {"Id": {"name": "id", "in": "path", "required": True, "schema": {"type": "integer", "minimum": "@SIZE"}}},
        "requestBodies": {"Body": {"required": True, "content": {"application/json": {"schema": _to("Alias")}}}},
        "responses": {"Ok": {"description": "Done", "content": {"application/json": {"schema": {"type": "array", "items": {"oneOf": [_to("Alias"), {"type": "string", "format": "uri"}]}}}}}},
        "schemas": {
            "Thing": {
                "description": "@NAME as it is",
                "allOf": [_to("Base"), {"properties": {"next": _to("Alias"), "mode": {**_to("Mode"), "readOnly": True}}}],
                "properties": {"parts": {"type": "array", "items": {"type": "object", "properties": {"n": {"type": "number", "maximum": "@SIZE"}}}}},
            },
            "Base": {"required": ["id"], "properties": {"id": {"type": "integer", "format": "int64", "minimum": "@KEY"}}},
            "Alias": _to("Thing"),
            "Mode": {"type": "string", "enum": ["a", "@NAME"], "description": f"How\n\n{_TABLE}"},
            "Deep": _chain(12),
        },
    },
}
_MODEL = {k: v for k, v in _SPEC.items() if k != "paths"}

#: path, depth, type, required, facts, description of what Thing's fields must be, and of those of a body of it.
_THING = [
    ("id", 0, "integer, int64", True, "min: @KEY", ""),
    ("next", 0, "Thing object", False, "", "@NAME as it is"),
    ("mode", 0, "string", False, "possible values: a, @NAME; read-only", "How"),
    ("parts", 0, "array of object", False, "", ""),
    ("parts.n", 1, "number", False, "max: @SIZE", ""),
]
_BODY = [row for t in _THING for row in ([t] if t[0] != "next" else [t, *((f"next.{p}", d + 1, *rest) for p, d, *rest in _THING)])]
_DEEP = [(".".join(f"d{12 - j}" for j in range(i + 1)), i, "object", False, "", "") for i in range(openapi.MAX_DEPTH)]


def _line(path: str, depth: int, kind: str, required: bool, facts: str, about: str) -> str:
    said = "; ".join(x for x in (kind, "required" if required else "optional", facts) if x)
    return "  " * depth + f"- {path.split('.')[-1]} ({said})" + (f": {about}" if about else "")


def _body_lines() -> str:
    out = []
    for row in _BODY:
        out.append(_line(*row))
        if row[2:4] == ("string", False):
            out += ["  " * (row[1] + 1) + x for x in ("- a: the first", "- b: of @NAME")]
    return "\n".join(out)


_ENDPOINTS = "\n\n".join(
    [
        "API: @NAME (version @KEY)", "POST /things/{id}", "Servers:", "- http://s/@KEY (The only one)", "Authentication: API key in the X-Key header.",
        "Path parameters:", "- id (integer; required; min: @SIZE)", "Query parameters:", "- mode (string; optional; possible values: a, @NAME): How",
        "Request body (Thing object, required): @NAME as it is", "Request body fields:", _body_lines(),
        "Responses:", "- 200: Done. Returns: array of Thing object or string, uri.\n- 404: No description.",
        "GET /things/{id}", "Servers:", "- http://other", "Authentication: Bearer token in the Authorization header (JWT). Ask @NAME.", "Path parameters:", "- id (integer; required; min: @SIZE)", "Responses:", "- default: What?",
    ]
)
_MODE = f"API: @NAME (version @KEY)\n\nHow\n\n{_TABLE}\n\nType: string (enum)\nPossible values: a, @NAME"
_THINGS = "\n\n".join(["API: @NAME (version @KEY)", "@NAME as it is", "Fields:", "\n".join(_line(*row) for row in _THING)])


def specs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spec_id, heading, code."""
    key = F.col("s_suppkey").cast("string")
    code = F.when(F.col("s_suppkey") % 2 == 0, json.dumps(_SPEC)).otherwise(json.dumps(_MODEL))
    for mark, value in (('"@KEY"', F.concat(F.lit('"'), key, F.lit('"'))), ('"@SIZE"', F.col("s_nationkey").cast("string")), ("@KEY", key), ("@NAME", F.col("s_name"))):
        code = F.replace(code, F.lit(mark), value)
    heading = F.when(F.col("s_suppkey") % 4 == 1, "The Mode object").otherwise("The Lost object")
    return A.table(spark, sf_dir, "supplier").select(key.alias("spec_id"), heading.alias("heading"), code.alias("code"))


def _filled(text: str) -> str:
    text = "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for mark, value in (("@KEY", "s_suppkey"), ("@SIZE", "s_nationkey"), ("@NAME", "s_name")):
        text = text.replace(mark, f"' || {value} || '")
    return f"({text})"


def _rows(rows: list[tuple], names: str, where: str = "true") -> str:
    """SQL of rows for each supplier."""
    cell = lambda v: _filled(v) if isinstance(v, str) else str(v).lower()
    columns = names.split(", ")
    one = " UNION ALL ".join("SELECT s_suppkey, " + ", ".join(f"{cell(v)} AS {c}" for c, v in zip(columns, row)) + f" FROM supplier WHERE {where}" for row in rows)
    return f"SELECT s_suppkey::VARCHAR AS spec_id, {names} FROM ({one})"


_EVEN = "s_suppkey % 2 = 0"
_FIELD = ("path", "depth", "type", "required", "facts", "description")


def _shown(fields: DataFrame, *own: str) -> DataFrame:
    return fields.select("spec_id", *own, F.array_join("path", ".").alias("path"), "depth", "type", "required", F.array_join("facts", "; ").alias("facts"), "description")


@query(_rows([("Thing", *t) for t in _THING] + [("Base", *_THING[0])] + [("Deep", *d) for d in _DEEP], "schema, " + ", ".join(_FIELD)))
def api_fields(spark, sf_dir):
    """Fields of all models: parts merged, a cycle named and not opened, a chain cut at the greatest depth."""
    return _shown(openapi.openapi_fields(specs_of(spark, sf_dir)), "schema")


@query(_rows([("/things/{id}", "POST", *b) for b in _BODY], "endpoint, method, " + ", ".join(_FIELD), _EVEN))
def api_body_fields(spark, sf_dir):
    """Fields of request bodies behind references; what holds itself is opened once."""
    return _shown(openapi.openapi_body_fields(specs_of(spark, sf_dir)), "endpoint", "method")


@query(_rows([("/things/{id}", "POST", p, i, *v) for p in ("mode", "next.mode") for i, v in enumerate([("a", "the first"), ("b", "of @NAME")])], "endpoint, method, path, value_no, value, meaning", _EVEN))
def api_value_meanings(spark, sf_dir):
    return openapi.value_meanings(openapi.openapi_body_fields(specs_of(spark, sf_dir)))


@query(
    _rows(
        [
            ("@NAME (version @KEY)", "/things/{id}", "POST", "Change it", "http://s/@KEY (The only one)", "API key in the X-Key header.", "path id integer true min: @SIZE , query mode string false possible values: a, @NAME How", "Thing object true @NAME as it is", "200 Done. array of Thing object or string, uri, 404 No description. -"),
            ("@NAME (version @KEY)", "/things/{id}", "GET", "", "http://other", "Bearer token in the Authorization header (JWT). Ask @NAME.", "path id integer true min: @SIZE ", "", "default What? -"),
        ],
        "api, endpoint, method, summary, servers, authentication, parameters, body, responses",
        _EVEN,
    )
)
def api_endpoints(spark, sf_dir):
    """Endpoints with parameters, bodies, responses and authentication behind references."""
    rows = openapi.openapi_endpoints(specs_of(spark, sf_dir))
    word = lambda *parts: F.concat_ws(" ", *parts)
    parameters = F.transform("parameters", lambda p: word(p["location"], p["name"], p["type"], p["required"].cast("string"), F.array_join(p["facts"], "; "), p["description"]))
    responses = F.transform("responses", lambda r: word(r["status"], r["description"], F.coalesce(r["returns"], F.lit("-"))))
    return rows.select(
        "spec_id", "api", "endpoint", "method", "summary", F.array_join("servers", ", ").alias("servers"), "authentication", F.array_join(parameters, ", ").alias("parameters"),
        word("body.type", F.col("body.required").cast("string"), "body.description").alias("body"), F.array_join(responses, ", ").alias("responses"),
    )


@query(
    _rows([("@NAME (version @KEY)", "Mode", "string (enum)", True, "possible values: a, @NAME", f"How\n\n{_TABLE}")], "api, schema, type, is_value, facts, description", "s_suppkey % 4 = 1")
    + " UNION ALL "
    + _rows([("@NAME (version @KEY)", "Thing", "object", False, "", "@NAME as it is")], "api, schema, type, is_value, facts, description", "s_suppkey % 4 = 3")
)
def api_models(spark, sf_dir):
    """The model that a page's heading names, else the first: an object, or a value with its facts."""
    return openapi.openapi_models(specs_of(spark, sf_dir)).withColumn("facts", F.array_join("facts", "; "))


@query(_rows([(_ENDPOINTS,)], "text", _EVEN) + " UNION ALL " + _rows([(_MODE,)], "text", "s_suppkey % 4 = 1") + " UNION ALL " + _rows([(_THINGS,)], "text", "s_suppkey % 4 = 3"))
def api_markdown(spark, sf_dir):
    """Specifications as text, with nested lists of fields."""
    return openapi.openapi_markdown(specs_of(spark, sf_dir))
