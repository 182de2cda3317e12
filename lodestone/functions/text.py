"""Column expressions over Markdown and HTML text: cleaning, tokens, blocks.  All stay in the JVM."""

from __future__ import annotations

import html as html_lib
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: One token: a run of letters, digits and underscores, or any other single character that isn't blank.
TOKEN = r"[a-zA-Z0-9_\p{L}\p{N}]+|[^a-zA-Z0-9_\s\p{L}\p{N}]"
FENCE = "```"
#: The wrapper tags whose contents are kept, with the pattern of their arguments.
WRAPPERS = (
    ("content-ref", r"[^%]*"),
    ("stepper", r"\s*"),
    ("step", r"\s*"),
    ("tabs", r"\s*"),
    ("tab", r'(?:\s+title="[^"]*")?\s*'),
    ("file", r'(?:\s+src="[^"]*")?\s*'),
    ("hint", r"[^%]*"),
)
#: Entities that are decoded in the JVM; & comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def _replace_all(text: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, text)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it (also in lambdas, for each element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return _replace_all(text, [(r"(?U)\A\s+", ""), (r"(?U)\s+\z", "")])


def strip_boilerplate(text: Column) -> Column:
    """Without the quoted notice about the documentation index and without the tail of instructions to agents."""
    notice = r"(?im)^>\s*For the complete documentation index,[^\n]*?this page is available as[^\n]*?\.[ \t]*$"
    return F.regexp_replace(F.regexp_replace(text, notice, ""), r"(?is)\n---\s*\n# Agent Instructions.*\z", "")


def strip_template_tags(text: Column) -> Column:
    """Without wrapper tags such as {% hint ... %}; what they wrap stays."""
    return _replace_all(text, [(rf"(?i)\{{%\s*(?:end)?{name}{rest}%\}}", "") for name, rest in WRAPPERS])


def expand_variables(text: Column, variables: list[tuple[str, str]], prefix: str = r"space\.vars\.") -> Column:
    """Variables by their texts; ``variables``: (name pattern, text).  Longer names go first, case is ignored."""
    plain = F.regexp_replace(text, rf"(?<={prefix}[A-Za-z0-9\\_]{{0,120}})\\_", "_")
    steps = [(rf'(?i)(?:<code\s+class="expression">\s*{prefix}{name}\s*</code>|{prefix}{name}(?![A-Za-z0-9_]))', value) for name, value in sorted(variables, key=lambda v: (-len(v[0]), v[0]))]
    return F.when(text.rlike(prefix), _replace_all(plain, steps)).otherwise(text)


def unwrap_inline_html(text: Column) -> Column:
    """<code> to its contents between blanks, <mark> to a blank."""
    return _replace_all(text, [(r"(?is)<code[^>]*>(.*?)</code>", " $1 "), (r"(?i)</?mark[^>]*>", " ")])


def normalize_whitespace(text: Column) -> Column:
    """One blank at most, none before punctuation or at the ends of lines, one empty line at most."""
    tidy = _replace_all(text, [(r"[ \t]+", " "), (r" +([.,;:!?])", "$1"), (r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n")])
    return strip(F.regexp_replace(F.replace(tidy, F.lit("\\_"), F.lit("_")), r"\n{3,}", "\n\n"))


def clean_markdown(text: Column, variables: list[tuple[str, str]] | None = None) -> Column:
    """The cleaning steps in order, page in, page out."""
    out = strip_template_tags(strip_boilerplate(text))
    return normalize_whitespace(unwrap_inline_html(expand_variables(out, variables or [])))


def unescape(text: Column) -> Column:
    """All character references decoded, named and numeric ones; texts without any don't leave the JVM's column."""

    @F.pandas_udf("string")
    def decoded(column: pd.Series) -> pd.Series:
        return column.map(html_lib.unescape, na_action="ignore")

    return F.when(text.contains("&"), decoded(text)).otherwise(text)


def html_visible_text(html: Column, *, every_entity: bool = False) -> Column:
    """Tags to blanks, common entities (or all) decoded, white space as one blank."""
    bare = F.regexp_replace(html, r"<[^>]*>", " ")
    decoded = unescape(bare) if every_entity else reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, bare)
    return F.trim(F.regexp_replace(decoded, r"[ \t\r\n\f]+", " "))


def inline_text(markdown: Column) -> Column:
    """Inline Markdown as it reads: links and emphasis keep their text, an image becomes [Image: alt]."""
    steps = [
        (r"!\[([^\]]*)\]\([^)]*\)", "[Image: $1]"),
        (r"(?<!!)\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"(?i)<br\s*/?>|</p>|</li>", " "),
        (r"<[^>]+>", ""),
        (r"(?<![\w*])\*\*(?=[^\s*])(.+?)(?<=[^\s*])\*\*(?!\*)", "$1"),
        (r"(?<![\w_])__(?=[^\s_])(.+?)(?<=[^\s_])__(?!\w)", "$1"),
        (r"(?<![\w*])\*([^*\n]+)\*(?![\w*])", "$1"),
        (r"`([^`]+)`", "$1"),
        (r"[ \t]+", " "),
    ]
    return F.trim(_replace_all(markdown, steps))


def count_tokens(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))).cast("long")


def fence_lines(text: Column) -> Column:
    """How many lines open or close a code fence."""
    return F.size(F.filter(F.split(text, r"\R"), lambda line: F.ltrim(line).startswith(FENCE)))


def split_blocks(content: Column) -> Column:
    """Blocks at empty lines, never inside a code fence (an odd number of fence lines opens or closes one)."""
    parts = F.split(content, "\n\n")
    state = F.aggregate(
        parts,
        F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(False).alias("code")),
        lambda s, part: F.struct(
            F.when(s["code"] != (fence_lines(part) % 2 == 1), s["done"]).otherwise(F.array_append(s["done"], F.concat_ws("\n\n", s["open"], part))).alias("done"),
            F.when(s["code"] != (fence_lines(part) % 2 == 1), F.concat_ws("\n\n", s["open"], part)).alias("open"),
            (s["code"] != (fence_lines(part) % 2 == 1)).alias("code"),
        ),
        lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["open"])),
    )
    return F.filter(state, lambda b: b.rlike(r"[^ \t\r\n]"))


def classify_block(block: Column) -> Column:
    """code, table, list or paragraph."""
    return bound(
        strip(block),
        lambda body: F.when(body.startswith(FENCE), "code")
        .when(body.startswith("|") & body.contains("\n"), "table")
        .when(body.rlike(r"\A(?:[-*+]|\d+[.)])\s"), "list")
        .otherwise("paragraph"),
    )
