"""Selecting pages from a URL index: extraction, rules, caps, breakdowns.

Rules are configuration, a short list; they become column expressions, so nothing is joined.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Rule(NamedTuple):
    """URLs that contain ``fragment`` are of ``category``; at most ``cap`` are selected (None: all)."""

    category: str
    fragment: str
    cap: int | None = None


def extract_urls(lines: DataFrame, prefix: str = "https?://", column: str = "value") -> DataFrame:
    """All distinct URLs with the prefix in lines of text, without closing punctuation and ``.md``."""
    found = lines.select(F.explode(F.regexp_extract_all(column, F.lit(rf"{prefix}[^\s)]+"), F.lit(0))).alias("url"))
    return found.select(F.regexp_replace(F.regexp_replace("url", r"[.,;:]+$", ""), r"\.md$", "").alias("url")).distinct()


def exclude_urls(urls: DataFrame, patterns: list[str]) -> DataFrame:
    for p in patterns:
        urls = urls.filter(~F.col("url").contains(p))
    return urls


def category_of(url: Column, rules: list[Rule]) -> Column:
    """The first rule that fits, or null."""
    return F.coalesce(*(F.when(url.contains(r.fragment), F.lit(r.category)) for r in rules), F.lit(None).cast("string"))


def categorize(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    return urls.withColumn("category", category_of(F.col("url"), rules))


def count_by_category(urls: DataFrame, rules: list[Rule], patterns: list[str], other: str = "other") -> DataFrame:
    known = categorize(exclude_urls(urls, patterns), rules)
    return known.groupBy(F.coalesce("category", F.lit(other)).alias("category")).agg(F.count(F.lit(1)).alias("n_urls")).orderBy(F.desc("n_urls"), "category")


def _first(urls: DataFrame, n: Column) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("category").orderBy("url"))
    return urls.withColumn("place", place).filter(F.col("place") <= n)


def sample_per_category(urls: DataFrame, rules: list[Rule], n: int = 5) -> DataFrame:
    """The first n URLs of each category: category, place, url."""
    return _first(categorize(urls, rules).filter("category is not null"), F.lit(n)).select("category", "place", "url")


def select_urls(urls: DataFrame, rules: list[Rule], patterns: list[str], seeds: list[str]) -> DataFrame:
    """For each rule its matching URLs up to the cap, and the seeds.  A URL may fit several rules."""
    fits = F.array_compact(F.array(*(F.when(F.col("url").contains(r.fragment), F.struct(F.lit(r.category).alias("category"), F.lit(r.cap).cast("int").alias("cap"))) for r in rules)))
    matched = exclude_urls(urls, patterns).select("url", F.inline(fits))
    seeded = urls.sparkSession.createDataFrame([(s,) for s in seeds], "url string")
    capped = _first(matched.filter("cap is not null"), F.col("cap")).select("url")
    return capped.unionByName(matched.filter("cap is null").select("url")).unionByName(seeded).distinct()


def selection_breakdown(selected: DataFrame, rules: list[Rule], other: str = "seed/other") -> DataFrame:
    named = F.coalesce(category_of(F.col("url"), rules), F.lit(other)).alias("category")
    return selected.groupBy(named).agg(F.count(F.lit(1)).alias("n_urls"))


def url_to_path(url: Column) -> Column:
    """The path below the host as a Markdown file name."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/]+/?", ""), r"[?#].*$", "")
    return F.concat(F.regexp_replace(path, r"(/$|\.md$|\.html$)", ""), F.lit(".md"))


def path_to_url(path: Column, site: str) -> Column:
    return F.concat(F.lit(site.rstrip("/") + "/"), F.regexp_replace(path, r"\.md$", ""))


def document_id(path: Column) -> Column:
    return F.translate(F.regexp_replace(path, r"\.md$", ""), "/", ":")


def pending_urls(selected: DataFrame, pages: DataFrame) -> DataFrame:
    """Selected URLs without a stored page of any length."""
    return selected.join(pages.filter(F.length("text") > 0).select("url").distinct(), "url", "left_anti")
