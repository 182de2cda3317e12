"""Main text of web pages by site style trees.

All pages of a host are merged into one tree: a node is the chain of tags (with class or id) from the
root, a block of text is a leaf of its own.  A node's presentation importance is the entropy of the child
sequences seen at it, its content importance falls with the entropy of its text blocks over the host's
pages: what stands on every page tells nothing, what stands on one tells most.  Both are mixed down the
tree.  Importance and a prior from markup are added as log odds, the first with more weight the more pages
a node is on: markup that names a role of boilerplate (``nav``, ``footer``, ``class="ad"`` ...) and text outside the
article that a page marks speak against a node, the flow of a marked article speaks for it.  Branches of low
importance are cut from each page, and nothing else.

Only (host, node, feature) counts are shuffled, never page text.  The list of cut nodes is broadcast if
it is at most ``max_broadcast`` rows, else joined by host.

Null and empty pages give an empty text; pages without markup are one block; null urls share one host.
Below DEPTH levels, and inside boilerplate, elements are part of the node above them.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import defaultdict
from collections.abc import Set
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut_lineage, map_batches, table

#: Importance below which a branch is cut, pages at which the tree has half its weight, damping per level.
THRESHOLD, HALF_WEIGHT, GAMMA = 0.5, 5, 0.9
#: Log odds for a node: boilerplate by its markup, outside the marked article, inside it, none of these.  Entropy over
#: six pages or more overrules all but the first, as adverts are as varied as articles are.
SAYS_BOILERPLATE, OUTSIDE, INSIDE, UNMARKED = -4.0, -1.5, 1.5, 0.8
MAX_BROADCAST, DEPTH = 200_000, 256
LEAF = "#text"
#: Characters that have a meaning in the name of a node.
_PLAIN = str.maketrans(">!", "__")

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_MARK = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe")}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CUT_TAGS = set("head nav footer aside form script style noscript template iframe svg button select textarea dialog menu object canvas audio video".split())
_ROOTS = {"html", "body", "article", "main"}
_CUT_ROLES = set("navigation banner complementary contentinfo search alert dialog menu menubar form".split())
_CUT_WORDS = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar aside footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay comment comments disqus replies share sharing "
    "social related recommended newsletter subscribe subscription login signup signin search widget toolbar pagination pager skip".split()
)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").removeprefix("www.")
    except ValueError:
        return ""


def _says_boilerplate(tag: str, marks: dict[str, str], in_article: bool) -> bool:
    if tag in _CUT_TAGS or (tag == "header" and not in_article):
        return True
    if tag in _ROOTS and tag != "article":
        return False
    if marks.get("role") in _CUT_ROLES:
        return True
    named = set(re.split(r"[\s_\-]+", f"{marks.get('class', '')} {marks.get('id', '')}".strip()))
    return bool(named & _CUT_WORDS) or ("header" in named and not in_article)


class Page:
    """Blocks and nodes of one page, in one pass over its markup.

    blocks: (leaf, text); nodes: node -> child tags of each of its elements.  All nodes start with ``a`` if the page
    marks an article, else with ``p``; a tag whose markup says boilerplate ends with ``!``.
    """

    def __init__(self, source: str | None):
        self._blocks: list[tuple[str, str]] = []
        self._nodes: dict[str, list[list[str]]] = defaultdict(list)
        self._buffer: list[str] = []
        self._marked = False
        # an open element: tag, node, inside the article, child tags
        self._stack: list[tuple[str, str, bool, list[str]]] = [("", "", False, [])]
        self._read(source or "")
        kind = "a" if self._marked else "p"
        self.blocks = [(f"{kind}{node}>{LEAF}", text) for node, text in self._blocks]
        self.nodes = {f"{kind}{node}": elements for node, elements in self._nodes.items()}

    def _flush(self) -> None:
        if self._buffer:
            text = "".join(self._buffer)
            self._buffer.clear()
            if text := " ".join((html_lib.unescape(text) if "&" in text else text).split()):
                node = next((e[1] for e in reversed(self._stack) if e[0] in _BLOCK), "")
                self._blocks.append((node, text))

    def _close(self, tags: set[str], barrier: set[str]) -> None:
        """Closes the innermost open element of ``tags``, unless one of ``barrier`` is inside it."""
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k][0] in tags:
                del self._stack[k:]
                return
            if self._stack[k][0] in barrier:
                return

    def _open(self, tag: str, attributes: str) -> None:
        if tag in _BLOCK:
            self._close({"p"}, {"button", "table", "td", "th", "article", "section", "div", "li"} if tag != "p" else {"button", "td", "th"})
        if tag in _SELF_CLOSING:
            self._close(_SELF_CLOSING[tag], {"ul", "ol", "dl", "table", "select"})
        marks = {k.lower(): v.strip("\"'").lower() for k, v in _MARK.findall(attributes)} if "=" in attributes else {}
        _, node, inside, children = self._stack[-1]
        says = not node.endswith("!") and _says_boilerplate(tag, marks, inside)
        if not node.endswith("!"):
            named = f".{marks['class'].split()[0]}" if marks.get("class", "").strip() else f"#{marks['id']}" if marks.get("id") else ""
            name = tag.translate(_PLAIN) + named.translate(_PLAIN) + "!" * says
            children.append(name)
            if says or len(self._stack) <= DEPTH:
                node, children = f"{node}>{name}", []
                self._nodes[node].append(children)
        article = tag in ("article", "main") and not node.endswith("!")
        self._marked = self._marked or article
        self._stack.append((tag, node, inside or article, children))

    def _read(self, source: str) -> None:
        at = 0
        while m := _TAG.search(source, at):
            if m.start() > at:
                self._buffer.append(source[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if tag in _BLOCK:
                self._flush()
            if m[1]:
                self._close({tag}, set() if tag in _BLOCK else {"td", "th", "div", "article", "section"})
            elif tag in _RAW_END:
                end = _RAW_END[tag].search(source, at)
                at = end.end() if end else len(source)
            elif tag in _VOID:
                if tag == "br":
                    self._buffer.append(" ")
            else:
                self._open(tag, m[3])
        self._buffer.append(source[at:])
        self._flush()

    def text(self, cut: Set[str]) -> str:
        """The blocks that are in no cut branch, joined by line ends."""
        gone = {leaf: not cut.isdisjoint(_ancestors(leaf)) for leaf in {leaf for leaf, _ in self.blocks}}
        return "\n".join(text for leaf, text in self.blocks if not gone[leaf])


def _ancestors(node: str) -> list[str]:
    names = node.split(">")
    return [">".join(names[: k + 1]) for k in range(len(names))]


def node_counts(pages: DataFrame) -> DataFrame:
    """host, node, kind (0 page, 1 child sequence, 2 text block), feature, and over the pages the sums of
    its count c and of c ln c."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums: dict[tuple, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            host, page, own = host_of(url), Page(source), defaultdict(int)
            for node, elements in page.nodes.items():
                own[(node, 0, 0)] = 1
                for children in elements:
                    own[(node, 1, xxhash.xxh64_intdigest(">".join(children)) - 2**63)] += 1
            for node, text in page.blocks:
                own[(node, 0, 0)] = 1
                own[(node, 2, xxhash.xxh64_intdigest(text.lower()) - 2**63)] += 1
            for key, c in own.items():
                s = sums[(host, *key)]
                s[0] += c
                s[1] += c * math.log(c)
        keys = list(sums)
        columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int64()))]
        columns += [pa.array([sums[k][i] for k in keys], pa.float64()) for i in range(2)]
        return pa.RecordBatch.from_arrays(columns, names=["host", "node", "kind", "feature", "c", "clc"])

    counts = map_batches(pages.select("url", "html"), run, "host string, node string, kind int, feature long, c double, clc double")
    return counts.groupBy("host", "node", "kind", "feature").agg(F.sum("c").alias("c"), F.sum("clc").alias("clc"))


def node_importance(counts: DataFrame) -> DataFrame:
    """host, node, n_pages, entropy (importance by the tree alone, 0 to 1), importance (with the prior) of every
    node of every host's tree.  counts: those of ``node_counts``."""
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    nodes = counts.groupBy("host", "node").agg(
        of(0, F.col("c")).alias("n_pages"),
        of(1, F.col("c")).alias("elements"),
        of(1, F.col("c") * F.log("c")).alias("styles_clc"),
        F.coalesce(of(1, F.lit(1)), F.lit(0)).alias("styles"),
        of(2, F.log("c") - F.col("clc") / F.col("c")).alias("spread"),
        of(2, F.lit(1)).alias("features"),
    )
    ln_m, single = F.log(F.greatest("n_pages", F.lit(2.0))), F.col("n_pages") < 2
    nodes = nodes.select(
        "host",
        "node",
        "n_pages",
        "styles",
        F.when(single | F.col("elements").isNull(), 1.0).otherwise(F.least(F.lit(1.0), (F.log("elements") - F.col("styles_clc") / F.col("elements")) / ln_m)).alias("presentation"),
        F.when(F.col("features") > 0, F.when(single, 1.0).otherwise(1 - F.col("spread") / F.col("features") / ln_m)).alias("content"),
    )
    names = F.split("node", ">")
    up = nodes.filter(F.col("content").isNotNull()).select(
        "host", "content", F.explode(F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.struct(F.array_join(F.slice(names, 1, k), ">").alias("node"), F.pow(F.lit(GAMMA), F.size(names) - k).alias("weight")))).alias("a")
    )
    below = up.groupBy("host", F.col("a.node").alias("node")).agg((F.sum(F.col("content") * F.col("a.weight")) / F.sum("a.weight")).alias("inner"))
    damp = F.pow(F.lit(GAMMA), F.col("styles"))
    scored = nodes.join(below, ["host", "node"]).select("host", "node", "n_pages", ((1 - damp) * F.col("presentation") + damp * F.col("inner")).alias("entropy"))
    bounded = F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.col("entropy")))
    odds = F.log(bounded / (1 - bounded)) * F.col("n_pages") / (F.col("n_pages") + HALF_WEIGHT) + prior(F.col("node"))
    return scored.withColumn("importance", 1 / (1 + F.exp(-odds)))


def prior(node: Column) -> Column:
    """The log odds that markup gives a node."""
    inside = node.rlike(r">(article|main)([.#>]|$)")
    outside = node.startswith("a>") & node.endswith(LEAF) & ~inside
    return F.when(node.rlike(f"!(>{LEAF})?$"), SAYS_BOILERPLATE).when(outside, OUTSIDE).when(inside, INSIDE).otherwise(UNMARKED)


def cut_nodes(counts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """host, node of the branches to cut: those of low importance.

    Nodes that markup doesn't speak against must also be at most half as important by the tree as the host's
    best plain text, so that a host of equal pages keeps their text; roots stay.
    """
    scored = node_importance(counts)
    last = F.regexp_extract("node", r"([a-z0-9#]+)[^>]*$", 1)
    spoken_against = prior(F.col("node")) < 0
    best = scored.filter(F.col("node").endswith(LEAF) & ~spoken_against).groupBy("host").agg(F.max("entropy").alias("best"))
    low = scored.filter((F.col("importance") < threshold) & (~last.isin(*sorted(_ROOTS)) | spoken_against))
    return low.join(best, "host", "left").filter(spoken_against | (F.col("entropy") <= F.col("best") / 2)).select("host", "node")


def main_text(pages: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    cut = cut_lineage(cut_nodes(cut_lineage(node_counts(pages))))
    few = cut.count() <= max_broadcast
    by_host: dict[str, set[str]] = defaultdict(set)
    if few:
        for r in cut.collect():
            by_host[r.host].add(r.node)
    shared = pages.sparkSession.sparkContext.broadcast(dict(by_host))
    if few:
        source = pages.select("page_id", "url", "html")
    else:
        host_of_url = F.pandas_udf(lambda urls: pd.Series([host_of(u if isinstance(u, str) else None) for u in urls], dtype=object), "string")
        lists = cut.groupBy("host").agg(F.collect_set("node").alias("cut"))
        source = pages.select("page_id", "url", "html", host_of_url("url").alias("host")).join(lists, "host", "left").select("page_id", "url", "html", "cut")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = None if few else batch.column(3).to_pylist()
        texts = []
        for k, (url, source) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            gone = shared.value.get(host_of(url), frozenset()) if few else set(lists[k] or ())
            texts.append(Page(source).text(gone) if source else "")
        columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return map_batches(source, run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""
    return main_text(table(spark, sf_dir, "pages"))
