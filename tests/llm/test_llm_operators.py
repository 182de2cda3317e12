"""Operators against brute force, and their cases: nulls, empty and repeated rows, ties, empty tables, other columns."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import (
    common,
    components,
    decontamination,
    hashing,
    html_main_text,
    language_id,
    language_model,
    line_dedup,
    near_duplicates,
    sentence_pieces,
    token_counts,
    toxicity,
    vector_search,
)
from lodestone.llm.common import words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = np.random.default_rng(5)
VOCABULARY = [f"w{i}" for i in range(300)]


def sentence(n):
    return " ".join(RNG.choice(VOCABULARY, n))


def docs_of(spark, texts, first=1):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts, first)], DOCS)


def near(text, edits):
    words = text.split()
    for i in RNG.choice(len(words), edits, replace=False):
        words[i] = "changed"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    base = [sentence(80) for _ in range(12)]
    texts = [None, "", "  \n ", "one two", "one two", "Éa b c d"]
    texts += base + [base[0], base[0]] + [near(base[1], 1) for _ in range(5)] + [near(base[2], e) for e in (1, 2, 6, 30)]
    return texts + [sentence(3000), "x" * 5000]


# ---- html


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p><p>no";</script></head><body><nav><ul><li>menu</ul></nav>
<div class="cookie-notice">accept</div><article><h1>A &amp; B</h1><p>one <b>two</b>
 three<br>four<p>five &eacute;<ul><li>six<li>seven</ul><div class="share">tweet</div></article><aside>side</aside>
<div id="comments"><p>me too</p></div><form><p>mail</p></form><footer>&copy; x</footer></body></html>"""


def test_entropy_overrules_what_articles_mark(spark):
    """A teaser that is marked as an article doesn't hide the text beside it; a block that all articles repeat goes."""
    post, teaser = ["own " + " ".join(f"{w}{i}" for w in "abcdefgh") for i in range(40)], [f"teaser {i}" for i in range(40)]
    beside = [f"<html><body><nav>menu</nav><article class=card><p>{t}</p></article><div class=post>{p}</div></body></html>" for t, p in zip(teaser, post)]
    inside = [f"<html><body><nav>menu</nav><article><p>{p}</p><div class=box>Subscribe for more</div></article></body></html>" for p in post]
    rows = [(i, f"http://h{k}/{i}", x) for k, pages in enumerate((beside, inside)) for i, x in enumerate(pages, 100 * k)]
    got = {r.page_id: r.text for r in html_main_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"{teaser[i]}\n{post[i]}" and got[100 + i] == post[i] for i in range(40))


def test_main_text(spark):
    pages = spark.createDataFrame([(1, "http://a/1", PAGE, 0), (2, None, None, 0), (3, "http://a/3", "", 0), (4, "bad url [", "just text &lt;x&gt;", 0), (1, "http://a/1", PAGE, 0)], "page_id long, url string, html string, text int")
    rows = {(r.page_id, r.text, r.n_chars) for r in html_main_text.main_text(pages).collect()}
    text = "A & B\none two three four\nfive é\nsix\nseven"
    assert rows == {(1, text, len(text)), (2, "", 0), (3, "", 0), (4, "just text <x>", 13)}
    assert html_main_text.main_text(pages.limit(0)).count() == 0


def test_style_tree_cuts_what_repeats_on_a_host(spark):
    page = "<html><body><div class='x1'><p>same words everywhere</p></div><div class='x2'><p>{}</p></div></body></html>"
    pages = spark.createDataFrame([(i, f"http://h/{i}", page.format(sentence(20))) for i in range(12)], "page_id long, url string, html string")
    assert {r.node for r in html_main_text.cut_nodes(html_main_text.node_counts(pages)).collect()} >= {"p>html>body>div.x1"}
    for most in (100, 0):  # broadcast, and joined by host
        assert not any("same words" in r.text or not r.text for r in html_main_text.main_text(pages, most).collect())


def test_hosts_are_the_same_joined_and_broadcast(spark):
    page = "<html><body><div class='x1'><p>same words everywhere</p></div><div class='x2'><p>{}</p></div></body></html>"
    urls = ["http://a_b/{}", "http://h/{} x|y", "http://www.Q:80/{}^"]
    rows = [(i, urls[i % 3].format(i), page.format(sentence(20))) for i in range(36)] + [(99, None, page.format("one"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    few, joined = ({r.page_id: r.text for r in html_main_text.main_text(pages, most).collect()} for most in (100, 0))
    assert few == joined and not any("same words" in few[i] for i in range(36)) and "same words" in few[99]


def test_deep_markup(spark):
    deep = "<html><body>" + "<div>" * 300 + "<nav>menu</nav><p>text</p>" + "</div>" * 300 + "<div><p>after</p></div><footer>foot</footer></body></html>"
    pages = spark.createDataFrame([(1, "http://a/1", deep), (2, "http://b/1", "<article>" + "<blockquote>" * 400 + "quote" + "</blockquote>" * 400 + "<p>end</p></article><p>outside</p>")], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_main_text.main_text(pages).collect()} == {1: "text\nafter", 2: "quote\nend"}


def test_importance_by_hand(spark):
    """Entropies of a host's tree in plain Python."""
    page = "<html><body><div class='m'><p>menu</p></div><div class='t'>{}</div></body></html>"
    sources = [page.format("".join(f"<p>{sentence(5)}</p>" for _ in range(1 + i % 2))) for i in range(8)]
    counts = html_main_text.node_counts(spark.createDataFrame([(i, "http://h/", x) for i, x in enumerate(sources)], "page_id long, url string, html string"))
    found = {r.node: r for r in html_main_text.node_importance(counts).collect()}
    parsed = [html_main_text.Page(x) for x in sources]
    content, presentation, styles = {}, {}, {}
    for leaf in {leaf for p in parsed for leaf, _ in p.blocks}:
        texts = {t for p in parsed for at, t in p.blocks if at == leaf}
        spread = []
        for t in texts:
            share = [sum(x == (leaf, t) for x in p.blocks) for p in parsed]
            spread.append(-sum(c / sum(share) * math.log(c / sum(share)) for c in share if c))
        content[leaf] = 1 - sum(spread) / len(spread) / math.log(8)
    for node in {n for p in parsed for n in p.nodes}:
        seen = Counter(">".join(c) for p in parsed for c in p.nodes.get(node, ()))
        total = sum(seen.values())
        presentation[node], styles[node] = -sum(c / total * math.log(c / total) for c in seen.values()) / math.log(8), len(seen)
    g = html_main_text.GAMMA
    for node, r in found.items():
        depth = node.count(">")
        below = [(g ** (leaf.count(">") - depth), c) for leaf, c in content.items() if leaf == node or leaf.startswith(node + ">")]
        inner, damp = sum(w * c for w, c in below) / sum(w for w, _ in below), g ** styles.get(node, 0)
        assert r.entropy == pytest.approx((1 - damp) * min(1, presentation.get(node, 1)) + damp * inner)
    assert set(found) == {*content, *presentation} and found["p>html>body>div.m"].importance < 0.5 < found["p>html>body>div.t"].importance


# ---- near duplicates


def shingles(text, k):
    w = words_of(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def classes_by_hand(texts, k, numerator, denominator, first=1):
    sets = {i: shingles(t, k) for i, t in enumerate(texts, first)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and denominator * both >= numerator * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("k", "n", "small"), [(3, 85, 200), (5, 80, 10)])
def test_near_duplicates(spark, corpus, k, n, small):
    docs = docs_of(spark, corpus).withColumn("component_id", F.lit("clash"))
    rows = near_duplicates.near_duplicates(docs, k, n, 100, small=small).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == classes_by_hand(corpus, k, n, 100)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows) and len(rows) == len(corpus)
    assert near_duplicates.near_duplicates(docs.limit(0)).count() == 0


def test_large_group_in_blocks(spark):
    base = sentence(120)
    texts = [base] + [near(base, 2) for _ in range(60)]
    rows = near_duplicates.near_duplicates(docs_of(spark, texts), 5, 80, 100, small=8).collect()
    assert {r.component_id for r in rows} == {1}


def test_pairs_within_a_template(spark):
    """Strangers at 0.80, pairs at 0.90, nodes far over the limit: no pivot is like anybody."""
    template, texts = [f"t{i}" for i in range(100)], []
    for i in range(120):
        own = [*template[:50], *(f"own{i}x{j}" for j in range(9)), *template[59:]]
        texts.append(" ".join(own))
        if i % 3 == 0:
            texts.append(" ".join([*own[:20], *(f"more{i}x{j}" for j in range(3)), *own[23:]]))
    want = classes_by_hand(texts, 3, 85, 100)
    assert len({c for _, c in want.values()}) == 120
    rows = near_duplicates.near_duplicates(docs_of(spark, texts), 3, 85, 100, small=8).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want


def test_recall_of_the_trees(spark):
    """Before the exact check: the share of similar pairs that share a node, against brute force."""
    texts = []
    for _ in range(120):
        base = sentence(120)
        texts += [base, near(base, RNG.integers(1, 4))]
    texts += [sentence(120) for _ in range(200)]
    sets = [shingles(t, 5) for t in texts]
    similar = {(a, b) for a, b in itertools.combinations(range(1, len(sets) + 1), 2) if 100 * len(sets[a - 1] & sets[b - 1]) >= 80 * len(sets[a - 1] | sets[b - 1])}
    reps = near_duplicates.signatures(docs_of(spark, texts), 5).select(F.col("doc_id").alias("rep"), "minwise")
    groups = {}
    for r in near_duplicates.small_groups(reps).collect():
        groups.setdefault(r.gid, set()).add(r.rep)
    found = {p for g in groups.values() for p in itertools.combinations(sorted(g), 2)}
    assert len(similar) > 80 and len(similar - found) <= 0.01 * len(similar) and len(found) < 5_000


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (2, 1), (20, 1)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 20: 1, 7: 7, 8: 7, 9: 7}


def test_word_hashes_agree_with_words():
    texts = ["Aé b\tA\x0bb\n", None, "", " ", "x" * (3 * hashing.RUN), "a b " * hashing.RUN, "b aé"]
    hashes = list(hashing.hashed_words(texts))
    assert [len(h) for h in hashes[:4]] == [4, 0, 0, 0] and len(hashes[5]) == 2 * hashing.RUN
    seen = {}
    for t, h in zip(texts, hashes):
        if t is None or len(t) < hashing.RUN:
            for w, x in zip(words_of(t), h.tolist()):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen) and set(hashes[5].tolist()) == {seen[b"b"], *hashing.hashed_words(["a"]).__next__().tolist()}


# ---- line dedup


def lines_by_hand(texts, first=1):
    lines = [(i, n, frozenset(words_of(x))) for i, t in enumerate(texts, first) for n, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    gone = {}
    for i, n, s in lines:
        for a, m, z in lines:
            if (a, m) >= (i, n):
                break
            if 9 * len(s & z) >= 4 * (len(s) + len(z)):
                gone[(i, n)] = (a, m)
                break
    return gone


def test_line_dedup(spark):
    a, b, c = sentence(30), sentence(40), sentence(5)
    texts = [f"{a}\n\n{c}", None, "", f"{b}\n{near(a, 2)}\n{c.upper()}", f"{a}\n{near(b, 12)}\n{near(b, 3)}", "one", "one", "one two three four", "one two three four five", f"{a}\n{a}"]
    docs = docs_of(spark, texts).withColumn("line_no", F.lit("clash"))
    found = {(r.doc_id, r.line_no): (r.first_doc, r.first_line) for r in line_dedup.repeated_lines(docs).collect()}
    assert found == lines_by_hand(texts)
    kept = {r.doc_id: r for r in line_dedup.drop_repeated_lines(spark, docs_of(spark, texts), "").collect()}
    assert kept[1].text == texts[0] and kept[7].text == "" and kept[7].n_chars == 0 and kept[2].text is None and len(kept) == len(texts)
    assert line_dedup.repeated_lines(docs.limit(0)).count() == 0


# ---- decontamination


def test_decontamination(spark):
    items = [sentence(n) for n in (12, 30, 70, 3)]
    texts = [None, "", sentence(200), f"{sentence(50)} {items[0].upper()} {sentence(50)}", items[1], f"{sentence(9)}\n{near(items[2], 1)} {sentence(70)}", f"x {items[3]} y", items[2][: len(items[2]) // 2]]
    table = spark.createDataFrame([*enumerate(items), (9, None), (10, "")], "item_id long, text string")
    docs = docs_of(spark, texts)
    for block in (100, 2):
        found = {(r.doc_id, r.item_id) for r in decontamination.contamination(docs, table, block).collect()}
        assert found == {(4, 0), (5, 1), (6, 2), (7, 3)}
    assert decontamination.contamination(docs.limit(0), table).count() == decontamination.contamination(docs, table.limit(0)).count() == 0


def test_decontamination_against_brute_force(spark):
    """Every window of every item's length, by its bag of shingles."""
    items = [sentence(n) for n in (8, 20, 60, 80)]
    texts = [sentence(60), *(f"{sentence(15)} {near(items[i % 4], e)} {sentence(10)}" for i in range(4) for e in range(4)), f"{items[1]} {items[1]}", items[3], items[3]]

    def bag(words, k):
        return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))

    want = set()
    for d, text in enumerate(texts, 1):
        for i, item in enumerate(items):
            w, x = words_of(text), words_of(item)
            k = min(5, len(x))
            for window in (w[a : a + len(x)] for a in range(max(1, len(w) - len(x) + 1))):
                a, b = bag(window, k), bag(x, k)
                if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                    want.add((d, i))
    table = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.contamination(docs_of(spark, texts).withColumn("m", F.lit("clash")), table).collect()}
    assert len(want) > 8 and found == want


def test_texts_shorter_than_an_item(spark):
    item = sentence(100)
    words = item.split()
    texts = [" ".join(words[:95]), " ".join(words[4:]), " ".join(words[:70]), item]
    table = spark.createDataFrame([(0, item)], "item_id long, text string")
    rows = {r.doc_id: r for r in decontamination.contamination(docs_of(spark, texts), table).collect()}
    assert set(rows) == {1, 2, 4}
    assert (rows[1].similarity, rows[1].first_word, rows[1].n_words) == (pytest.approx(91 / 96), 0, 95)


# ---- vectors


def test_vector_search(spark):
    x = RNG.normal(size=(600, 16)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (603, [9.0]), (620, [None] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    found = {}
    for r in vector_search.search(table, F.col("vec_id") % 20 == 0, 20, 1.0).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == set(range(0, 600, 20))
    # a shorter vector takes part, what it lacks counts as zero
    ids, place = [*range(600), 603], {603: 600}
    x = np.vstack([x.astype(np.float64), 9 * np.eye(1, 16)])
    hits = 0
    for q, near_ in found.items():
        scores = (x * x[q]).sum(axis=1)
        want = [ids[i] for i in np.lexsort((ids, -scores)) if i != q][:20]
        hits += len(set(want) & {i for i, _ in near_})
        assert all(abs(scores[place.get(i, i)] - s) < 1e-12 for i, s in near_) and near_ == sorted(near_, key=lambda p: (-p[1], p[0])) and len(near_) == 20
    assert hits >= 0.9 * 20 * len(found)
    assert any(i == 603 for near_ in found.values() for i, _ in near_)
    assert vector_search.search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = vector_search.search(table.filter("vec_id < 3"), F.col("vec_id") % 20 == 0).collect()
    assert [r.vec_id for r in few] == sorted([1, 2], key=lambda i: -(x[0] @ x[i]))


# ---- tokens


def greedy(word, starting, inside):
    n, at, pieces = 0, 0, starting
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return token_counts.UNKNOWN
        n, at, pieces = n + 1, end, inside
    return n


def test_longest_match_counts():
    for _ in range(30):
        make = lambda n: {"".join(RNG.choice(list("abc"), RNG.integers(1, 5))) for _ in range(n)}  # noqa: B023,E731
        starting, inside = make(12), make(12)
        matcher = token_counts.LongestMatch(starting, inside)
        for n in range(1, 8):
            for word in ("".join(RNG.choice(list("abc"), n)) for _ in range(20)):
                assert matcher.count(word) == greedy(word, starting, inside)


def test_workers_keep_what_they_made_and_parts_are_bounded(monkeypatch):
    monkeypatch.setattr(common, "_kept", {})
    made = [common.kept("a", k, lambda k=k: [k]) for k in (1, 1, 2, 3, 1)]
    assert made == [[1], [1], [2], [3], [1]] and made[0] is made[1] and made[0] is not made[4] and len(common._kept) == common.KEPT
    batch = pa.RecordBatch.from_pydict({"t": ["x" * n for n in (1, 3_000_000, 3_000_000, 9_000_000, 0)] + ["y"] * 1000})
    parts = list(common.parts_of(batch))
    assert pa.Table.from_batches(parts).column("t").to_pylist() == batch.column(0).to_pylist()
    assert all(p.num_rows <= common.ROWS and (p.nbytes <= common.BYTES or p.num_rows == 1) for p in parts)


def test_token_counts(spark):
    docs = docs_of(spark, [None, "", "the cat", "the cat", "a.b ☃"])
    rows = {r.doc_id: (r.n_tokens, r.n_words, r.n_unknown) for r in token_counts.count_tokens(docs, token_counts.load_pieces(token_counts.VOCABULARY)).collect()}
    assert rows[1] == rows[2] == (0, 0, 0) and rows[3] == rows[4] == (2, 2, 0) and rows[5][1] == 4


# ---- pieces


def all_paths(unit, score, byte):
    if not unit:
        return [0.0]
    ends = [(e, score[unit[:e]][0]) for e in range(1, len(unit) + 1) if unit[:e] in score]
    if unit[0] not in score:
        ends.append((1, len(unit[0].encode()) * byte))
    return [s + x for e, s in ends for x in all_paths(unit[e:], score, byte)]


def test_n_best_is_exact():
    v = sentence_pieces.load_vocabulary(sentence_pieces.VOCABULARY)
    lattice = sentence_pieces.Lattice(v)
    for text in ("hello world", "aé☃", "the  the", "x\ny", "internationally"):
        units = sentence_pieces.units_of(text)
        got = [s for s, _ in sentence_pieces.n_best(lattice, units, lattice.rows_of(units), 4)]
        want = [0.0]
        for u in units:
            want = sorted((a + b for a in want for b in sorted(all_paths(u, v["score"], v["byte_score"]), reverse=True)[:4]), reverse=True)[:4]
        assert np.allclose(got, want)
        for u in units:
            assert [s for s, _ in itertools.islice(lattice.paths(u), 4)] == pytest.approx(sorted(all_paths(u, v["score"], v["byte_score"]), reverse=True)[:4])


def test_pieces_round_trip(spark):
    texts = [None, "", " ", "a", "  two  blanks ", "line\n\nend\n", "▁mark ▁", "tab\tnbsp\xa0 ☃ 漢字 \U0001f600", "word " * 3000, "z" * 4000]
    v = sentence_pieces.load_vocabulary(sentence_pieces.VOCABULARY)
    docs = docs_of(spark, texts).withColumn("n_pieces", F.lit("clash"))
    rows = sentence_pieces.decode(sentence_pieces.encode(docs, v), v).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.decoded == (r.text or "") and r.n_pieces == len(r.piece_ids) and r.nbest_scores == sorted(r.nbest_scores, reverse=True)
    assert sentence_pieces.encode(docs.limit(0), v).count() == 0


def test_n_best_segmentations(spark):
    texts = [None, "", "a", "internationally", "hello world, aé☃ the  the", "x\ny and so on " * 40]
    v = sentence_pieces.load_vocabulary(sentence_pieces.VOCABULARY)
    cost = {i: s for s, i in v["score"].values()}
    for r in sentence_pieces.encode(docs_of(spark, texts), v).collect():
        paths = [sentence_pieces.splice(r.piece_ids, [tuple(x) for x in spans]) for spans in r.nbest_spans]
        assert len(paths) == len(r.nbest_scores) == len(set(map(tuple, paths))) and paths[0] == r.piece_ids
        for ids, score in zip(paths, r.nbest_scores):
            assert b"".join(v["surface"][i] for i in ids).decode()[1:] == (r.text or "")
            assert sum(cost.get(i, v["byte_score"]) for i in ids) == pytest.approx(score)
    assert len(paths) == 4


# ---- languages


def test_language_id(spark):
    words = {"en": ["the", "and", "with", "thing"], "de": ["der", "und", "mit", "nicht"], "fr": ["le", "et", "avec", "été"], "es": ["el", "y", "con", "niño"]}
    rows = [(i, " ".join(RNG.choice(words[x], 12)), x) for i, x in enumerate(list(words) * 30)]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "", None), (902, "123 !", "fr"), (903, "le et été avec", None)], "doc_id long, text string, lang string")
    model = language_id.fit(docs.filter("doc_id < 80"), 20, 512)
    out = {r.doc_id: r.p for r in docs.select("doc_id", language_id.predicted(spark, model, F.col("text")).alias("p")).collect()}
    assert all(out[i].lang_pred == x for i, _, x in rows) and all(0 <= p.score <= 1 for p in out.values())
    assert [out[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "fr"]
    nothing = language_id.fit(docs.limit(0))
    assert docs.select(language_id.predicted(spark, nothing, F.col("text")).alias("p")).filter("p.lang_pred <> 'und'").count() == 0


# ---- language model


@pytest.mark.parametrize("top", [10_000, 150, 0])
def test_language_model(spark, top):
    texts = [None, "", *(sentence(60) for _ in range(60)), "Unseen words only", "W1 w1"]
    docs = docs_of(spark, texts).withColumn("score", F.lit("clash"))
    train = docs.filter("doc_id % 3 <> 0")
    model, outside = language_model.fit(train, top)
    rows = {r.doc_id: r for r in language_model.scored(docs, model, outside).collect()}
    c = Counter(w for i, t in enumerate(texts, 1) if i % 3 for w in [*words_of(t), b"\n"])
    total = sum(c.values())
    assert model.words.tokens == total and len(model.words.keys) <= top and (outside is None) == (top > len(c))
    for i, t in enumerate(texts, 1):
        own = [*words_of(t), b"\n"]
        base = sum(math.log10((c[w] + 0.5) / (total + 0.5 * (len(c) + 1))) for w in own)
        assert rows[i].n_tokens == len(own) and rows[i].n_known == sum(c[w] > 0 for w in own) and abs(rows[i].base_score - base) < 1e-9
        assert rows[i].score < 0 and math.isfinite(rows[i].score) and rows[i].bits_per_byte > 0
    again = {r.doc_id: r.score for r in language_model.scored(docs.filter("doc_id % 2 = 0"), model, outside).collect()}
    assert all(abs(again[i] - rows[i].score) < 1e-6 for i in again)  # a score doesn't hang on the other texts
    if top:
        assert rows[1].score > rows[63].score  # new words cost their letters
    assert language_model.scored(docs, *language_model.fit(docs.limit(0))).filter("score < 0 and n_known = 0").count() == len(texts)
    assert language_model.scored(docs.limit(0), model, outside).count() == 0


def test_language_model_against_a_plain_coder():
    """The probability of a text, bit after bit, in plain Python."""
    texts = ["W1 w2 w3 w2 " * 40 + "strange", "w9", None, "w5 " * 700 + "w5 other w5"]
    keys, times = np.unique(np.concatenate(list(language_model.word_keys([sentence(4000)]))), return_counts=True)
    words = language_model.Dictionary(keys, times, int(times.sum()), len(keys), 1, 5.0)
    model = language_model.Model(words, RNG.integers(0, 40, (language_model.SLOTS, 2)).astype(np.float32))
    text, _, *coded = language_model.tokens_of(words, texts, 1)
    found = model.log10(text, len(texts), *coded)
    tails = language_model.Tails(words, text, coded[0], language_model.classes_of(coded[0]))
    bits = []
    for group in language_model.bits_of(words, text, *coded, model.byte_p, tails):
        inputs, gates = model.inputs(group)
        for i, token in enumerate(group.token.tolist()):
            at = group.at if isinstance(group.at, int) else int(group.at[i])
            bits.append((token, at, int(group.bit[i]), [float(x[i]) for x in inputs], int(gates[i]), [int(n[i]) for n in group.names]))
    bits.sort(key=lambda b: b[:2])
    for t in range(len(texts)):
        mine = [b for b in bits if text[b[0]] == t]
        want = sum(float(x) for x, token in zip(tails.log10, tails.token) if text[token] == t)
        for at in range(0, len(mine), language_model.SEGMENT):
            weights = [list(map(float, language_model.START)) for _ in range(language_model.GATES)]
            refined = [1 / (1 + math.exp(-(b - language_model.BUCKETS / 2 + 0.5) * 1.5)) for b in range(language_model.BUCKETS)]
            seen = Counter()
            for _, _, bit, x, gate, names in mine[at : at + language_model.SEGMENT]:
                own = [(i, n & (size - 1)) for i, (n, size) in enumerate(zip(names, language_model.OWN))]
                x = x + [float(language_model._STRETCH[seen[o]]) for o in own]
                dot = sum(a * b for a, b in zip(weights[gate], x))
                p = 1 / (1 + math.exp(-dot))
                bucket = min(max(int(dot / 1.5 + language_model.BUCKETS / 2), 0), language_model.BUCKETS - 1)
                final = p + (refined[bucket] - p) * 0.1
                want += math.log10(final if bit else 1 - final)
                weights[gate] = [w + (bit - p) * language_model.RATE * v for w, v in zip(weights[gate], x)]
                refined[bucket] += (bit - refined[bucket]) * language_model.REFINE
                for o in own:
                    seen[o] = int(language_model._NEXT[seen[o], bit])
        assert found[t] == pytest.approx(want, rel=1e-3)


# ---- toxicity


def test_grammar_reads_clauses():
    g = toxicity.Grammar(toxicity.lexicon_of({}))
    read = lambda text: dict(zip(toxicity.YIELDS, g.clause(re.findall(r"\w+", text.lower()))))
    assert read("you are an idiot")["aimed"] == read("idiot you are")["aimed"] == toxicity.SEED_WEIGHT
    assert read("an idiot")["plain"] == toxicity.SEED_WEIGHT
    assert read("you are not an idiot")["denied"] == toxicity.SEED_WEIGHT
    assert read("he said you are an idiot")["quoted"] == toxicity.SEED_WEIGHT
    assert read("i will kill you")["meant"] == read("you i will kill")["meant"] == 1
    assert read("i will kill time")["unmeant"] == read("i will not kill you")["unmeant"] == read("he said he will kill you")["unmeant"] == 1
    assert not any(read("nothing here").values())


def test_toxicity_is_learned(spark):
    bad = ["vequo", "lowei", "idiot"]
    rows = [(i, sentence(30) + (f" {RNG.choice(bad)} {RNG.choice(bad)}. " if i % 4 == 0 else ". ") + sentence(10), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5] + [(900, None)], "doc_id long, toxic int")
    out = {r.doc_id: r.score for r in docs.select("doc_id", toxicity.score_of(spark, toxicity.fit(docs, labels), F.col("text")).alias("score")).collect()}
    assert all((out[i] >= 0.5) == (y == 1) for i, _, y in rows) and out[900] == out[901] < 0.5
    untaught = toxicity.fit(docs.limit(0), labels.limit(0))
    assert docs.select(toxicity.score_of(spark, untaught, F.col("text")).alias("s")).filter("s is null or s < 0 or s > 1").count() == 0


def test_folds_are_crc32(spark):
    from lodestone.llm.common import fold

    rows = spark.range(50).select("id", fold(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)
