"""N-gram join, hard negatives and manifest against brute force, with ties, repeats, odd rows and forced splits."""

import hashlib
import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import hard_negatives as negatives
from lodestone.llm import ngram_join as join
from lodestone.llm.merkle_manifest import FIELDS, levels_of, merkle_manifest, numbered

WORDS = [f"w{i}" for i in range(900)]


def reached(nodes, links):
    """The smallest node reachable from each."""
    least = {n: n for n in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(least[a], least[b])
            moved |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


# ---- n-gram join -----------------------------------------------------------------------------------


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def corpus(rng):
    """Copies and near copies of templates, strangers that share most of a template, chains, short and odd texts."""
    text = lambda n: " ".join(rng.choice(WORDS, n))
    base, other = text(90), text(70)
    out = [None, "", " \t\n", "one", "One", "one two three", "one two three", base, base.upper(), text(4), "a b c d", "a b c d e"]
    for i in range(60):
        words = base.split()
        for at in rng.choice(90, 1 + i % 3, replace=False):
            words[at] = f"x{i}"
        out.append(" ".join(words))
    out += [base + " " + text(8 + i) for i in range(30)]
    for i in range(0, 40, 2):  # a chain, each link of which is just near enough
        words = other.split()
        words[:i] = [f"y{j}" for j in range(i)]
        out.append(" ".join(words))
    out += [text(int(n)) for n in rng.integers(1, 60, 40)]
    out += [other] * 7
    return out


@pytest.mark.parametrize("block", [1 << 20, 700])
@pytest.mark.parametrize("k, share", [(4, 85), (5, 80)])
def test_ngram_join_is_brute_force(spark, monkeypatch, block, k, share):
    monkeypatch.setattr(join, "BLOCK", block)
    monkeypatch.setattr(join, "PIVOTS", 2)
    texts = corpus(np.random.default_rng(block + k))
    order = np.random.default_rng(2).permutation(len(texts))
    rows = [(int(i), texts[j]) for i, j in enumerate(order)]
    sets = {i: shingles(t, k) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b])]
    want = reached(sets, links)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit("clash")).withColumn("token", F.lit("clash"))
    found = join.ngram_join(docs.repartition(5), k, share, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {i: (len(s), want[i]) for i, s in sets.items()}


def test_ngram_join_of_repeated_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "q r s t u v"), (2, "q r s t u v"), (None, "a b c d e f"), (3, None)]
    found = join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()
    assert sorted(map(tuple, found), key=repr) == sorted([(1, 3, 1), (1, 3, 1), (1, 3, 1), (2, 3, 1), (None, 3, None), (3, 0, 3)], key=repr)


def test_lists_find_what_occurs_often_enough():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(80)]
    lists = join.Lists(sets, np.arange(80))
    for query in sets[:20]:
        for need in (1, 3, 10, len(query)):
            want = sorted((j, n) for j, s in enumerate(sets) if (n := len(np.intersect1d(s, query))) >= max(1, need))
            assert sorted(lists.search(query, need)) == want


# ---- hard negatives --------------------------------------------------------------------------------


def brute_negatives(rows, every, positives=5, most=5):
    rows = {(i, label, tuple(np.floor(256 * np.float64(v)).astype(int).tolist())) for i, v, label in rows if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, label, v in rows:
        if i % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, own) for j, own, w in rows if len(w) == len(v)))
        for p, j, _ in [s for s in scored if s[2] == label and s[1] != i][:positives]:
            fits = [(n, at) for n, at, own in scored if own != label and 80 * -p <= 100 * -n <= 100 * -p][:most]
            out += [(i, j, rank + 1, at, -p, -n) for rank, (n, at) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("shard", [4096, 16])
def test_hard_negatives_are_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(negatives, "LEAST_SHARD", shard)
    rng = np.random.default_rng(shard)
    centres = rng.normal(size=(6, 5))
    vectors = [(centres[i % 6] + 0.1 * rng.normal(size=5)).round(1 if i % 2 else 3).tolist() for i in range(400)]
    rows = [(i, v, int(rng.integers(0, 4))) for i, v in enumerate(vectors)]
    rows += [(i, [0.5, 0.25, 0.0, -0.5, 1.0], i % 2) for i in range(400, 520)]  # a frequent vector
    rows += [(600, None, 1), (610, [1.0] * 5, None), (620, [1.0, None, 1.0, 1.0, 1.0], 1), (630, [float("inf")] * 5, 1), (None, [1.0] * 5, 1)]
    rows += [(640 + i, [0.5 + i, 1.0], i % 2) for i in range(9)] + [(650, [], 1), (651, [], 1), (652, [], 2)] + [(20, *rows[20][1:]), (20, *rows[20][1:]), (20, [9.0] * 5, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("score", F.lit("clash")).repartition(4)
    found = sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect()))
    assert found == brute_negatives(rows, 10) and found


def test_hard_negatives_of_large_components(spark):
    def found(scale):
        rows = [(0, [4 * scale, -3 * scale], 0), (1, [4 * scale, -3 * scale], 0), (2, [3.5 * scale, -3 * scale], 1), (10, [-scale, scale], 0)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
        return sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") == 0).collect())), [r for r in brute_negatives(rows, 10) if r[0] == 0]

    made, want = found(1.1e6)  # beyond what doubles hold exactly
    assert made == want and made[0][4] > 2**53
    with pytest.raises(Exception, match="64 bits"):
        found(1e7)


def test_bounds_spare_most_lists(monkeypatch):
    rng = np.random.default_rng(8)
    centres = 1000 * rng.normal(size=(40, 16))
    x = np.floor(np.repeat(centres, 50, axis=0) + 5 * rng.normal(size=(2000, 16))).astype(np.int64)
    lists = np.repeat(np.arange(40), 50)
    shard = negatives.Shard(x, np.zeros(2000, np.int64), np.arange(2000), lists, centres)
    compared, products = [], negatives.products
    monkeypatch.setattr(negatives, "products", lambda q, y: compared.append(len(y)) or products(q, y))
    _, rows, score = shard.search(x[:1], np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([negatives.LOWEST]), np.array([negatives.HIGHEST]), True, 5)
    s = x @ x[0]
    assert score.tolist() == sorted(s.tolist(), reverse=True)[:5] and sum(compared) <= 200


# ---- Merkle manifest -------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
        later = r[4].translate({i: i + 32 for i in range(65, 91)}) if hit else r[4]
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, h(*map(field, r)), h(*map(field, (*r[:4], later))), r[0]))

    def tree(leaves):
        paths, own, now = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
        while len(now) > 1:
            runs = [range(a, min(a + 16, len(now))) for a in range(0, len(now), 16)]
            for run in runs:
                for i in run:
                    for leaf in own[i]:
                        paths[leaf].append(("".join(now[j] for j in run if j < i), "".join(now[j] for j in run if j > i)))
            own, now = [[x for i in run for x in own[i]] for run in runs], [h(*(now[i] for i in run)) for run in runs]
        return now[0], paths

    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in groups[s].sort() or groups[s]]) for s in names}
    root, above = tree([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, above):
        for (_, _, leaf, later, doc_id), path in zip(groups[s], trees[s][1]):
            folded = later
            for left, right in path + up:
                folded = h(left, folded, right)
            out.append((doc_id, leaf, trees[s][0], root, h(*(x for step in path + up for x in step)), folded, folded == root))
    return out


def manifest(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string").withColumns({c: F.lit("clash") for c in ("h", "i", "n", "grp", "path", "leaf")})
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle_manifest(docs.repartition(6), tampered={"text": F.when(hit, lower).otherwise(F.col("text"))}).collect()


def test_manifest_is_brute_force(spark):
    rows = [(i, f"s{i % 3}" if i % 11 else None, "en" if i % 2 else None, i, f"Text {i} Ä中") for i in range(700)]
    rows += [(1000 + i, f"é{i:03d}", "de", 1, "Lone") for i in range(290)] + [(5, "s2", None, None, None), (5, "s2", "x", 1, "")]
    rows += [(7, "s1", "en", 7, "A copy")] * 40 + [(None, "s0", None, None, "No id"), (None, None, None, None, None), (2000, "", "en", 0, "")]
    assert sorted(map(tuple, manifest(spark, rows)), key=repr) == sorted(brute_manifest(rows), key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 257])
def test_manifest_of_few_rows(spark, n):
    rows = [(i, "s", "en", 1, "Text") for i in range(n)]
    found = manifest(spark, rows)
    assert sorted(map(tuple, found)) == sorted(brute_manifest(rows) if rows else [])


def test_a_large_group_is_numbered_in_many_tasks(spark):
    rows = spark.range(5000).select(F.lit("").alias("grp"), (F.col("id") * 7 % 5000).alias("id"), F.lit("x").alias("h"))
    made = numbered(rows, "grp", "id").collect()
    assert all(r.i == r.id and r.n == 5000 for r in made)
    assert [level.count() for level in levels_of(numbered(rows, "grp", "id"))] == [313, 20, 2, 1]
    assert len(FIELDS) == 5
