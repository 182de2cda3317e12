"""The exact step of near-duplicates: nothing is missed where the trees find nothing, and no pairs are made on the way."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import near_duplicates as near
from lodestone.llm import ngram_join as join

RNG = np.random.default_rng(21)


def words(n):
    return [f"w{i}" for i in RNG.integers(0, 5000, n)]


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def test_a_common_passage_costs_its_documents(spark, monkeypatch):
    passage, n = words(60), 150
    made = []
    monkeypatch.setattr(near, "visits_of", lambda *a, **b: made.append(join.visits_of(*a, **b)) or made[-1])
    near.near_duplicates(docs_of(spark, [" ".join(passage + words(40)) for _ in range(n)]), 3, 85, 100).collect()
    assert made[0].count() <= n  # of n * n / 2 pairs that share the passage


def test_links_that_the_trees_miss(spark, monkeypatch):
    monkeypatch.setattr(near, "small_groups", lambda reps, *a: reps.limit(0).select(F.col("rep").alias("gid"), "rep"))
    texts = []
    for _ in range(12):
        base = words(80)
        texts += [" ".join(base), " ".join([*base[:30], "x", *base[31:]]), " ".join([*base[:20], *words(30), *base[50:]])]
    texts += [texts[0], texts[1], None, "", "one two"]
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set()) for w in ((t or "").split() for t in texts)]
    least = list(range(len(texts)))
    for _ in range(3):
        for a, b in itertools.combinations(range(len(texts)), 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                least[a] = least[b] = min(least[a], least[b])
    found = near.near_duplicates(docs_of(spark, texts), 3, 85, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == {i: (len(s), least[i], least[i] == i) for i, s in enumerate(sets)}


def test_repeated_ids_keep_their_own_texts(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "q r s t u v"), (2, "q r s t u v"), (3, None)]
    found = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == [(1, 4, 1), (1, 4, 1), (1, 4, 1), (2, 4, 1), (3, 0, 3)]
