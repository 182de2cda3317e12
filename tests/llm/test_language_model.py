"""The language model mixes all bits of a text and learns from all of it."""

import numpy as np
import pytest

from lodestone.llm import language_model as lm

RNG = np.random.default_rng(12)
VOCABULARY = [f"w{i}" for i in range(3000)]


@pytest.fixture(scope="module")
def model():
    keys, times = np.unique(np.concatenate(list(lm.word_keys([" ".join(RNG.choice(VOCABULARY, 30_000))]))), return_counts=True)
    words = lm.Dictionary(keys, times, int(times.sum()), len(keys), 1, 5.0)
    return lm.Model(words, np.zeros((lm.SLOTS, 2), np.float32))


def scores(model, texts):
    text, _, *coded = lm.tokens_of(model.words, texts, 1)
    return model.log10(text, len(texts), *coded)


def test_no_bit_is_left_out_of_the_mixing(model):
    text, _, *coded = lm.tokens_of(model.words, [" ".join(RNG.choice(VOCABULARY, 500)), "never seen"], 1)
    kind = lm.classes_of(coded[0])
    tails = lm.Tails(model.words, text, coded[0], kind)
    found = np.zeros(len(text), int)
    for bits in lm.bits_of(model.words, text, *coded, model.byte_p):
        np.add.at(found, bits.token, 1)
    known = coded[0] > 0
    assert (found[known] == (model.words.length[kind] + kind)[known]).all() and kind[known].max() > lm.LEADING
    assert not tails.log10.any() and found.tolist() == lm.sizes_of(model.words, coded[0], coded[3], tails).tolist()


def test_a_text_learns_from_its_first_bit_to_its_last(model):
    once = " ".join(RNG.choice(VOCABULARY, 600))
    first, both = scores(model, [once, f"{once} {once}"])
    assert both - first > 0.6 * first  # the repetition, which is longer than 2,048 bits, costs far less than the first time


def test_long_texts_go_on_alone_and_score_alike(model, monkeypatch):
    texts = [" ".join(RNG.choice(VOCABULARY[:90], n)) for n in (700, 5, 300, 90)] + [None]
    want = scores(model, texts)
    monkeypatch.setattr(lm, "ABREAST", 500)
    assert scores(model, texts).tolist() == pytest.approx(want.tolist(), rel=1e-4)


def test_windows_and_company_leave_scores_alone(model, monkeypatch):
    texts = [" ".join(RNG.choice(VOCABULARY[:400], n)) for n in (300, 40, 1, 120)] + [None, "never seen " * 30]
    want = scores(model, texts)
    for abreast, few, window in ((10**9, 0, 97), (0, 3, 500), (0, 99, 1000), (50, 2, 1)):
        for name, value in (("ABREAST", abreast), ("FEW", few), ("WINDOW", window)):
            monkeypatch.setattr(lm, name, value)
        assert scores(model, texts).tolist() == pytest.approx(want.tolist(), rel=1e-4)


def test_bits_are_laid_out_a_window_at_a_time(model, monkeypatch):
    """What is laid out hangs on the window, not on the texts that are scored side by side."""
    texts = [" ".join(RNG.choice(VOCABULARY, 400)) for _ in range(30)]
    text, _, *coded = lm.tokens_of(model.words, texts, 1)
    most, inputs = [], lm.Model.inputs
    monkeypatch.setattr(lm.Model, "inputs", lambda self, bits: most.append(len(bits.token)) or inputs(self, bits))
    monkeypatch.setattr(lm, "WINDOW", 3000)
    model.log10(text, len(texts), *coded)
    assert max(most) <= 3000 < len(text)


def test_contexts_are_counted_at_leaves_as_bit_by_bit(model):
    texts = [" ".join(RNG.choice(VOCABULARY, 700)), "never seen WORDS", None, ""]
    _, _, *coded = lm.tokens_of(model.words, texts, 1)
    want = np.zeros((lm.SLOTS, 2))
    for bits in lm.bits_of(model.words, None, *coded):
        for slots in bits.slots:  # the first bits may have none
            np.add.at(want, (slots, bits.bit[-len(slots) :] if len(slots) else bits.bit[:0]), 1)
        if bits.kind == 2:
            np.add.at(want, (lm.BYTE + (bits.slots[0] & 255), bits.bit), 1)
    leaves = lm.leaves_of(lm.Coded(model.words, *coded))
    spelled = sum(len(w) + 1 for w in coded[3].values())
    assert len(leaves) <= 3 * len(coded[0]) + 2 * spelled  # not at each of about 15 bits
    assert spelled and (lm.nodes_of(model.words, np.bincount(leaves, minlength=lm.SLOTS)) == want).all()


def test_a_task_has_texts_of_about_one_length(spark, monkeypatch):
    """So that few steps have few texts side by side, whatever order the rows come in."""
    for name, value in (("DEALT", 60_000), ("LEAST", 60_000), ("ROW", 10)):
        monkeypatch.setattr(lm, name, value)
    texts = [None, *("x " * int(n) for n in RNG.permutation(np.repeat([3, 40, 700, 9000], [2000, 300, 60, 5])))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = lm.by_length(docs).selectExpr("spark_partition_id() as task", "doc_id", "coalesce(octet_length(text), 0) as size").collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    tasks = {}
    for r in rows:
        tasks.setdefault(r.task, []).append(r.size)
    assert len(tasks) >= 4 and max(sum(s) + 10 * len(s) for s in tasks.values()) <= 2 * 60_000
    assert sum(len(set(s)) > 2 for s in tasks.values()) <= 1  # the shortest, and those at a border
    assert lm.by_length(docs.limit(0)).count() == 0


def test_texts_that_take_over_a_lane_start_anew(model, monkeypatch):
    texts = [" ".join(RNG.choice(VOCABULARY[:400], int(n))) for n in RNG.integers(1, 90, 40)] + [None, "never seen " * 30]
    want = scores(model, texts)
    for lanes, window, few, abreast in ((3, 1 << 19, 0, 10**9), (3, 200, 0, 10**9), (1, 1 << 19, 0, 10**9), (7, 500, 5, 700), (2, 300, 99, 0)):
        for name, value in (("LANES", lanes), ("WINDOW", window), ("FEW", few), ("ABREAST", abreast)):
            monkeypatch.setattr(lm, name, value)
        assert scores(model, texts).tolist() == pytest.approx(want.tolist(), rel=1e-4)
    lane, begin, held = lm.lanes_of(np.arange(1, 41))
    ends = {i: sorted(zip(begin[lane == i], begin[lane == i] + np.arange(1, 41)[lane == i])) for i in range(2)}
    assert all(own[0][0] == 0 and own[-1][1] == held[i] and all(a[1] == b[0] for a, b in zip(own, own[1:])) for i, own in ends.items())
    assert held.sum() == 820 and held[0] - held[1] <= 40


@pytest.mark.parametrize("words", [0, 1, 2, 5000])
def test_ranks_of_keys(words):
    keys = np.unique(RNG.integers(-(2**63), 2**63, words, dtype=np.int64, endpoint=False))
    found = lm.Dictionary(keys, np.arange(len(keys), dtype=np.int64) + 1, 10, 10, 1, 5.0)
    asked = np.concatenate([keys, keys + 1, keys - 1, RNG.integers(-(2**63), 2**63, 900, dtype=np.int64), [-(2**63), -1, 0, 2**63 - 1]])
    rank = dict(zip(keys.tolist(), range(len(keys), 0, -1)))
    assert found.ranks(asked).tolist() == [rank.get(k, 0) for k in asked.tolist()]
