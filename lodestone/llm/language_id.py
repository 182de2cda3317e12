"""Language identification by hierarchical discrimination.

First the family of a text's language is predicted, by one linear support vector machine for each pair
of families; within the family, one-versus-one linear machines separate the closely related languages.
Pairs vote with their margins.  Languages outside FAMILIES form a family each of their own.

Features are the hashed character n-grams (one to four) of a whole text in lower case, where whatever
stands between letters counts as one gap, scaled to unit length.  They are counted for many texts at a
time with array operations.

Training: about ``per_language`` texts of each language, drawn by a hash of the id, whole texts, and about TOTAL
of all languages at most.  Texts
that are null or have no letter are ``und`` with score 0; texts of repeated rows are predicted alike;
without training rows all are ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import drawn, fold, table

#: Training texts of a language, of all languages, width of the hashed features, code points that are counted at a time.
PER_LANGUAGE, TOTAL, WIDTH, CHARS = 500, 10_000, 1 << 12, 1 << 21
GRAMS = 4
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "semitic": "ar he mt am",
    "turkic": "tr az kk uz ky tk",
    "uralic": "fi et hu",
    "indic": "hi ur bn pa mr gu ne si",
    "sinitic": "zh yue",
    "austronesian": "id ms tl jv",
}
_FAMILY = {language: family for family, languages in FAMILIES.items() for language in languages.split()}
UNKNOWN = "und"


def family_of(language: str) -> str:
    return _FAMILY.get(re.split(r"[-_]", language.lower())[0], language)


@cache
def _is_letter() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def histograms(texts: list[str | None], width: int = WIDTH) -> np.ndarray:
    """Unit rows of n-gram counts; a row of zeros for a text without letters."""
    codes = [np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    line = np.concatenate([np.append(c, np.uint32(0)) for c in codes])
    row = np.repeat(np.arange(len(codes)), [len(c) + 1 for c in codes])
    letter = _is_letter()[line]
    keep = letter | np.append(True, letter[:-1])
    line, row, letter = np.where(letter, line, 0)[keep].astype(np.uint64), row[keep], letter[keep]
    counts, h = np.zeros(len(texts) * width), np.zeros(len(line), np.uint64)
    for n in range(1, min(GRAMS, len(line)) + 1):
        end = len(line) - n + 1
        h = h[:end] * np.uint64(0x100000001B3) + line[n - 1 :] + np.uint64(n)
        whole = (row[:end] == row[n - 1 :]) & (letter[:end] | (n > 1))
        slot = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - width.bit_length() + 1)
        counts += np.bincount(row[:end][whole] * width + slot[whole].astype(np.int64), minlength=len(counts))
    counts = counts.reshape(len(texts), width)
    has = np.zeros(len(texts), bool)
    has[row[letter]] = True
    counts[~has] = 0
    return counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-300)


def pieces(texts: list[str | None], most: int = CHARS) -> Iterator[list[str | None]]:
    """The texts in runs of at most ``most`` code points; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        if run and (size + len(t or "") > most or len(run) >= 512):
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t or "")
    if run:
        yield run


def train_machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 100) -> np.ndarray:
    """A linear machine with squared hinge loss, the bias last; y is -1 or 1.  Accelerated gradient."""
    a = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    weight = (np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * cost * 100).astype(np.float32)
    y = y.astype(np.float32)
    scaled, top = a * np.sqrt(weight)[:, None], np.ones(a.shape[1], np.float32)
    for _ in range(30):  # power iteration: the largest curvature
        top = scaled.T @ (scaled @ (top / np.linalg.norm(top)))
    step = 1 / (1 + 2.2 * np.linalg.norm(top))
    w = before = np.zeros(a.shape[1], np.float32)
    for t in range(steps):
        at = w + t / (t + 3) * (w - before)
        slack = np.maximum(0, 1 - y * (a @ at))
        before, w = w, at - step * (at - 2 * a.T @ (weight * y * slack))
    return w


class Hierarchy:
    """Machines for pairs of families and pairs of languages in a family."""

    def __init__(self, vectors: np.ndarray, languages: list[str], width: int = WIDTH):
        self.width = width
        labels = np.array(languages)
        families = np.array([family_of(x) for x in languages])
        self.languages = {f: sorted(set(labels[families == f])) for f in sorted(set(families))}
        self.pairs, columns = [], []
        for kinds, known in ((families, sorted(self.languages)), *((labels, x) for x in self.languages.values())):
            for a, b in combinations(known, 2):
                own = (kinds == a) | (kinds == b)
                self.pairs.append((a, b))
                columns.append(train_machine(vectors[own], np.where(kinds[own] == a, 1.0, -1.0)))
        self.machines = np.array(columns).reshape(len(self.pairs), width + 1).T  # features and bias x pairs

    def vote(self, names: list[str], margins: dict[tuple[str, str], float]) -> tuple[str, float]:
        """The name with the most votes, ties by margin; how sure, from the margin to the runner-up."""
        if len(names) == 1:
            return names[0], 1.0
        votes = {n: [0, 0.0] for n in names}
        for a, b in combinations(names, 2):
            m = margins[(a, b)]
            votes[a if m >= 0 else b][0] += 1
            votes[a][1] += m
            votes[b][1] -= m
        best, second = sorted(names, key=lambda n: (-votes[n][0], -votes[n][1], n))[:2]
        m = margins[(best, second)] if (best, second) in margins else -margins[(second, best)]
        return best, float(1 / (1 + np.exp(-2 * np.clip(m, -15, 15))))

    def decide(self, margins: np.ndarray) -> tuple[str, float]:
        of = dict(zip(self.pairs, margins.tolist()))
        family, sure = self.vote(sorted(self.languages), of)
        language, also = self.vote(self.languages[family], of)
        return language, sure * also

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = []
        for run in pieces(texts):
            rows = histograms(run, self.width)
            margins = rows @ self.machines[:-1] + self.machines[-1]
            out += [self.decide(m) if self.languages and r.any() else (UNKNOWN, 0.0) for m, r in zip(margins, rows)]
        return out


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, width: int = WIDTH) -> Hierarchy:
    """Trained on about ``per_language`` documents of each language of doc_id, text, lang, about TOTAL at most."""
    known = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null")
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    each = min(per_language, TOTAL / max(1, len(counts)))
    parts = [(F.col("lang") == x) & (drawn("language", "doc_id") <= min(1.0, each / n)) for x, n in sorted(counts.items())]
    if not parts:
        return Hierarchy(np.zeros((0, width)), [], width)
    wanted = reduce(Column.__or__, parts)

    @F.pandas_udf("array<float>")
    def vector(texts: pd.Series) -> pd.Series:
        return pd.Series([v.astype(np.float32) if v.any() else None for run in pieces(list(texts)) for v in histograms(run, width)])

    rows = known.filter(wanted).select("lang", vector("text").alias("v")).filter("v is not null").orderBy("lang").toArrow().to_pandas()
    if not len(rows):
        return Hierarchy(np.zeros((0, width)), [], width)
    return Hierarchy(np.stack(rows["v"].to_numpy()), rows["lang"].tolist(), width)


def predicted(spark: SparkSession, model: Hierarchy, text: Column) -> Column:
    """struct(lang_pred, score) of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shared.value.predict(list(texts)), columns=["lang_pred", "score"])

    return predict(text)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``documents``; learned outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = fit(docs.filter(~held_out))
    return docs.select("doc_id", held_out.alias("held_out"), predicted(spark, model, F.col("text")).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
