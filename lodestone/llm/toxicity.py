"""Toxicity by a weighted finite-state pattern grammar.

Five transducers over token classes (insult, threat, target, negation, report, other) are composed into
one machine that reads a clause:

* report: after a verb of speech, insults and threats are quoted, not meant;
* negation: within three tokens after a negation an insult or threat is denied;
* target: an insult in a clause with a target, on either side, is aimed at someone;
* threat: a threat counts as meant if the clause has a target, on either side;
* insult: what is left of an insult counts with the weight of its term.

A clause yields (plain, aimed, denied, quoted) insult weight and (meant, denied or quoted) threats, and
a text the sums and the best clause.  Terms are seeded with a few words and learned from labelled texts
by their log odds; what the yields are worth is learned by logistic regression.  Both fits use at most
``max_labels`` labelled rows, drawn by a hash of the id; everything is scored by its whole text.

Null, empty and wordless texts yield nothing and score the bias alone; repeated rows score alike;
without labels of both kinds, fixed default weights apply.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import drawn, fold, table

#: Labelled rows that are learned from at most.
MAX_LABELS = 200_000
#: Labelled rows for the logistic regression, and the least toxic texts and log odds of a learned term.
MAX_FIT, MIN_TEXTS, MIN_ODDS = 40_000, 5, 2.0
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "ITGNRO"
SEEDS = {
    THREAT: "kill hurt destroy beat shoot stab burn hang attack töten schlagen vernichten tuer frapper détruire matar golpear destruir",
    TARGET: "you your yours u he she they him her them his their people du dich dir dein ihr euch tu te toi ton vous votre ils tú ti tu usted ustedes ellos",
    NEGATION: "not no never neither nor without isn aren wasn don doesn didn nicht kein keine nie ohne ne pas jamais sans nunca ni sin",
    REPORT: "said says say told tells wrote writes quoted quote called calls claimed reported according sagte sagt schrieb nannte dit écrit selon appelé dijo dice escribió según llamó",
    INSULT: "idiot moron stupid scum trash loser pathetic worthless disgusting dumb",
}
SEED_WEIGHT = 3.0
YIELDS = ("plain", "aimed", "denied", "quoted", "meant", "unmeant")
_CLAUSE = re.compile(r"[.!?;:\n]+")
_WORD = re.compile(r"\w+")
#: bias, then the weights of the features, before anything is learned.
DEFAULT = np.array([-3.0, 1.0, 1.3, 0.2, 0.2, 2.0, 0.3, 0.5, 0.3])


class Transducer:
    """A deterministic transducer: (state, symbol) -> (state, symbol); a missing arc copies its symbol."""

    def __init__(self, start, arcs: dict):
        self.start, self.arcs = start, arcs

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol))

    def compose(self, after: "Transducer", alphabet: str) -> "Transducer":
        """``after`` reads what this one writes; states are pairs, built from the start."""
        start, arcs = (self.start, after.start), {}
        todo, seen = [start], {start}
        while todo:
            a, b = todo.pop()
            for x in alphabet:
                a2, y = self.step(a, x)
                b2, z = after.step(b, y)
                arcs[((a, b), x)] = ((a2, b2), z)
                if (a2, b2) not in seen:
                    seen.add((a2, b2))
                    todo.append((a2, b2))
        return Transducer(start, arcs)


def grammar() -> Transducer:
    """The composed machine; it writes p plain, a aimed, d denied, q quoted insult, m meant, u unmeant threat, and
    t for a threat that no target stands before."""
    report = Transducer("own", {("own", REPORT): ("told", OTHER), ("told", INSULT): ("told", "q"), ("told", THREAT): ("told", "u"), ("told", REPORT): ("told", OTHER)})
    negation_arcs = {}
    for left in range(4):
        negation_arcs[(left, NEGATION)] = (3, OTHER)
        for x in (OTHER, TARGET, "q", "u"):
            negation_arcs[(left, x)] = (max(0, left - 1), x)
        if left:
            negation_arcs[(left, INSULT)] = (left - 1, "d")
            negation_arcs[(left, THREAT)] = (left - 1, "u")
    target = Transducer("none", {("none", TARGET): ("seen", OTHER), ("seen", TARGET): ("seen", OTHER), ("seen", INSULT): ("seen", "a"), ("seen", THREAT): ("seen", "m")})
    insult = Transducer("", {("", INSULT): ("", "p"), ("", THREAT): ("", "t")})
    machine = report
    for after in (Transducer(0, negation_arcs), target, insult):
        machine = machine.compose(after, "ITGNRO")
    return machine


class Grammar:
    """Yields of texts under a lexicon: token -> (class, weight)."""

    def __init__(self, lexicon: dict[str, tuple[str, float]]):
        self.lexicon, self.machine = lexicon, grammar()
        self.marked = {w for w, (c, _) in lexicon.items() if c in (INSULT, THREAT)}

    def clause(self, words: list[str]) -> np.ndarray:
        """The yields of a clause.  An insult before its target is aimed too, a threat meant."""
        out, state, aimed, open_threats = np.zeros(len(YIELDS)), self.machine.start, False, 0.0
        for word in words:
            kind, weight = self.lexicon.get(word, (OTHER, 0.0))
            aimed = aimed or kind == TARGET
            state, y = self.machine.step(state, kind)
            if y == "t":
                open_threats += weight
            elif y in "padqmu":
                out["padqmu".index(y)] += weight
        out[4 if aimed else 5] += open_threats
        if aimed:
            out[1] += out[0]
            out[0] = 0.0
        return out

    def features(self, text: str | None) -> np.ndarray:
        """log1p of the summed yields, of the best clause and of the number of matched clauses."""
        out, best, matched = np.zeros(len(YIELDS)), 0.0, 0
        if text:
            low = text.lower()
            if not self.marked.isdisjoint(_WORD.findall(low)):
                for clause in _CLAUSE.split(low):
                    words = _WORD.findall(clause)
                    if not self.marked.isdisjoint(words):
                        y = self.clause(words)
                        out += y
                        matched += 1
                        best = max(best, float(y[0] + y[1] + y[4]))
        return np.log1p([*out, best, matched])


def _sampled(labels: DataFrame, most: int) -> DataFrame:
    """doc_id, toxic of at most about ``most`` documents, by a hash of the id; the worst label counts."""
    known = labels.select("doc_id", "toxic").filter("toxic is not null and doc_id is not null")
    n = known.count()
    if n > most:
        known = known.filter(drawn("labels", "doc_id") < most / n)
    return known.groupBy("doc_id").agg((F.max("toxic") >= 1).cast("int").alias("toxic"))


def learned_terms(docs: DataFrame, labels: DataFrame) -> dict[str, float]:
    """Words of toxic texts with their log odds; docs: doc_id, text; labels: a bounded sample, which bounds the
    words, too, as each is in MIN_TEXTS toxic texts at least."""
    rows = docs.join(F.broadcast(labels), "doc_id").select("toxic", F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")).alias("words"))
    counts = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    totals = labels.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).first()
    if not totals.t or not totals.c:
        return {}
    odds = F.log((F.col("t") + 0.5) / (totals.t + 1.0)) - F.log((F.col("c") + 0.5) / (totals.c + 1.0))
    terms = counts.filter((F.col("t") >= MIN_TEXTS) & (F.length("word") > 1)).withColumn("odds", odds).filter(F.col("odds") >= MIN_ODDS)
    return {r.word: float(r.odds) for r in terms.collect()}


def lexicon_of(terms: dict[str, float]) -> dict[str, tuple[str, float]]:
    lexicon = {w: (kind, SEED_WEIGHT if kind == INSULT else 1.0) for kind, words in SEEDS.items() for w in words.split()}
    for word, odds in terms.items():
        if lexicon.get(word, (INSULT,))[0] == INSULT:
            lexicon[word] = (INSULT, odds)
    return lexicon


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method; the bias comes first and isn't shrunk."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w, shrink = np.zeros(a.shape[1]), np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + shrink, a.T @ (y - p) - shrink @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def features_of(spark: SparkSession, lexicon: dict, text: Column) -> Column:
    """The features of a text column, array<double>."""
    shared, made = spark.sparkContext.broadcast(lexicon), {}

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        machine = made.get(0) or made.setdefault(0, Grammar(shared.value))
        return pd.Series([machine.features(t) for t in texts])

    return features(text)


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, max_fit: int = MAX_FIT) -> tuple[dict, np.ndarray]:
    """(lexicon, weights) learned from the labelled texts.

    The weights are learned on texts other than those that gave the terms, so that chance terms get no
    more weight than they earn.
    """
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))
    known = _sampled(labels, max_labels)
    docs = docs.select("doc_id", "text")
    first = lexicon_of(learned_terms(docs, known.filter(half == 0)))
    n = known.count()
    rest = known.filter(half == 1).filter(drawn("fit", "doc_id") < min(1.0, 2 * max_fit / max(n, 1)))
    rows = docs.join(F.broadcast(rest), "doc_id").select(features_of(docs.sparkSession, first, F.col("text")).alias("features"), "toxic").collect()
    y = np.array([r.toxic for r in rows], float)
    weights = DEFAULT
    if len(rows) >= 50 and 0 < y.sum() < len(y):
        weights = fit_logistic(np.array([r.features for r in rows]), y)
    return lexicon_of(learned_terms(docs, known)), weights


def score_of(spark: SparkSession, model: tuple[dict, np.ndarray], text: Column) -> Column:
    """The score (0 to 1) of a text column."""
    lexicon, weights = model
    features = features_of(spark, lexicon, text)
    logit = F.aggregate(F.zip_with(features, F.array(*(F.lit(float(w)) for w in weights[1:])), lambda f, w: f * w), F.lit(float(weights[0])), lambda x, y: x + y)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))))


def learn_from(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[dict, np.ndarray]:
    """The model of the labelled rows outside the held-out fifth."""
    labels = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 5) != 0)
    return fit(docs, labels)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    scored = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), score_of(spark, learn_from(spark, docs, sf_dir), F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that aren't predicted toxic, columns as they came."""
    verdict = score_of(spark, learn_from(spark, docs, sf_dir), F.col("text"))
    return docs.select(F.struct(*docs.columns).alias("row"), verdict.alias("score")).filter("score < 0.5").select("row.*")
