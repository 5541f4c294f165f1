"""Counterfactual-regularised toxicity classifier.

A logistic model over the presence of words and word beginnings. In labelled sentences identity terms are
swapped for others of their kind and for none at all, and the squared changes of the score are penalised: neither
which group is mentioned nor that one is moves the score. (Swaps among groups alone would leave a score that rises with any of them.) Sentences without such a term have no swap, and the penalty does not act on
them; the model says how many it acted on.

The penalties keep logits near zero, so the score's scale is set by rows that the model has not seen: models of all
but a part of the rows give every row, without its identity terms, a logit that its own label had no part in. The slope is that of a logistic curve
through these (Platt's method), and the logit at which the labels are told apart with the fewest errors gets the score
LIMIT: at that score and above a text is called toxic.

It is fitted on at most TRAIN_DOCS labelled rows (the documented bound): features are counted and
chosen in Spark, and the driver gets one sparse row of chosen features for each. Every text is scored whole.

Defined cases: a null or empty text has no feature and gets the score of the bias alone; without labelled
rows, or with one label only, every score is the share of that label (0 without any); rows are scored as
often as they occur; equal texts have equal scores, however often and on whatever worker; a score of just 0.7
is predicted toxic; a text of any length is a set of words; extra columns play no part; an empty table
gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from plenum.storage import cut

TRAIN_DOCS, FEATURES, LEAST_DOCS = 12_000, 2000, 4
#: Least chi-square of a feature: one in a thousand of those without effect passes.
SIGNIFICANT = 10.83
COUNTERFACTUAL, SHRINK, STEPS = 1.0, 1e-4, 300
#: The score from which a text is called toxic, and the parts of the rows that are held out in turn to set the scale.
LIMIT, PARTS = 0.7, 4
#: Words whose features a worker keeps.
CACHE_WORDS = 300_000
WORD = re.compile(r"\w+")
STEMS = (4, 5, 6)

#: Identity terms, each list of one kind; a term is swapped for the next of its list.
IDENTITIES = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("female", "male"),
    ("immigrant", "refugee", "foreigner", "native"), ("immigrants", "refugees", "foreigners", "natives"),
    ("musulman", "chrétien", "juif"), ("femme", "homme"), ("mujer", "hombre"), ("musulmán", "cristiano", "judío"),
    ("frau", "mann"), ("muslimisch", "christlich", "jüdisch"),
)
SWAP = {a: group[(k + 1) % len(group)] for group in IDENTITIES for k, a in enumerate(group)}


def features(word: str) -> list[str]:
    """A word as itself, and its beginnings."""
    return ["=" + word, *[word[:n] for n in STEMS if len(word) > n]]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


class Model:
    """Weights by feature, and the bias; the rows it was fitted on, and those of them that a swap changed."""

    def __init__(self, weights: dict[str, float], bias: float, rows: int = 0, swapped_rows: int = 0):
        self.weights, self.bias, self.rows, self.swapped_rows, self._words = weights, bias, rows, swapped_rows, {}

    def __getstate__(self):
        return self.__dict__ | {"_words": {}}

    def _known(self, word: str) -> tuple[str, ...]:
        if len(self._words) >= CACHE_WORDS:
            self._words.clear()
        own = self._words[word] = tuple(f for f in features(word) if f in self.weights)
        return own

    def score(self, text: str | None) -> float:
        found: set[str] = set()
        for w in words_of(text):
            own = self._words.get(w)
            if own is None:
                own = self._known(w)
            if own:
                found.update(own)
        z = self.bias + sum(sorted(self.weights[f] for f in found))  # sorted: the same sum in every process
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


class Objective:
    """Log loss, weighted so that both labels count, plus SHRINK times the squared weights, plus strength times the mean squared change of the score's logit under a swap."""

    def __init__(self, rows: list[np.ndarray], swaps: list[list[np.ndarray]], y: np.ndarray, size: int, strength: float):
        """swaps: lists of as many rows, after each way to swap."""
        self.n, self.y, self.size, self.strength = len(rows), y, size, strength
        pairs = [(a, b) for swapped in swaps for a, b in zip(rows, swapped, strict=True)]
        self.at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.concatenate(rows).astype(int) if rows else np.zeros(0, int)
        # What a swap changes: features that go (1) and that come (-1).
        gone = [np.setdiff1d(a, b) for a, b in pairs]
        come = [np.setdiff1d(b, a) for a, b in pairs]
        self.diff_at = np.concatenate([np.repeat(np.arange(len(pairs)), [len(r) for r in part]) for part in (gone, come)]).astype(int)
        self.diff_col = np.concatenate([*gone, *come]).astype(int)
        self.sign = np.concatenate([np.ones(sum(map(len, gone))), -np.ones(sum(map(len, come)))])
        self.pairs, self.changed = len(pairs), len(np.unique(self.diff_at))
        self.changed_rows = len(np.unique(self.diff_at % max(1, len(rows))))
        weight = np.where(y > 0, min(5.0, (len(y) - y.sum()) / max(1, y.sum())), 1.0)
        self.weight = weight / weight.sum()

    def __call__(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
        """The loss and its gradient by weights and bias."""
        z = np.clip(b + np.bincount(self.at, w[self.col], self.n), -500, 500)
        change = np.bincount(self.diff_at, self.sign * w[self.diff_col], self.pairs)
        share = self.strength / max(1, self.changed)
        loss = self.weight @ (np.logaddexp(0, z) - self.y * z) + SHRINK * w @ w + share * change @ change
        e = self.weight * (1 / (1 + np.exp(-z)) - self.y)
        g = np.bincount(self.col, e[self.at], self.size) + 2 * SHRINK * w + 2 * share * np.bincount(self.diff_col, self.sign * change[self.diff_at], self.size)
        return float(loss), g, float(e.sum())


def minimise(objective: Objective) -> tuple[np.ndarray, float]:
    """Weights and bias, by Adam over all rows."""
    w, b = np.zeros(objective.size), 0.0
    m, v, mb, vb = np.zeros(objective.size), np.zeros(objective.size), 0.0, 0.0
    for t in range(1, STEPS + 1):
        _, g, gb = objective(w, b)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c, d, rate = 1 - 0.9**t, 1 - 0.999**t, 0.1 / (1 + 0.01 * t)
        w -= rate * (m / c) / (np.sqrt(v / d) + 1e-9)
        b -= rate * (mb / c) / (np.sqrt(vb / d) + 1e-9)
    return w, b


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve over logits z that minimises log loss, with targets drawn in from 0 and 1 as by one more row of each label."""
    ones = y.sum()
    t = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))

    def loss(a: float, b: float) -> float:
        return float((np.logaddexp(0, a * z + b) - t * (a * z + b)).sum())

    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -500, 500)))
        e, h = p - t, p * (1 - p) + 1e-12
        step = np.linalg.lstsq(np.array([[h @ (z * z), h @ z], [h @ z, h.sum()]]), np.array([e @ z, e.sum()]), rcond=None)[0]
        size, now = 1.0, loss(a, b)
        while size > 1e-10 and loss(a - size * step[0], b - size * step[1]) > now:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(size * step).max() < 1e-9:
            break
    return float(a), float(b)


def parting(z: np.ndarray, y: np.ndarray) -> float:
    """The logit at and above which calling rows 1 makes the fewest errors: the middle of the widest gap that does."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    inner = np.flatnonzero(np.diff(z) > 0) + 1  # a cut between two values
    if not len(inner):
        return float(z[0])
    best = inner[errors[inner] == errors[inner].min()]
    k = best[np.argmax(z[best] - z[best - 1])]
    return float((z[k - 1] + z[k]) / 2)


def scale(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn logits into those of scores, LIMIT where they part the labels best. 1 and 0 where higher logits do not mean label 1."""
    slope, _ = platt(z, y)
    if slope <= 0:
        return 1.0, 0.0
    return slope, float(np.log(LIMIT / (1 - LIMIT))) - slope * parting(z, y)


def _unseen_logits(x: list[np.ndarray], swaps: list[list[np.ndarray]], y: np.ndarray, size: int, strength: float) -> np.ndarray | None:
    """Each row's logit, without its identity terms (the last of the swaps), by a model of the rows of other parts; null if the rows outside a part lack a label."""
    part = np.arange(len(x)) % PARTS
    if any(len(np.unique(y[part != k])) < 2 for k in range(PARTS)):
        return None
    z = np.zeros(len(x))
    for k in range(PARTS):
        pick = lambda rows, k=k: [r for r, h in zip(rows, part, strict=True) if h != k]
        w, b = minimise(Objective(pick(x), [pick(s) for s in swaps], y[part != k], size, strength))
        for i in np.flatnonzero(part == k):
            z[i] = b + w[swaps[-1][i]].sum()
    return z


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, counterfactual: float = COUNTERFACTUAL) -> Model:
    """docs: id and text; labels: id and label (0 or 1). train_docs / 2 rows of each label at most are drawn, by a hash of id and text; equal rows count once.

    So one id for many rows, or an id with both labels, neither loses a label nor takes more rows. Rows without an id have no label.
    """
    labels = labels.filter("id is not null and label is not null").select("id", F.col("label").cast("int").alias("label")).distinct()
    own = docs.filter("id is not null").select("id", F.xxhash64("id", "text", F.lit("train")).alias("draw")).distinct()
    labelled = cut(own.join(labels, "id"))  # numbers alone
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(sizes) < 2:
        share = float(next(iter(sizes), 0))
        return Model({}, 500.0 if share else -500.0)
    # Twice the half of each label, or all of it, then the first of them: ranks are told among few rows.
    half = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, (train_docs + 40) / n))])
    even = F.pmod(F.col("draw"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("draw", "id"))
    drawn = labelled.filter(even < F.element_at(half, F.col("label"))).withColumn("rank", rank).filter(F.col("rank") <= train_docs / 2).select("id", "draw", "label")
    drawn = F.broadcast(cut(drawn))  # train_docs rows at most
    texts = docs.select("id", "text", F.xxhash64("id", "text", F.lit("train")).alias("draw")).join(drawn, ["id", "draw"])
    sample = cut(texts.groupBy("id", "draw", "label").agg(F.first("text").alias("text")).select("text", "label"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[str, list[int]] = {}
            for text, label in zip(batch["text"], batch["label"], strict=True):
                for f in {f for w in words_of(text) for f in features(w)}:
                    out.setdefault(f, [0, 0])[label] += 1
            yield pd.DataFrame([(f, a, b) for f, (a, b) in out.items()], columns=["f", "n0", "n1"])

    counts = sample.mapInPandas(count, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    n0, n1 = (min(sizes[k], train_docs / 2) for k in (0, 1))
    gap = F.col("n1") / n1 - F.col("n0") / n0
    share = F.least((F.col("n0") + F.col("n1")) / (n0 + n1), F.lit(0.999))
    score = gap * gap / (share * (1 - share)) * (n0 * n1 / (n0 + n1))  # chi-square of one degree of freedom
    chosen = counts.filter((F.col("n0") + F.col("n1") >= LEAST_DOCS) & (score >= SIGNIFICANT)).orderBy(F.desc(score), "f").limit(FEATURES)
    names = sorted({r["f"] for r in chosen.collect()} | {"=" + a for a in SWAP})
    index = {f: k for k, f in enumerate(names)}

    def row(words: set[str]) -> list[int]:
        return sorted({index[f] for w in words for f in features(w) if f in index})

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [words_of(t) for t in batch["text"]]
            other, none = [row({SWAP.get(a, a) for a in w}) for w in words], [row(w - SWAP.keys()) for w in words]
            yield pd.DataFrame({"x": [row(w) for w in words], "other": other, "none": none, "label": batch["label"]})

    rows = sample.mapInPandas(sparse, "x array<int>, other array<int>, none array<int>, label int").collect()
    rows.sort(key=lambda r: (r["label"], r["x"]))
    x, other, none = ([np.array(r[c], int) for r in rows] for c in ("x", "other", "none"))
    y = np.array([r["label"] for r in rows], float)
    objective = Objective(x, [other, none], y, len(names), counterfactual)
    w, b = minimise(objective)
    if (z := _unseen_logits(x, [other, none], y, len(names), counterfactual)) is not None:
        slope, offset = scale(z, y)
        w, b = slope * w, slope * b + offset
    return Model({f: float(w[k]) for k, f in enumerate(names) if w[k]}, float(b), len(rows), objective.changed_rows)


def toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The score of each row of docs, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES and the identity terms

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return score(F.col(text_col).cast("string"))
