"""Quality classifier: Naive Bayes support vectors.

Features are indicators of n-grams over two views of a text: its words and marks, and their shapes (case, digits,
marks, repetition of the token before).  Each indicator is scaled by the log ratio of its smoothed class counts,
and a linear hinge-loss model is fitted to the scaled indicators by dual coordinate descent.  Its margin becomes a
probability through a logistic curve fitted on rows that the coordinate descent did not see.

Fitting takes a bounded, documented sample of the labelled rows; the model is a bounded table of n-grams.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import col, durable

TRAIN_ROWS = 6_000           # labelled rows fitted on, about; as many of either class where there are enough
MIN_ROWS = 3                 # rows that must hold an n-gram before it becomes a feature
FEATURES = 200_000           # most frequent n-grams kept
COST, ROUNDS, SMOOTH = 1.0, 12, 1.0
THRESHOLD = 0.3
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def _shape(token: str) -> str:
    if token[0].isalpha():
        case = "U" if token.isupper() and len(token) > 1 else "T" if token[0].isupper() else "l"
        return case + str(min(len(token) // 4, 4))
    return "9" if token[0].isdigit() else token[:2]


def ngrams(text: str | None) -> set[str]:
    """The distinct n-grams of a text; an empty text has the one feature that says so."""
    tokens = TOKEN.findall(text or "")
    if not tokens:
        return {"empty"}
    memo: dict[str, tuple[str, str]] = {}
    lows, shapes = [], []
    before = None
    for t in tokens:
        pair = memo.get(t)
        if pair is None:
            pair = memo[t] = (t.lower(), _shape(t))
        lows.append(pair[0])
        shapes.append("=" if t == before else pair[1])
        before = t
    found = set(lows)
    found.update(map(" ".join, zip(lows, lows[1:])))
    two = ["/".join(x) for x in zip(shapes, shapes[1:])]
    found.update("s:" + s for s in set(shapes))
    found.update("s:" + s for s in set(two))
    found.update("s:" + s for s in set(map("/".join, zip(two, shapes[2:]))))
    return found


@dataclass
class QualityModel:
    """Weights of plain indicators (log-count ratio times hinge weight) and the squared ratios that give a row's length."""

    index: dict[str, int]
    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, at: np.ndarray) -> float:
        if not len(at):
            return self.bias
        return self.bias + float(self.weights[at].sum()) / max(float(np.sqrt(self.squares[at].sum())), 1e-9)

    def score(self, text: str | None) -> float:
        """Probability of label 1; texts without any known n-gram get that of the bias."""
        at = np.array([i for i in map(self.index.get, ngrams(text)) if i is not None], np.int64)
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(at) + self.offset, -30.0, 30.0))))


def hinge_fit(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, width: int, costs: np.ndarray,
              rounds: int = ROUNDS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Weights (the last one is the bias) and dual variables of the L2-regularised hinge loss.

    Dual coordinate descent: one dual variable per row, between 0 and the row's cost, is set to its best value
    while the others rest, rows in random order.
    """
    w, alpha = np.zeros(width + 1), np.zeros(len(rows))
    squares = np.array([v @ v + 1.0 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for k in rng.permutation(len(rows)):
            at, v = rows[k]
            gradient = signs[k] * (w[at] @ v + w[-1]) - 1.0
            new = min(max(alpha[k] - gradient / squares[k], 0.0), costs[k])
            if (step := (new - alpha[k]) * signs[k]) != 0.0:
                w[at] += step * v
                w[-1] += step
                alpha[k] = new
    return w, alpha


def _logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the weighted (margin, label), by damped Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, v = weight * (p - y), weight * p * (1 - p)
        g = np.array([d @ margin + 1e-3 * (a - 1.0), d.sum() + 1e-3 * b])
        h = np.array([[v @ margin**2 + 1e-3, v @ margin], [v @ margin, v.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def _nbsvm(index: dict[str, int], rows: list[np.ndarray], y: np.ndarray, seed: int = 1) -> QualityModel:
    """Ratios and hinge weights from rows of feature numbers; every row is scaled to length one."""
    count = np.full((2, max(1, len(index))), SMOOTH)
    for at, label in zip(rows, y.astype(int)):
        count[label, at] += 1
    ratio = np.log((count[1] / count[1].sum()) / (count[0] / count[0].sum()))
    share = np.where(y > 0, y.mean(), 1 - y.mean())
    data = [(at, ratio[at] / max(float(np.linalg.norm(ratio[at])), 1e-9)) for at in rows]
    w, _ = hinge_fit(data, np.where(y > 0, 1.0, -1.0), len(ratio), COST / (2 * share), seed=seed)
    return QualityModel(index, w[:-1] * ratio, ratio * ratio, float(w[-1]))


def fit_rows(index: dict[str, int], rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> QualityModel:
    """The model of rows in memory.  ``weight``: labelled rows that a row stands for; one class alone, or no row,
    gives that share as every score."""
    if not len(y) or y.min() == y.max():
        p = (weight @ y + 1) / (weight.sum() + 2) if len(y) else 0.5
        return QualityModel({}, np.zeros(0), np.zeros(0), float(np.log(p / (1 - p))))
    model = _nbsvm(index, rows, y)
    unseen = np.arange(len(y)) % 4 == 0
    if all((y[part] == label).sum() >= 5 for part in (unseen, ~unseen) for label in (0, 1)):
        part = _nbsvm(index, [r for r, u in zip(rows, unseen) if not u], y[~unseen])
    else:
        part, unseen = model, np.ones(len(y), bool)
    margins = np.array([part.margin(rows[k]) for k in np.flatnonzero(unseen)])
    model.slope, model.offset = _logistic(margins, y[unseen], weight[unseen])
    return model


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", train_rows: int = TRAIN_ROWS, features: int = FEATURES) -> QualityModel:
    """Learn from the labelled rows of ``docs``; whole texts are read.

    Each class gives about half of ``train_rows``, picked by a hash of the identifier.  Labels other than 0 and
    1 and labels without a row teach nothing; an identifier with several labels counts as the smallest of them.
    """
    marks = (labels.select(col(id_col).alias("id"), col(label_col).cast("int").alias("y")).where("y IN (0, 1) AND id IS NOT NULL")
             .groupBy("id").agg(F.min("y").alias("y")))
    sizes = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {y: min(1.0, train_rows / 2 / n) for y, n in sizes.items()}
    part = F.when(F.col("y") == 1, F.lit(share.get(1, 0.0))).otherwise(F.lit(share.get(0, 0.0)))
    picked = durable(marks.where(F.pmod(F.xxhash64("id", F.lit("train")), F.lit(1_000_003)) < part * 1_000_003), "picked")

    @F.pandas_udf("array<string>")
    def grams(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(ngrams(t)) for t in texts])

    # ``picked`` has about train_rows rows at any size of the corpus, so it is broadcast and texts stay in place.
    rows = durable(docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
                   .join(F.broadcast(picked), "id").select("id", "y", grams("text").alias("grams")), "grams")
    names = [r["gram"] for r in rows.select(F.explode("grams").alias("gram")).groupBy("gram").count()
             .where(F.col("count") >= MIN_ROWS).orderBy(F.col("count").desc(), "gram").limit(features).collect()]
    index = {g: i for i, g in enumerate(names)}

    @F.pandas_udf("array<int>")
    def numbers(found: pd.Series) -> pd.Series:
        return pd.Series([np.sort(np.array([i for i in map(index.get, g) if i is not None], np.int32)) for g in found])

    got = rows.select("id", "y", numbers("grams").alias("at")).orderBy("id").toPandas()
    y = got["y"].to_numpy(float)
    weight = np.array([1.0 / share[int(v)] for v in y])
    return fit_rows(index, [np.asarray(a, np.int64) for a in got["at"]], y, weight)


def score_quality(df: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with score (0 to 1, higher: label 1 likelier) and predicted (1 from ``threshold`` on, else 0).

    Columns of these names are replaced.  Null counts as empty; an empty text is scored by the feature that says
    so.  Whole texts are read; repeated rows score alike; an empty table stays empty.
    """
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return (df.drop("score", "predicted").withColumn("score", score(col(text_col).cast("string")))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
