"""Quality classifier: Naive Bayes support vectors on n-gram indicators."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import pack_row, ship

#: Labelled rows that the model is fitted on, those of the least hashes; more are left out of the fit, never of the scores.
TRAINING_ROWS = 4000
#: n-grams of bytes, and of equal neighbours among words and lines, are hashed into so many indicators.
DIMENSIONS = 1 << 18
LONGEST = 4
#: Added to every count before the ratio.
SMOOTHING = 1.0
#: Weight of the fitted coefficients against their mean size.
INTERPOLATION = 0.25
COST = 1.0
EPOCHS = 12
#: A score from here on predicts label 1.
THRESHOLD = 0.3
_CHUNK = 1 << 20
_MIX = np.uint32(2654435761)
_SHIFT = np.uint32(32 - 18)


def features(text: str | None) -> np.ndarray:
    """Sorted indicators of one text: byte n-grams up to LONGEST; a word or line that equals one before.

    Empty and null texts have the constant indicator alone.
    """
    raw = (text or "").encode("utf-8", "replace")
    marked = np.zeros(DIMENSIONS, bool)
    for at in range(0, len(raw), _CHUNK):
        x = np.frombuffer(raw[at:at + _CHUNK + LONGEST - 1], np.uint8).astype(np.uint32)
        code = x
        for n in range(1, LONGEST + 1):
            if n > 1:
                code = (code[:-1] << np.uint32(8)) | x[n - 1:]
            marked[((code + np.uint32(n * 40503)) * _MIX) >> _SHIFT] = True
    words = raw.split()
    twice = [a == b for a, b in zip(words, words[1:])]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    marks = [True, any(twice), any(a and b for a, b in zip(twice, twice[1:])), len(set(lines)) < len(lines),
             2 * len(set(lines)) < len(lines), 4 * sum(twice) > len(words) > 0]
    marked[:len(marks)] = marks  # these few places are theirs
    return np.flatnonzero(marked).astype(np.int32)


@dataclass
class Model:
    """weights by indicator (ratio and coefficient in one), those of ratios alone for the length, scale and shift of the score."""

    weights: np.ndarray
    squares: np.ndarray
    scale: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        norm = float(np.sqrt(self.squares[found].sum(dtype=np.float64)))
        return float(self.weights[found].sum(dtype=np.float64)) / norm if norm else 0.0

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * margin + self.shift, -500, 500)))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    counts = np.full((2, DIMENSIONS), SMOOTHING)
    for found, label in zip(rows, labels):
        counts[label, found] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    ratios = np.log(shares[1] / shares[0])
    ratios[0] = 1.0  # the constant
    return ratios


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, seed: int = 7) -> np.ndarray:
    """The linear hinge-loss (L1) support vector machine: one dual variable at a time, in random order, box [0, C_i].

    The two classes get the same total cost.
    """
    w = np.zeros(DIMENSIONS)
    share = np.where(signs > 0, (signs > 0).mean(), (signs < 0).mean())
    cost = COST * 0.5 / share
    alpha = np.zeros(len(rows))
    draw = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in draw.permutation(len(rows)):
            found, x, y = rows[i], values[i], signs[i]
            slope = y * (w[found] @ x) - 1
            new = min(max(alpha[i] - slope, 0.0), cost[i])  # rows have length 1
            if new != alpha[i]:
                w[found] += (new - alpha[i]) * y * x
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def platt(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logistic score, by Newton steps on smoothed targets."""
    up, down = int(labels.sum()), int((1 - labels).sum())
    target = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, float(np.log((up + 1) / (down + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        g = np.array([((p - target) * margins).sum() + 1e-6 * a, (p - target).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * margins * margins).sum() + 1e-6, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        size = max(1.0, np.abs(step).max() / 4)
        a, b = a - step[0] / size, b - step[1] / size
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def _weigh(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ratios = log_count_ratios(rows, labels)
    values = []
    for found in rows:
        x = ratios[found]
        norm = np.sqrt((x * x).sum())
        values.append(x / norm if norm else x)
    w = dual_coordinate_descent(rows, values, np.where(labels == 1, 1.0, -1.0))
    mean = np.abs(w).sum() / DIMENSIONS
    w = (1 - INTERPOLATION) * mean + INTERPOLATION * w
    return w * ratios, ratios * ratios


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """A fifth of the rows, never in the fit that scores them, sets the scale; then all rows are fitted.

    Without both labels the score is the smoothed share of label 1, the same for every text.
    """
    labels = np.asarray(labels, int)
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(DIMENSIONS, np.float32), np.zeros(DIMENSIONS, np.float32), 1.0, float(np.log(share / (1 - share))))
    apart = np.arange(len(rows)) % 5 == 0
    rest = labels[~apart]
    if len(set(rest.tolist())) < 2 or len(set(labels[apart].tolist())) < 2:
        apart = np.zeros(len(rows), bool)
        rest = labels
    first = Model(*_weigh([r for r, x in zip(rows, apart) if not x], rest), 1.0, 0.0)
    judged = apart if apart.any() else ~apart
    margins = np.array([first.margin(r) for r, x in zip(rows, judged) if x])
    scale, shift = platt(margins, labels[judged])
    weights, squares = _weigh(rows, labels)
    return Model(weights.astype(np.float32), squares.astype(np.float32), scale, shift)


def remainder(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality",
          rows: int = TRAINING_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents outside the held-out fifth, those with the least hashes.

    The chosen labels, bounded by ``rows``, are broadcast, so that texts are not shuffled; what comes to the driver is bounded
    again after the join, as ids may repeat. Null ids and labels other than 0 and 1 teach nothing.
    """
    ship(docs.sparkSession)
    usable = labels.select(labels[id_col].alias("_id"), labels[label].cast("int").alias("_label")).filter(
        F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & (remainder(F.col("_id")) != 0))
    chosen = usable.orderBy(F.xxhash64("_id"), "_id", "_label").limit(rows)

    @F.pandas_udf("binary")
    def indicators(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t).astype("<i4").tobytes() for t in texts])

    given = docs.select(docs[id_col].alias("_doc"), docs[text].alias("_text"))
    met = given.join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    taught = met.select("_id", "_label", indicators("_text").alias("_found"))
    got = taught.orderBy(F.xxhash64("_id"), "_id", "_label", F.xxhash64("_found")).limit(rows).toPandas()
    return fit([np.frombuffer(x, "<i4") for x in got["_found"]], got["_label"].to_numpy(dtype=int))


def score_column(docs: DataFrame, model: Model, text: str = "text") -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        fitted = shared.value
        return pd.Series(fitted.score(np.array([fitted.margin(features(t)) for t in texts], dtype=np.float64)))

    return score(docs[text])


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Of every row: ``row`` (all its columns), ``held_out``, ``score`` and ``predicted``.

    Every whole text is scored, null as empty; a null id is not held out. Scores depend on the text alone.
    """
    model = train(docs, labels, id_col, text)
    scored = pack_row(docs, held_out=F.coalesce(remainder(docs[id_col]) == 0, F.lit(False)), score=score_column(docs, model, text))
    return scored.select(F.col("_row").alias("row"), F.col("_held_out").alias("held_out"), F.col("_score").alias("score"),
                         F.when(F.col("_score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
