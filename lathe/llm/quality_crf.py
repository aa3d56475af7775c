"""Line-level quality by a linear-chain conditional random field (operator 7).

Each line of a text is good or bad. A line's features are its own, those of the line before and those
of the line after it; a pair of neighbouring labels has a weight of its own. Lines are trained with
their document's label, which is all that the labels say. A document's quality is the mean of its
lines' marginal probabilities of being good, by forward-backward, weighted by the lines' lengths; a
slope and an intercept, fitted on other labelled rows, turn its logit into a score.

The field is fitted on the driver on a bounded sample of labelled rows (`max_fit` documents of at most
`max_lines` lines, drawn by a hash of the id, with lines' features computed on the executors). Everything
else is scored where it is, whole.

Edge cases: null text is the empty text; blank lines aren't labelled; a text without words has no good
line; null labels and ids don't count; without labels of both classes all scores are
alike; rows with equal ids each get a row; extra columns stay, but for `quality_score` and
`quality_predicted`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.llm import common
from lathe.llm.labelled import fold, logistic, with_labels

MAX_FIT = 4_000
#: Labelled texts of more lines don't fit the field (they are scored like any other).
MAX_LINES = 200
_SYMBOLS = bytes(b"#*$%&|<>")
_UPPER = bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_DIGITS = bytes(range(48, 58))
N_LINE = 16


def line_features(line: bytes, words: list[bytes], seen: set[bytes]) -> list[float]:
    """Of a line with words; seen: the lines before it."""
    n, size = len(words), sum(map(len, words))
    symbols = len(line) - len(line.translate(None, _SYMBOLS))
    upper = len(line) - len(line.translate(None, _UPPER))
    letters = len(line) - len(line.translate(None, _LETTERS))
    digits = len(line) - len(line.translate(None, _DIGITS))
    distinct = len(set(words))
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    short = sum(len(w) <= 3 for w in words)
    return [
        1.0,
        min(math.log1p(n), 6.0),
        min(size / n, 20.0) / 10,
        symbols / size,
        float(symbols > 0.1 * n),
        upper / (letters + 1),
        float(upper > 0.5 * letters),
        digits / size,
        (size - letters - digits) / size,
        line.count(b"!") / n,
        line.count(b"|") / n,
        1 - distinct / n,
        repeats / n,
        short / n,
        float(line in seen),
        float(words[-1][-1:] in b".?!"),
    ]


def text_lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x N_LINE) and lengths of the lines that have words."""
    rows, sizes, seen = [], [], set()
    for line in text.encode("utf-8").split(b"\n"):
        words = line.split()
        if words:
            rows.append(line_features(line, words, seen))
            sizes.append(float(sum(map(len, words))))
            seen.add(line)
    return np.array(rows).reshape(-1, N_LINE), np.array(sizes)


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Each line's features, then those of the lines before and after it (zeros beyond the ends)."""
    none = np.zeros((1, x.shape[1]))
    return np.hstack([x, np.vstack([none, x[:-1]]), np.vstack([x[1:], none])]) if len(x) else np.zeros((0, 3 * x.shape[1]))


@dataclass
class Field:
    """weights of a good line's features, and of (bad, bad), (bad, good), (good, bad), (good, good)."""

    weights: np.ndarray
    pairs: np.ndarray
    slope: float
    intercept: float


def forward_backward(odds: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Marginal probability that each line is good. odds: its log odds from its features."""
    n = len(odds)
    (bb, bg), (gb, gg) = np.exp(pairs.reshape(2, 2)).tolist()
    good = np.exp(np.clip(odds, -30, 30)).tolist()
    ahead, ratio = [0.0] * n, good[0]
    ahead[0] = ratio
    for t in range(1, n):
        ratio = good[t] * (bg + ratio * gg) / (bb + ratio * gb)
        ratio = min(max(ratio, 1e-30), 1e30)
        ahead[t] = ratio
    out, back = [0.0] * n, 1.0
    for t in range(n - 1, -1, -1):
        r = ahead[t] * back
        out[t] = r / (1 + r)
        g = good[t] * back
        back = min(max((gb + g * gg) / (bb + g * bg), 1e-30), 1e30)
    return np.array(out)


def _objective(x: np.ndarray, starts: np.ndarray, label: np.ndarray, w: np.ndarray, pairs: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Negative log-likelihood a document of chains whose lines all have their document's label, and
    its gradient. Documents go through the recursions side by side, longest first."""
    sizes = np.diff(np.r_[starts, len(x)])
    docs = len(sizes)
    odds = x @ w
    scale = 1 / sizes  # documents count alike, whatever their length
    table = np.exp(pairs.reshape(2, 2))
    alive = [int((sizes > t).sum()) for t in range(int(sizes.max()))]
    alpha = np.zeros((len(x), 2))
    norm = np.zeros(docs)
    emit = np.stack([np.zeros(len(x)), odds], axis=1)
    for t, k in enumerate(alive):
        at = starts[:k] + t
        a = np.exp(emit[at]) if not t else (alpha[at - 1] @ table) * np.exp(emit[at])
        s = a.sum(1)
        alpha[at] = a / s[:, None]
        norm[:k] += np.log(s)
    beta = np.ones((len(x), 2))
    edges = np.zeros((docs, 4))
    for t in range(len(alive) - 1, 0, -1):
        k = alive[t]
        at = starts[:k] + t
        m = np.exp(emit[at]) * beta[at]
        joint = alpha[at - 1][:, :, None] * table[None] * m[:, None, :]
        edges[:k] += (joint / joint.sum((1, 2))[:, None, None]).reshape(k, 4)
        b = m @ table.T
        beta[at - 1] = b / b.sum(1)[:, None]
    good = alpha * beta
    good = good[:, 1] / good.sum(1)
    of = np.repeat(np.arange(docs), sizes)
    y = label[of]
    fit = np.add.reduceat(y * odds, starts) + (sizes - 1) * np.where(label == 1, pairs[3], pairs[0])
    loss = (scale * (norm - fit)).mean() + l2 * (w @ w + pairs @ pairs)
    slope_w = x.T @ (scale[of] * (good - y)) / docs + 2 * l2 * w
    want = np.zeros((docs, 4))
    want[label == 0, 0], want[label == 1, 3] = (sizes - 1)[label == 0], (sizes - 1)[label == 1]
    slope_p = (scale[:, None] * (edges - want)).mean(0) + 2 * l2 * pairs
    return float(loss), np.r_[slope_w, slope_p]


def train_field(docs: list[tuple[np.ndarray, int]], l2: float = 1e-4, steps: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """docs: features with neighbours and label of each document with lines. Gradient descent with
    momentum and a step for each weight (Adam)."""
    width = 3 * N_LINE
    docs = sorted((d for d in docs if len(d[0])), key=lambda d: -len(d[0]))
    theta = np.zeros(width + 4)
    if not docs or len({y for _, y in docs}) < 2:
        return theta[:width], theta[width:]
    x = np.vstack([d[0] for d in docs])
    starts = np.cumsum([0, *(len(d[0]) for d in docs[:-1])])
    label = np.array([d[1] for d in docs], float)
    m = v = np.zeros_like(theta)
    for t in range(1, steps + 1):
        _, slope = _objective(x, starts, label, theta[:width], theta[width:], l2)
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return theta[:width], theta[width:]


def summary(text: str, weights: np.ndarray, pairs: np.ndarray) -> tuple[float, np.ndarray]:
    """Of a text: the logit of its length-weighted mean marginal, and its lines' marginals."""
    x, sizes = text_lines(text)
    good = forward_backward(with_neighbours(x) @ weights, pairs) if len(x) else np.zeros(0)
    p = min(max(float(np.average(good, weights=sizes)) if len(x) else 0.0, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p)), good


def logits_udf(weights: np.ndarray, pairs: np.ndarray):
    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([summary(t.as_py() or "", weights, pairs)[0] for t in texts], pa.float64())

    return of


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _flat_features(texts: pa.Array) -> pa.Array:
    return pa.array([text_lines(t.as_py() or "")[0].ravel() for t in texts], pa.list_(pa.float64()))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", train=None, max_fit: int = MAX_FIT, max_lines: int = MAX_LINES) -> Field:
    """train: a condition on labels' ids of the rows to learn from (default: all). At most about
    max_fit documents, by a hash of the id, fit the field, and as many others the link."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
    if train is not None:
        usable = usable.where(train)
    share = min(1.0, 2 * max_fit / max(1, usable.count()))
    drawn = usable.where(F.pmod(F.xxhash64(F.lit("fit"), F.col(id_col)), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = with_labels(docs.select(id_col, text_col), drawn, id_col, label).withColumn("_part", F.pmod(F.xxhash64(F.lit("part"), F.col(id_col)), F.lit(2)))
    sample = common.durable(rows, "labelled-sample", files=8)
    short = F.size(F.split(F.col(text_col), "\n")) <= max_lines
    found = sample.where(F.coalesce((F.col("_part") == 0) & short, F.lit(False))).select(_flat_features(F.col(text_col)).alias("x"), "label_").toArrow()
    lines = [np.array(x, float).reshape(-1, N_LINE) for x in found.column("x").to_pylist()]
    weights, pairs = train_field([(with_neighbours(x), y) for x, y in zip(lines, found.column("label_").to_pylist())])
    found = sample.where("_part = 1").select(logits_udf(weights, pairs)(F.col(text_col)).alias("x"), "label_").toArrow()
    slope, intercept = logistic(found.column("x").to_numpy().reshape(-1, 1), np.array(found.column("label_").to_pylist(), float))
    return Field(weights, pairs, float(slope[0]), intercept)


def score(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """docs with quality_score (0 to 1) and quality_predicted (1 from 0.5 on)."""
    z = F.lit(field.intercept) + field.slope * logits_udf(field.weights, field.pairs)(F.col(text_col))
    scored = docs.withColumn("quality_score", 1 / (1 + F.exp(-z)))
    return scored.withColumn("quality_predicted", (F.col("quality_score") >= 0.5).cast("int"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; rows whose crc32(doc_id) modulo 3 is 1 are held out of the fit."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    field = fit(docs, common.table(spark, sf_dir, "labels"), train=~held_out)
    return score(docs, field).select("doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))
