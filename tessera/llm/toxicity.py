"""Toxic passages as maximum-scoring segments (operator 6).

Token scores are log-odds of toxic against clean labelled text, smoothed by Dirichlet priors: a word's prior is the rate
of its 7-letter beginning, whose prior is that of its 5 letters, then 3, then all text; words that no unit of the model
begins have a small negative score.  A linear scan finds every maximal segment of a text (each segment that no extension
improves), their scores are put on the scale of extreme values (lambda from the score distribution of clean text, K from
the clean maxima), and a logistic curve over the largest and the summed significant scores gives the probability.

Input rules: null and empty texts have no segment and get the score of a text without evidence; null labels teach
nothing; repeated label rows count once, the larger label wins; with no usable labels every score is 0.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import discard, enter, id_remainder, materialize, text_or_empty

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 5, 7)
FULL = "$"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def units(word: str) -> list[str]:
    """The chain of a word's units, from the shortest beginning to the whole word."""
    return [word[:n] for n in PREFIXES if len(word) > n] + [word + FULL]


@dataclass
class ToxicModel:
    """`scores`: log-odds of the units kept; `gap`: score of all other words; `lam`, `k`: extreme-value parameters;
    `curve`: intercept and slopes of the logistic curve."""

    scores: dict[str, float] = field(default_factory=dict)
    gap: float = -0.15
    lam: float = 1.0
    k: float = 0.1
    curve: tuple[float, float, float] = (-40.0, 0.0, 0.0)


class _WordScores(dict):
    """Scores of words as they are met; bounded."""

    def __init__(self, model: ToxicModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        scores = self.model.scores
        s = next((scores[u] for u in reversed(units(word)) if u in scores), self.model.gap)
        if len(self) > 150_000:
            self.clear()
        self[word] = s
        return s


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end past the last, score) by Ruzzo and Tompa's scan; linear in the length.

    Only positive scores open a segment, so the runs of others between them are taken from cumulative sums."""
    total = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    held: list[list] = []  # start, end, cumulative score before the start and at the end
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, left, right = i, i + 1, float(total[i]), float(total[i + 1])
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= left:
                j = held[j][4]
            if j < 0 or held[j][3] >= right:
                held.append([start, end, left, right, j])
                break
            start, left = held[j][0], held[j][2]
            del held[j:]
    return [(a, b, r - x) for a, b, x, r, _ in held]


def evidence(model: ToxicModel, scores: np.ndarray) -> tuple[float, float, list[tuple[int, int, float]]]:
    """The largest normalised segment score, the sum of the significant ones, and those segments."""
    floor = math.log1p(model.k * len(scores))  # never negative: a text without evidence has none, however short
    found = [(a, b, model.lam * s - floor) for a, b, s in maximal_segments(scores)] if len(scores) else []
    good = [x for x in found if x[2] > 0]
    top = max((x[2] for x in found), default=-floor)
    return top, sum(x[2] for x in good), good


def text_scorer(model: ToxicModel):
    """A function from texts to (score, start of the best passage, its end, passages) lists; positions are words."""
    known = _WordScores(model)

    def run(texts) -> list[tuple[float, int, int, int]]:
        out = []
        for t in texts:
            w = words_of(t or "")
            s = np.fromiter(map(known.__getitem__, w), dtype=np.float64, count=len(w))
            top, total, good = evidence(model, s)
            best = max(good, key=lambda x: x[2], default=(-1, -1, 0.0))
            a, b, c = model.curve
            z = a + b * top + c * math.log1p(total)
            out.append((1 / (1 + math.exp(-max(-60.0, min(60.0, z)))), best[0], best[1], len(good)))
        return out

    return run


def _count_units(batches):
    enter("toxicity")
    counts: dict[str, list[int]] = {}

    def flush():
        keys = list(counts)
        t, c = [counts[k][1] for k in keys], [counts[k][0] for k in keys]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(t, pa.int64()), pa.array(c, pa.int64())], names=["unit", "toxic", "clean"])

    for b in batches:
        for t, y in zip(b.column("t").to_pylist(), b.column("y").to_pylist()):
            for w in set(words_of(t)):  # once a document: a word repeated a thousand times is one observation
                for u in units(w):
                    if u in counts:
                        counts[u][y] += 1
                    else:
                        counts[u] = [1, 0] if y == 0 else [0, 1]
            if len(counts) > 150_000:
                yield flush()
    if counts:
        yield flush()


def _newton(a: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, np.ndarray]:
    """The least loss of a logistic regression with a small ridge, and its weights.

    A step is halved until the loss falls: full steps can cycle for ever where the classes are nearly apart."""

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float(np.logaddexp(0, z).sum() - y @ z + ridge / 2 * (w @ w))

    w = np.zeros(a.shape[1])
    now = loss(w)
    for _ in range(200):
        p = 0.5 * (1 + np.tanh(a @ w / 2))
        g = a.T @ (p - y) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        gain = float(g @ step)  # twice what a full step would gain were the loss a parabola
        if gain < 1e-10 * (1 + now):
            return now, w
        size = 1.0
        while (then := loss(w - size * step)) > now - 1e-4 * size * gain and size > 1e-12:
            size /= 2
        if then >= now:
            return now, w  # as near as rounding lets it come
        w, now = w - size * step, then
    return now, w


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Intercept and slopes of the logistic curve; more evidence never lowers a score, so no slope is below zero.

    The best curve under that bound is the best of those that leave features out and have no negative slope."""
    found = []
    for used in ([], [0], [1], [0, 1]):
        least, w = _newton(np.column_stack([np.ones(len(x)), x[:, used]]), y)
        if (w[1:] >= 0).all():
            curve = np.zeros(3)
            curve[[0, *(c + 1 for c in used)]] = w
            found.append((least, *curve.tolist()))
    return min(found)[1:]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", modulus: int = 5, held_out: int = 0, max_labelled: int = 60_000, prior: float = 4.0, min_z: float = 3.0) -> ToxicModel:
    """Learn from at most `max_labelled` labelled rows (those of the smallest id hash) outside the held-out remainder;
    four fifths give the counts, one fifth the calibration.  The model's units are all those that these rows bear out
    (three documents, `min_z` deviations) and what begins with them: the rows bound them, nothing else does."""
    lab = labels.select(labels[id_col].alias("id"), labels[label_col].alias("y")).filter("id is not null and y in (0, 1)").filter(id_remainder("id", modulus) != held_out)
    lab = lab.groupBy("id").agg(F.max("y").cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    rows = docs.select(docs[id_col].alias("id"), text_or_empty(text_col).alias("t")).join(F.broadcast(lab), "id")  # bounded by max_labelled
    fold = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5))
    counts = rows.filter(fold != 0).select("t", "y").mapInArrow(_count_units, "unit string, toxic bigint, clean bigint").groupBy("unit").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).filter("t + c >= 3")
    counts = materialize(counts, "toxic-counts")
    whole = counts.filter(F.col("unit").endswith(FULL)).agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    if not whole or not whole.t or not whole.c:
        discard(counts)
        return ToxicModel()
    rate = whole.t / (whole.t + whole.c)
    odds = math.log(rate / (1 - rate))
    # log-odds with a Dirichlet prior of the overall rate, over its standard deviation
    delta = F.log((F.col("t") + prior * rate) / (F.col("c") + prior * (1 - rate))) - F.lit(odds)
    z = delta / F.sqrt(1 / (F.col("t") + prior * rate) + 1 / (F.col("c") + prior * (1 - rate)))
    strong = counts.withColumn("z", z).filter(F.col("z") >= min_z).select("unit")
    model_rows = counts.join(strong, "unit")
    short = strong.filter(~F.col("unit").endswith(FULL)).withColumnRenamed("unit", "head")
    for n in PREFIXES:
        part = counts.filter(F.length("unit") > n).withColumn("head", F.substring("unit", 1, n))
        model_rows = model_rows.unionByName(part.join(short.filter(F.length("head") == n), "head").select("unit", "t", "c"))
    found = {r.unit: (r.t, r.c) for r in model_rows.distinct().orderBy(F.desc(F.col("t") + F.col("c")), "unit").collect()}  # units of max_labelled rows
    discard(counts)
    rates: dict[str, float] = {}

    def rate_of(unit: str) -> float:
        if unit not in rates:
            word = unit.removesuffix(FULL)
            above = [p for p in units(word) if len(p) < len(unit) and p in found]
            parent = rate_of(above[-1]) if above else rate
            t, c = found[unit]
            rates[unit] = (t + prior * parent) / (t + c + prior)
        return rates[unit]

    model = ToxicModel({u: math.log((r := rate_of(u)) / (1 - r)) - odds for u in found})
    held = rows.filter(fold == 0).select("t", "y").mapInArrow(_maxima(model), "y int, n bigint, best double, segments array<double>, low double, sums array<double>, times array<bigint>")
    cal = held.collect()  # bounded by max_labelled
    clean = [r for r in cal if r.y == 0]
    if clean and len(clean) < len(cal):
        model.lam = _lambda(clean, model.gap)
        xs = [model.lam * r.best - math.log(max(1, r.n)) for r in clean if r.best > 0]
        if len(xs) >= 20:
            model.k = float(np.clip(math.exp(np.mean(xs) - 0.5772), 1e-3, 1.0))
        feats = []
        for r in cal:
            floor = math.log1p(model.k * r.n)
            norm = [model.lam * s - floor for s in r.segments]
            feats.append((max(norm, default=-floor), math.log1p(sum(v for v in norm if v > 0))))
        model.curve = _fit_curve(np.array(feats), np.array([float(r.y) for r in cal]))
    return model


def _maxima(model: ToxicModel):
    """Per text: its label, length, best segment, all segments' scores, and the scores of its known tokens with how often
    each stands there."""

    def run(batches):
        known = _WordScores(model)
        for b in batches:
            out = []
            for t in b.column("t").to_pylist():
                w = words_of(t)
                s = np.fromiter(map(known.__getitem__, w), dtype=np.float64, count=len(w))
                seg = [x[2] for x in maximal_segments(s)]
                up, times = np.unique(s[s != model.gap], return_counts=True)
                out.append((len(w), max(seg, default=0.0), seg, float(len(w) - times.sum()), up.tolist(), times.tolist()))
            cols = list(zip(*out)) if out else [[]] * 6
            kinds = (pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("y"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["y", "n", "best", "segments", "low", "sums", "times"])

    return run


def _lambda(clean, gap: float) -> float:
    """The positive root of the mean of exp(lambda * score) = 1 over the tokens of clean text."""
    up, times = (np.array([v for r in clean for v in r[c]], dtype=np.float64) for c in ("sums", "times"))
    low = sum(r.low for r in clean)
    n = low + times.sum()
    f = lambda x: (low * math.exp(x * gap) + (times * np.exp(np.minimum(x * up, 500))).sum()) / n - 1
    if not len(up) or (low * gap + (times * up).sum()) >= 0:
        return 1.0
    lo, hi = 1e-6, 1.0
    while f(hi) < 0 and hi < 20:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return float(np.clip(hi, 0.05, 20))


def toxicity_column(model: ToxicModel, text):
    """struct<score double, passage_start int, passage_end int, passages int> of a text column."""

    @F.pandas_udf("score double, passage_start int, passage_end int, passages int")
    def score(texts: pd.Series) -> pd.DataFrame:
        enter("toxicity")
        return pd.DataFrame(text_scorer(model)(texts.tolist()), columns=["score", "passage_start", "passage_end", "passages"])

    return score.asNondeterministic()(text)


def score_documents(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, score (0 to 1), predicted, and the best passage's place in words.

    Null and empty texts are texts without words; very long ones are scanned in one pass; repeated rows have a row each; of
    passages of one score the first counts.  Columns other than id and text are ignored, whatever their names."""
    rows = docs.select(docs[id_col], toxicity_column(model, text_or_empty(text_col)).alias("x_"))
    return rows.select(id_col, "x_.score", (F.col("x_.score") >= 0.5).cast("int").alias("predicted"), "x_.passage_start", "x_.passage_end", "x_.passages")
