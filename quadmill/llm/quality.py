"""Quality by a sparse ensemble of rules (RuleFit, Friedman and Popescu 2008).

Statistics of the whole text feed shallow trees grown on bootstrap samples; every path from a root is a
conjunctive rule; a lasso logistic regression gives the rules weights, most of them zero. What is left is
compiled into one Spark column expression over the statistics.

Fitting uses at most about SAMPLE labelled rows, picked by hash of their id at a rate that follows from
their count; trees and weights are then made on the driver from SAMPLE x len(STATISTICS) numbers.
Defined results: null and empty texts have zero statistics and a score like any other; labels that are
null or conflict are averaged over the rows of an id and rounded; with one class alone in the sample the
score is that class; repeated rows get equal answers; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SAMPLE, TREES, DEPTH, BINS = 10_000, 40, 3, 32
PENALTIES = (0.01, 0.003, 0.001, 0.0003)
SIGNS = "|!#%&*$@<>.,;:?"
STATISTICS = (
    "log_bytes", "log_words", "upper", "digit", "space", "line_ends", "punctuation", "not_ascii", "word_bytes",
    "distinct_words", "top_word", "distinct_lines", "words_a_line", "longest_word", "ends_in_letter", "all_caps_words", "signs",
    *(f"sign_{ord(c)}" for c in SIGNS),
)


def statistics(text: bytes) -> list[float]:
    n = max(1, len(text))
    by = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256) / n
    words = text.split()
    w = max(1, len(words))
    counts = Counter(words)
    lines = text.split(b"\n")
    caps = sum(k for x, k in counts.items() if x.isupper() and len(x) > 1)
    ends = sum(k for x, k in counts.items() if not 33 <= x[-1] < 48 and x[-1] not in b":;<=>?@[]^_{|}~")
    punctuation = by[33:48].sum() + by[58:65].sum() + by[91:97].sum() + by[123:127].sum()
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), by[65:91].sum(), by[48:58].sum(), by[32], by[10], punctuation, by[128:].sum(), (len(text) - len(lines) - w + 2) / w,
        len(counts) / w, max(counts.values(), default=0) / w, len(set(lines)) / len(lines), w / len(lines), float(max(map(len, counts), default=0)), ends / w, caps / w, punctuation - by[46] - by[44],
        *(by[ord(c)] for c in SIGNS),
    ]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([statistics(x.as_py() or b"") for x in batch.column(1)], dtype=np.float64).reshape(-1, len(STATISTICS))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, i]) for i in range(len(STATISTICS)))], names=["doc_id", *STATISTICS])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of the whole text, a row for each row of docs."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(_measured, "doc_id long, " + ", ".join(f"{c} double" for c in STATISTICS))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above the threshold, threshold), in order


@dataclass
class Model:
    rules: list[Rule]
    weights: list[float]
    base: float

    def score(self) -> Column:
        """The compiled rules: a column over the statistics."""
        total = F.lit(self.base)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for i, above, threshold in rule:
                holds &= (F.col(STATISTICS[i]) > threshold) if above else (F.col(STATISTICS[i]) <= threshold)
            total += F.when(holds, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, edges: list[np.ndarray], rng: np.random.Generator) -> list[Rule]:
    """The paths of one tree; x: bin numbers. Each node tries a random third of the statistics."""
    found: list[Rule] = []

    def split(at: np.ndarray, path: Rule) -> None:
        if path:
            found.append(path)
        n, ones = len(at), y[at].sum()
        if len(path) >= DEPTH or n < 40 or ones in (0, n):
            return
        best = (1e-9, 0, 0)
        for i in rng.choice(x.shape[1], size=max(4, x.shape[1] // 3), replace=False):
            size = np.bincount(x[at, i], minlength=BINS + 1).cumsum()[:-1]
            good = np.bincount(x[at, i], weights=y[at], minlength=BINS + 1).cumsum()[:-1]
            rest = n - size
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.nan_to_num(good**2 / size) + np.nan_to_num((ones - good) ** 2 / rest) - ones**2 / n
            gain[(size < 10) | (rest < 10)] = 0
            b = int(gain.argmax())
            if gain[b] > best[0] and b < len(edges[i]):
                best = (gain[b], int(i), b)
        if best[0] <= 1e-9:
            return
        _, i, b = best
        low = x[at, i] <= b
        split(at[low], (*path, (i, False, float(edges[i][b]))))
        split(at[~low], (*path, (i, True, float(edges[i][b]))))

    split(rng.integers(0, len(y), size=len(y)), ())
    return found


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)), dtype=np.float32)
    for r, rule in enumerate(rules):
        for i, above, threshold in rule:
            out[:, r] *= (x[:, i] > threshold) == above
    return out


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, start: tuple[np.ndarray, float], steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradients."""
    n = len(y)
    x, y, start = x.astype(np.float32), y.astype(np.float32), (start[0].astype(np.float32), np.float32(start[1]))
    scale = x.std(axis=0) + np.float32(1e-3)
    z = x / scale
    v = np.ones(z.shape[1], dtype=np.float32)
    for _ in range(12):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v) + 1e-12
    rate = np.float32(1 / (0.25 * float(np.linalg.norm(z @ v)) ** 2 / n + 0.25))
    w, b = start[0] * scale, start[1]
    u, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        miss = 1 / (1 + np.exp(-(z @ u + c))) - y
        new = u - rate * (z.T @ miss) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * np.float32(penalty), 0)
        base = c - rate * miss.mean()
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = np.float32((t - 1) / after)
        u, c = new + ahead * (new - w), base + ahead * (base - b)
        w, b, t = new, base, after
    return (w / scale).astype(np.float64), float(b)


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    if not len(y) or y.min() == y.max():
        return Model([], [], 0.0 if not len(y) else 20.0 if y[0] else -20.0)
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1)
    rules = sorted({r for _ in range(TREES) for r in grow(binned, y, edges, rng)})
    apart = rng.random(len(y)) < 0.2
    if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
        apart[:] = False
    z = holds(rules, x)
    test = apart if apart.any() else ~apart
    state, best = (np.zeros(len(rules)), 0.0), (np.inf, PENALTIES[-1])
    for penalty in PENALTIES:
        state = lasso(z[~apart], y[~apart], penalty, state)
        p = np.clip(1 / (1 + np.exp(-(z[test] @ state[0] + state[1]))), 1e-6, 1 - 1e-6)
        best = min(best, (-float(np.mean(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p))), penalty))
    w, b = lasso(z, y, best[1], state, 600)
    kept = np.flatnonzero(np.abs(w) > 1e-4)
    return Model([rules[i] for i in kept], [float(w[i]) for i in kept], float(b))


def fit(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, sample: int = SAMPLE) -> Model:
    """A model of ``label`` (0 or 1) from the labelled rows where learnable holds."""
    rows = labels.where(learnable & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.round(F.avg(label)).cast("int").alias("y"))
    n = rows.count()
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
    picked = rows.where(place < int(min(1.0, sample / max(1, n)) * (1 << 30)))  # about sample rows, 16 bytes each
    data = measure(docs.where(F.col("doc_id").isNotNull()).join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi")).dropDuplicates(["doc_id"]).join(F.broadcast(picked), "doc_id").orderBy("doc_id").drop("doc_id").toPandas()
    return fit_rules(data[list(STATISTICS)].to_numpy(np.float64), data["y"].to_numpy(np.float64))


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted: a row for each row of docs."""
    return measure(docs).select("doc_id", model.score().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
