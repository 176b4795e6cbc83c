"""Quality classifier: regularised quadratic discriminant over document statistics (operator 9).

A text becomes a vector of transformed statistics (length, repetition, case, symbols, lines,
compressibility). Each class has a mean and a covariance shrunk towards the pooled diagonal; the score is
the difference of the log densities, computed from Mahalanobis lengths with Cholesky factors that are
inverted once and kept, and calibrated by a two-parameter logistic curve.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexflow.llm.common import Shared, by_value, labelled_sample, map_slices
from codexflow.llm.toxicity import logistic

by_value(__name__)

FEATURES = (
    "chars words word_length unique_words top_word repeated_neighbours upper letters digits stops exclamations bars other_marks "
    "spaces lines line_length repeated_lines short_words marked_words compression").split()
UPPER, LOWER = np.arange(65, 91), np.arange(97, 123)
STOPS, OTHER = np.frombuffer(b".,;:", np.uint8), np.frombuffer(b"#$%&*@^~<>{}[]=+\\/_", np.uint8)


def statistics(text: str) -> list[float]:
    """The transformed statistics of one whole text; an empty text has a vector too."""
    data = text.encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    total = max(1, len(data))
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    seen = Counter(words)
    share = lambda k, of: float(np.log((k + 0.5) / (of - k + 0.5)))  # noqa: E731  a logit that never diverges
    upper, letters = int(count[UPPER].sum()), int(count[UPPER].sum() + count[LOWER].sum() + count[128:].sum())
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), float(np.log1p(sum(map(len, seen)) / max(1, len(seen)))),
        share(len(seen), n), share(max(seen.values(), default=0), n), share(sum(map(str.__eq__, words, words[1:])), n),
        share(upper, max(letters, upper)), share(letters, total), share(int(count[48:58].sum()), total), share(int(count[STOPS].sum()), total),
        share(int(count[33]), total), share(int(count[124]), total), share(int(count[OTHER].sum()), total), share(int(count[32]), total),
        float(np.log1p(len(lines))), float(np.log1p(len(text) / len(lines))), share(len(lines) - len(set(lines)), len(lines)),
        share(sum(k for w, k in seen.items() if len(w) < 4), n), share(sum(k for w, k in seen.items() if not w[-1:].isalpha()), n),
        float(np.log((len(zlib.compress(data, 1)) + 8) / (total + 8)))]


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray  # class 0, class 1
    factors: np.ndarray  # inverse Cholesky factors of the class covariances
    logdets: np.ndarray
    curve: np.ndarray  # intercept and slope of the calibration

    def differences(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        d = [-0.5 * (np.square((z - m) @ f.T).sum(axis=1) + ld) for m, f, ld in zip(self.means, self.factors, self.logdets)]
        return d[1] - d[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * squash(self.differences(x)), -30, 30)))


def squash(d: np.ndarray) -> np.ndarray:
    return np.sign(d) * np.log1p(np.abs(d))


def solve(x: np.ndarray, y: np.ndarray, shrink: float = 0.1) -> Model:
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - centre) / scale, -8, 8)
    pooled = np.mean([z[y == k].var(axis=0) for k in (0, 1)], axis=0) + 1e-3
    means, factors, logdets = [], [], []
    for k in (0, 1):
        own = z[y == k]
        spread = (own - own.mean(axis=0)).T @ (own - own.mean(axis=0)) / max(1, len(own))
        weight = max(shrink, z.shape[1] / (z.shape[1] + len(own)))
        factor = np.linalg.cholesky((1 - weight) * spread + weight * np.diag(pooled))
        means.append(own.mean(axis=0))
        factors.append(np.linalg.inv(factor))
        logdets.append(2 * np.log(np.diag(factor)).sum())
    model = Model(centre, scale, np.stack(means), np.stack(factors), np.array(logdets), np.array([0.0, 1.0]))
    model.curve = logistic(squash(model.differences(x))[:, None], y.astype(float), model.curve)
    return model


def fit(docs: DataFrame, marks: DataFrame, bound: int = 20_000, text_col: str = "text", shrink: float = 0.1) -> Model | None:
    """Learn from ``marks`` (doc_id, label), at most ``bound`` rows; None without rows of both classes."""
    sample = labelled_sample(docs, marks, text_col, bound).withColumn("label", F.col("label").cast("int"))
    seen = map_slices(sample, lambda: lambda rows: {"label": rows["label"], "x": list(map(statistics, rows["text"]))},
                      "label int, x array<double>").toPandas()
    if seen["label"].nunique() < 2:
        return None
    return solve(np.stack(seen["x"].to_numpy()), seen["label"].to_numpy(), shrink)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, score 0 to 1, predicted): every whole text, null as empty. Without a model every score is 0.5.

    A map without a shuffle: repeated rows give repeated rows, other columns are not read.
    """
    shared = Shared(docs.sparkSession, model)

    def work(rows):
        if shared.value is None:
            return {"id": rows["id"], "score": [0.5] * len(rows["id"])}
        x = np.array([statistics(t or "") for t in rows["text"]]).reshape(-1, len(FEATURES))
        return {"id": rows["id"], "score": shared.value.scores(x).tolist()}

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = map_slices(own, lambda: work, f"id {own.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model | None, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at or above the threshold; a map without a shuffle.

    A row is judged by its own text: repeated rows and repeated or null ids are no special case.
    """
    shared = Shared(docs.sparkSession, model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([0.5] * len(texts) if shared.value is None else
                            shared.value.scores(np.array([statistics(t) for t in texts]).reshape(-1, len(FEATURES))), dtype=float)

    return docs.filter(scored(F.coalesce(F.col(text_col), F.lit(""))) >= threshold)
