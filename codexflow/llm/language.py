"""Language identification by string kernels (operator 6).

Two texts are compared by the character n-grams of orders 1 to 4 they share (blended spectrum, presence
only), normalised by the numbers they hold. A bounded set of labelled landmark texts spans a Nyström
approximation of that kernel; one-versus-rest kernel ridge regression on it gives one weight per landmark
and language. A batch is scored by two matrix products: n-gram presence times landmarks, kernel times
weights.

Texts are read whole. N-grams go to ``SLOTS`` places; a text of megabytes over a rich vocabulary fills most of them, and
the more it fills, the less presence tells languages apart (tested with several megabytes of each language).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexflow.llm.common import Shared, by_value, map_slices

by_value(__name__)

ORDERS = (1, 2, 3, 4)
SLOTS = 1 << 14  # n-grams are hashed to this many places
LETTER = re.compile(r"[^\W\d_]")
ROWS = 256
UNKNOWN = "und"


def presence(text: str, out: np.ndarray) -> None:
    """Set the places of the text's n-grams. Letters in lower case; everything else counts as one gap."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    plain = (codes >= 97) & (codes <= 122) | (codes >= 0xC0)
    codes[~plain] = 32
    gap = codes == 32
    if len(codes) > 1:
        codes = codes[~(gap & np.append(False, gap[:-1]))]  # runs of gaps shrink to one
    h = np.zeros(len(codes), dtype=np.uint64)
    for order in ORDERS:
        if len(codes) < order:
            break
        h = h[:len(codes) - order + 1] * np.uint64(0x100000001B3) + codes[order - 1:] + np.uint64(order)
        out[(h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 14)] = 1


def batch_presence(texts: list[str]) -> np.ndarray:
    x = np.zeros((len(texts), SLOTS), dtype=np.float32)
    for row, text in zip(x, texts):
        presence(text, row)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # places x landmarks, normalised
    weights: np.ndarray  # landmarks x languages

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for lo in range(0, len(texts), ROWS):
            part = [t or "" for t in texts[lo:lo + ROWS]]
            values = batch_presence(part) @ self.landmarks @ self.weights
            odds = np.exp(np.clip(8 * (values - values.max(axis=1, keepdims=True)), -50, 0))
            odds /= odds.sum(axis=1, keepdims=True)
            for text, best, row in zip(part, values.argmax(axis=1), odds):
                known = LETTER.search(text) is not None
                names.append(self.languages[best] if known else UNKNOWN)
                scores.append(float(row[best]) if known else 0.0)
        return names, scores


def unpacked(bits: list[bytes]) -> np.ndarray:
    x = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1).astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def solve(bits: list[bytes], languages: list[str], landmarks: int, ridge: float) -> Model:
    """Nyström kernel ridge regression; the first texts of each language, in turn, are the landmarks.

    ``bits`` holds one packed presence vector per text; few are unpacked at a time.
    """
    names = sorted(set(languages))
    turn, order = dict.fromkeys(names, 0), []
    for i, lang in enumerate(languages):
        order.append((turn[lang], i))
        turn[lang] += 1
    marks = unpacked([bits[i] for _, i in sorted(order)[:landmarks]])
    cross = np.concatenate([unpacked(bits[lo:lo + ROWS]) @ marks.T for lo in range(0, len(bits), ROWS)]).astype(np.float64)
    own = (marks @ marks.T).astype(np.float64)
    y = np.array([[1.0 if lang == name else -1.0 for name in names] for lang in languages])
    balance = np.sqrt(np.array([len(languages) / turn[lang] for lang in languages]) / len(names))[:, None]  # every language weighs alike
    normal = (cross * balance).T @ (cross * balance) + ridge * len(languages) * own + 1e-8 * len(languages) * np.eye(len(marks))
    weights = np.linalg.solve(normal, (cross * balance).T @ (y * balance))
    return Model(names, np.ascontiguousarray(marks.T), weights.astype(np.float32))


def fit(docs: DataFrame, bound: int = 8_000, landmarks: int = 256, ridge: float = 1e-4, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> Model | None:
    """Learn from rows with text, a letter in it and a language.

    At most ``bound`` rows are used, the same number for each language at most, drawn by a hash of the id;
    the driver gets one bit per n-gram place and row. None if there is no such row.
    """
    known = (docs.filter(F.col(text_col).rlike(r"\p{L}") & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
             .select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # the labels themselves
    if not counts:
        return None
    each = max(1, bound // len(counts))
    # a draw by hash leaves about half more than wanted of each language, whose place decides
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, 1.5 * each / n))])
    few = known.select("id", "lang").filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    drawn = few.select("id", "lang", place.alias("place")).filter(F.col("place") <= each)
    sample = known.select("id", "text").join(F.broadcast(drawn.dropDuplicates(["id"])), "id").dropDuplicates(["id"])

    def work(rows):
        bits = [np.zeros(SLOTS, dtype=np.float32) for _ in rows["text"]]
        for text, row in zip(rows["text"], bits):
            presence(text, row)
        return {"place": rows["place"], "lang": rows["lang"], "bits": [np.packbits(b > 0).tobytes() for b in bits]}

    seen = map_slices(sample, lambda: work, "place int, lang string, bits binary").toPandas().sort_values(["place", "lang"])
    return solve(seen["bits"].tolist(), seen["lang"].tolist(), landmarks, ridge)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score 0 to 1): every whole text; ``und`` with score 0 for null texts and texts without a letter.

    Without a model everything is ``und``. A map without a shuffle: repeated rows give repeated rows, other
    columns are not read.
    """
    shared = Shared(docs.sparkSession, model)

    def work(rows):
        if shared.value is None:
            return {"id": rows["id"], "lang_pred": [UNKNOWN] * len(rows["id"]), "score": [0.0] * len(rows["id"])}
        names, scores = shared.value.predict(rows["text"])
        return {"id": rows["id"], "lang_pred": names, "score": scores}

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = map_slices(own, lambda: work, f"id {own.schema['id'].dataType.simpleString()}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
