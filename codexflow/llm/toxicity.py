"""Toxicity by a weighted finite-state pattern grammar (operator 1).

Words of a text become symbols (insulting word, violent verb, intent, target, negation, reporting verb, quote mark, other),
and so do the ends of clauses and paragraphs. Five small transducers rewrite them in turn: insult and threat make hits of
words (a violent verb after an intent is a meant threat), negation marks hits inside its scope, reported speech marks
hits in quotation marks or after a reporting verb, and target tells at a clause's end whether it addressed somebody. Their
composition is one deterministic transducer that runs over whole paragraphs: a clause's end closes the scope of negation
and address, but not a quotation, and a reporting verb holds until its quotation closes.

A hit weighs as its word and by a factor for each mark: at most 1 for negation and for report, at least 1 for address. So a
negated or reported hit never weighs more than the plain one, and all labelled hits teach the same few numbers. A
document's score is a logistic function of the weights per kind of hit.

The insult arcs are seeds plus stems learned from labelled rows: prefixes and whole words whose frequency
in toxic rows is significant after correction for the number of candidates. How pure a stem must be is chosen on
a part of the labelled rows that its counts have not seen.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexflow.llm.common import Shared, by_value, labelled_sample, map_slices, written

by_value(__name__)

SEEDS = (
    "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown imbecile dumb dumbass "
    "bastard bitch asshole fool jerk vermin subhuman idiota estúpido imbécil basura idioten dumm abschaum trottel "
    "crétin abruti ordure connard").split()
THREATS = (
    "kill kills murder hurt shoot stab strangle burn destroy beat töten umbringen schlagen verprügeln tuer frapper "
    "égorger matar golpear destruir").split()
TARGETS = (
    "you your yours yourself u du dich dir dein deine euch ihr tu toi te vous votre vos usted ustedes tú ti vosotros").split()
INTENTS = "i we will shall gonna going must should ich wir werde werden je nous vais allons voy vamos debemos".split()
NEGATIONS = "not never no neither nor isn don doesn aren cannot without nicht kein keine nie pas jamais ni nunca jamás".split()
REPORTS = (
    "said says say told wrote writes quoted quote claimed called calls reported alleged according sagte sagt schrieb "
    "dit disait écrit dijo dice escribió").split()
MARKS = {'"': "Q", "“": "Qo", "„": "Qo", "«": "Qo", "”": "Qc", "»": "Qc", "\n": "P"} | dict.fromkeys(".!?;", "E")

WORD = re.compile(r"[^\W\d_]+|[.!?;\n\"“”„«»]")
SCOPE = 4
KINDS = ("I", "T", "M")  # insult, threat, meant threat
PATHS = [(kind, negated, reported, targeted) for kind in KINDS for negated in (0, 1) for reported in (0, 1) for targeted in (0, 1)]
# where labels say nothing: logistic weights (none, insult, threat, meant threat) and factors (negated, reported, targeted)
PRIOR = np.array([-4.0, 3.2, 0.6, 2.4])
FACTORS = (0.3, 0.4, 1.5)
FACTOR_GRID = ((0.1, 0.3, 0.6, 1.0), (0.1, 0.4, 0.7, 1.0), (1.0, 1.5, 2.5))
PURITIES = (2.0, 2.6, 3.2, 4.0)  # log-odds from which a stem may count


class Transducer:
    """Deterministic, one output per input; ``arcs[state, symbol] = (state, output)``, start state 0."""

    def __init__(self, arcs: dict, symbols: set):
        self.arcs, self.symbols = arcs, symbols

    def compose(self, after: Transducer) -> Transducer:
        number, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
        while todo:
            pair = todo.pop()
            for symbol in self.symbols:
                mine, middle = self.arcs[pair[0], symbol]
                theirs, out = after.arcs[pair[1], middle]
                if (mine, theirs) not in number:
                    number[mine, theirs] = len(number)
                    todo.append((mine, theirs))
                arcs[number[pair], symbol] = (number[mine, theirs], out)
        made = Transducer(arcs, self.symbols)
        made.parts = {n: p for p, n in number.items()}
        return made


WORDS = {"w", "i", "v", "F", "Y", "N", "S"}
ENDS = {"E", "P"}
SYMBOLS = WORDS | ENDS | {"Q", "Qo", "Qc"}
HITS = {k + n + r for k in KINDS for n in ("", "n") for r in ("", "r")}


def insult() -> Transducer:
    """An insulting word is a hit."""
    return Transducer({(0, s): (0, "I" if s == "i" else s) for s in SYMBOLS}, SYMBOLS)


def threat() -> Transducer:
    """A violent verb is a hit, a meant one after an intent in its clause."""
    arcs = {}
    for meant in (0, 1):
        for s in SYMBOLS | {"I"}:
            arcs[meant, s] = (0 if s in ENDS else int(meant or s == "F"), ("M" if meant else "T") if s == "v" else s)
    return Transducer(arcs, SYMBOLS | {"I"})


def negation() -> Transducer:
    """Hits up to ``SCOPE`` words after a negation are marked; marks of quotation do not count as words."""
    arcs, symbols = {}, (SYMBOLS - {"i", "v"}) | set(KINDS)
    for left in range(SCOPE + 1):
        for s in symbols:
            after = SCOPE if s == "N" else 0 if s in ENDS else left if s[0] == "Q" else max(0, left - 1)
            arcs[left, s] = (after, s + "n" if s in KINDS and left else s)
    return Transducer(arcs, symbols)


def reported_speech() -> Transducer:
    """States: 0 plain, 1 after a reporting verb, 2 in a quotation, 3 in one that a verb reports; all but 0 mark hits."""
    arcs, symbols = {}, (SYMBOLS - {"i", "v"}) | {h for h in HITS if not h.endswith("r")}
    for state in range(4):
        opened = 3 if state in (1, 3) else 2
        for s in symbols:
            after = {"Q": 0 if state > 1 else opened, "Qo": opened, "Qc": 0, "P": 0, "E": state if state > 1 else 0, "S": state if state > 1 else 1}.get(s, state)
            arcs[state, s] = (after, s + "r" if s in HITS and state else s)
    return Transducer(arcs, symbols)


def target() -> Transducer:
    """At a clause's end, whether somebody was addressed in it."""
    symbols = (SYMBOLS - {"i", "v"}) | HITS
    return Transducer({(state, s): (0 if s in ENDS else int(state or s == "Y"), s + "y" if s in ENDS and state else s) for state in (0, 1) for s in symbols}, symbols)


def grammar() -> Transducer:
    return insult().compose(threat()).compose(negation()).compose(reported_speech()).compose(target())


@dataclass
class Model:
    """Weighted stems (a trailing ``$`` closes a whole word), logistic weights per kind of hit, factors per mark."""

    insults: dict[str, float]
    weights: np.ndarray = field(default_factory=lambda: PRIOR)
    factors: tuple = FACTORS

    def ready(self) -> Model:
        if not hasattr(self, "finder"):
            self.arcs = grammar().arcs
            self.classes = dict.fromkeys(REPORTS, "S") | dict.fromkeys(NEGATIONS, "N") | dict.fromkeys(TARGETS, "Y") | dict.fromkeys(INTENTS, "F") | MARKS
            self.threats = set(THREATS)
            self.stem_sizes = sorted({len(s) for s in self.insults if not s.endswith("$")}, reverse=True)
            self.finder = ahocorasick.Automaton()
            for s in {*(s.rstrip("$") for s in self.insults), *THREATS}:
                self.finder.add_word(s, len(s))
            self.finder.make_automaton()
            self.path = {(k + "n" * n + "r" * r, t): i for i, (k, n, r, t) in enumerate(PATHS)}
        return self

    def insult(self, word: str) -> float:
        weight = self.insults.get(word + "$", 0.0)
        for size in self.stem_sizes:
            weight = max(weight, self.insults.get(word[:size], 0.0)) if len(word) >= size else weight
        return weight

    def paragraph(self, text: str, totals: np.ndarray) -> None:
        """Run the grammar over one paragraph; a clause's hits are weighed where it ends."""
        state, hits = 0, []
        for word in [*WORD.findall(text), "\n"]:
            weight = self.insult(word)
            symbol = "i" if weight else "v" if word in self.threats else self.classes.get(word, "w")
            state, out = self.arcs[state, symbol]
            if out[0] in KINDS:
                hits.append((out, weight or 3.0))
            elif out[0] in ENDS:
                for hit, own in hits:
                    totals[self.path[hit, int(out.endswith("y"))]] += own
                hits = []

    def totals(self, text: str) -> np.ndarray:
        """The weights of the hits on each path; only paragraphs with a word that may be a hit are run."""
        low, totals, done = text.lower(), np.zeros(len(PATHS)), 0
        for last, size in self.finder.iter(low):
            start = last - size + 1
            if start < done or (start and low[start - 1].isalpha()):
                continue
            begin = low.rfind("\n", done, start) + 1 or done
            end = low.find("\n", last)
            end = len(low) if end < 0 else end
            self.paragraph(low[begin:end], totals)
            done = end
        return totals

    def score(self, text: str) -> float:
        x = per_kind(self.totals(text)[None], self.factors)[0]
        return float(1 / (1 + math.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30))))


def per_kind(totals: np.ndarray, factors: tuple) -> np.ndarray:
    """(rows x kinds): hits weighed by the factors of their marks; sums count with their logarithm."""
    weigh = np.array([np.prod([f for f, has in zip(factors, marks) if has] or [1.0]) for _, *marks in PATHS])
    return np.log1p((totals * weigh).reshape(len(totals), len(KINDS), -1).sum(axis=2))


def significant_stems(sample: DataFrame, most: int = 2000) -> tuple[list[tuple[str, int, int]], int, int]:
    """([(stem, toxic rows, clean rows)], toxic, clean): prefixes of 3 to 8 letters and whole words that mark toxic rows, best first."""
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return [], toxic, clean
    words = (sample.select("label", F.explode(F.array_distinct(F.expr(r"regexp_extract_all(lower(text), '\\p{L}+', 0)"))).alias("word"))
             .groupBy("word").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")))
    stems = (words.select("pos", "neg", F.explode(F.concat(
        F.array(F.concat("word", F.lit("$"))),
        F.transform(F.expr("filter(array(3, 4, 5, 6, 7, 8), n -> n <= length(word))"), lambda k: F.substring("word", F.lit(1), k)))).alias("stem"))
        .groupBy("stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).filter("pos >= 3"))
    rate = toxic / (toxic + clean)
    part = lambda seen, share: F.when(seen > 0, seen * F.log(seen / ((F.col("pos") + F.col("neg")) * share))).otherwise(0.0)
    stems = stems.withColumn("gain", 2 * (part(F.col("pos"), rate) + part(F.col("neg"), 1 - rate))).filter(F.col("pos") > rate * (F.col("pos") + F.col("neg")))
    stems = written(stems, "stems")
    floor = 2 * math.log(max(stems.count(), 2)) + 6
    rows = stems.filter(F.col("gain") > floor).orderBy(F.desc("gain"), "stem").limit(most).collect()
    return [(r["stem"], r["pos"], r["neg"]) for r in sorted(rows, key=lambda r: (-r["gain"], -len(r["stem"]), r["stem"]))], toxic, clean


def choose(found: tuple, purity: float) -> dict[str, float]:
    """Of the significant stems those of at least this log-odds; a prefix that covers a chosen one, or is covered, adds nothing."""
    rows, toxic, clean = found
    odds, chosen = lambda p, q: math.log((p + 0.5) / (toxic + 1)) - math.log((q + 0.5) / (clean + 1)), {}
    for stem, p, q in rows:
        if odds(p, q) > purity and not any(stem.startswith(c) or c.startswith(stem) for c in chosen):
            chosen[stem] = min(8.0, odds(p, q))
    return chosen


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, steps: int = 50) -> np.ndarray:
    """Damped Newton steps to the most likely weights under a unit normal prior around ``prior``."""
    x = np.column_stack([np.ones(len(x)), x])
    strained = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + ((w - prior) ** 2).sum() / 2
    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        change = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.eye(len(w)), x.T @ (p - y) + (w - prior))
        size = 1.0
        while size > 1e-6 and strained(w - size * change) > strained(w):
            size /= 2
        w = w - size * change
        if np.abs(size * change).max() < 1e-8:
            break
    return w


def loss(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    z = w[0] + x @ w[1:]
    return float(np.logaddexp(0, z).sum() - y @ z)


def solve(totals: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, tuple]:
    """(weights, factors) of least loss; factors from a grid, held to the prior's where labels say nothing. Weights of hits are not negative."""
    best = (math.inf, PRIOR, FACTORS)
    for factors in itertools.product(*FACTOR_GRID):
        x = per_kind(totals, factors)
        w = logistic(x, y, PRIOR)
        w[1:] = np.maximum(w[1:], 0.0)
        strain = sum(math.log(f / f0) ** 2 for f, f0 in zip(factors, FACTORS))
        best = min(best, (loss(x, y, w) + ((w - PRIOR) ** 2).sum() / 2 + strain, w, factors), key=lambda b: b[0])
    return best[1], best[2]


def path_totals(sample: DataFrame, models: list[Model]):
    """(labels, [totals per row] per model) of the bounded sample."""
    shared = [Shared(sample.sparkSession, m) for m in models]

    def make():
        ready = [s.value.ready() for s in shared]
        return lambda rows: {"label": rows["label"], "x": [np.concatenate([m.totals(t) for m in ready]).tolist() for t in rows["text"]]}

    seen = map_slices(sample, make, "label int, x array<double>").toPandas()
    x = np.array(seen["x"].tolist(), dtype=float).reshape(len(seen), len(models), len(PATHS))
    return seen["label"].to_numpy(dtype=float), [x[:, i] for i in range(len(models))]


def fit(docs: DataFrame, marks: DataFrame, bound: int = 20_000, text_col: str = "text") -> Model:
    """Learn stems, path weights and factors from ``marks`` (doc_id, label); at most ``bound`` rows are used.

    The purity is chosen on a quarter of them, for stems counted in the others; then all count. Without labelled rows of
    both classes the seeds and the prior weights stand.
    """
    sample = written(labelled_sample(docs, marks, text_col, bound).withColumn("label", F.col("label").cast("int")).dropDuplicates(["text"]), "toxic-sample")
    seeds = {s + "$": 4.0 for s in SEEDS}
    last = F.pmod(F.xxhash64("text"), F.lit(4)) == 3
    found = significant_stems(sample.filter(~last))
    models = [Model(seeds | choose(found, p)) for p in PURITIES]
    kept, totals = path_totals(sample.withColumn("label", F.col("label") + 2 * last.cast("int")), models)
    seen, y = kept >= 2, kept % 2
    if len(np.unique(y)) < 2 or len(np.unique(y[~seen])) < 2:
        return Model(seeds)

    def missed(x):
        weights, factors = solve(x[~seen], y[~seen])
        return loss(per_kind(x[seen], factors), y[seen], weights)

    losses = [missed(x) for x in totals]
    purity = max(p for p, own in zip(PURITIES, losses) if own <= min(losses) + 1e-9)  # of equal ones the purest
    chosen = Model(seeds | choose(significant_stems(sample), purity))
    y, (totals,) = path_totals(sample, [chosen])
    return Model(chosen.insults, *solve(totals, y))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, score 0 to 1, predicted): every whole text; null and empty texts get the score of no hit.

    A map without a shuffle: repeated rows give repeated rows, other columns are not read.
    """
    shared = Shared(docs.sparkSession, model)

    def make():
        ready = shared.value.ready()
        return lambda rows: {"id": rows["id"], "score": [ready.score(t or "") for t in rows["text"]]}

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = map_slices(own, make, f"id {own.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below the threshold; a map without a shuffle.

    A row is judged by its own text: repeated rows and repeated or null ids are no special case.
    """
    shared = Shared(docs.sparkSession, model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.ready().score(t) for t in texts], dtype=float)

    return docs.filter(scored(F.coalesce(F.col(text_col), F.lit(""))) < threshold)
