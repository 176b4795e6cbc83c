"""Secret scan with one combined deterministic automaton (operator 5).

Every rule has a trigger, a regular expression that occurs wherever the rule can match. All triggers are
compiled by subset construction and minimisation into one transition array, and every text byte passes
through it once. Texts of a batch are joined and cut into lanes that advance in lockstep, a NumPy gather
per step; lanes begin after byte pairs that lead every state to the same one, so nothing is lost at a cut.
Where a trigger fires, the rule's own automata give the exact span: backwards to the leftmost start,
forwards to the longest end.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexflow.llm.automaton import Automaton, mirrored, parse
from codexflow.llm.common import Shared, by_value, map_slices

by_value(__name__)

LANES = 2048


@dataclass(frozen=True)
class Rule:
    """A match is ``head`` then ``body``, greedy; it counts if the body has ``least`` bytes or more.

    Triggers end with the first byte of the body: counting a long body from every possible head at once
    would multiply the states.
    """

    kind: str
    head: str
    body: str
    least: int
    trigger: str
    any_case: bool = False


# fixed values: the first three rules are given, the others are public token formats
ASSIGN_HEAD = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
RULES = [
    Rule("assign", ASSIGN_HEAD, r"[A-Za-z0-9+/_.=-]+", 12, ASSIGN_HEAD + r"[A-Za-z0-9+/_.=-]", any_case=True),
    Rule("access", r"AKIA", r"[A-Z0-9]+", 14, r"AKIA[A-Z0-9]"),
    Rule("hex", r"", r"[0-9a-f]+", 16, r"[0-9a-f]{16}"),
    Rule("github", r"gh[pousr]_", r"[A-Za-z0-9]+", 36, r"gh[pousr]_[A-Za-z0-9]"),
    Rule("slack", r"xox[abprs]-", r"[A-Za-z0-9-]+", 10, r"xox[abprs]-[A-Za-z0-9-]"),
    Rule("google", r"AIza", r"[A-Za-z0-9_-]+", 35, r"AIza[A-Za-z0-9_-]"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", r"[A-Za-z0-9_-]+", 16, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]"),
    Rule("pem", r"-----BEGIN\x20", r"([A-Z0-9]+\x20)*PRIVATE\x20KEY-----", 16, r"-----BEGIN\x20([A-Z0-9]+\x20)*PRIVATE\x20KEY-----"),
]
BASE = ("assign", "access", "hex")


class Scanner:
    def __init__(self, rules: list[Rule]):
        self.rules = rules
        trees = [parse(r.trigger, r.any_case) for r in rules]
        self.all = Automaton(trees, search=True)
        self.back = [Automaton([mirrored(t)], search=False) for t in trees]
        self.head = [Automaton([parse(r.head, r.any_case)], search=False) for r in rules]
        self.full = [Automaton([parse(r.head + r.body, r.any_case)], search=False) for r in rules]
        c = self.all.classes
        step = self.all.step.reshape(-1, c) // c
        after = step[step].transpose(1, 2, 0)  # [first byte class, second, state] -> state
        self.synced = (after == after[:, :, :1]).all(axis=2).reshape(-1)
        self.synced_state = (after[:, :, 0] * c).astype(np.int32).reshape(-1)
        gap = step[:, self.all.byte_class[10]]
        assert (gap == self.all.start).all(), "a line break must end every rule: it separates texts"

    def events(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, rule masks): the bytes at which a trigger is complete."""
        auto, kinds = self.all, self.all.byte_class[data]
        n, c = len(data), self.all.classes
        pairs = kinds[:-1].astype(np.int32) * c + kinds[1:]
        ready = np.flatnonzero(self.synced[pairs]) + 2  # a lane may begin here
        wanted = np.arange(1, LANES) * n // LANES
        at = np.searchsorted(ready, wanted)
        begins = np.unique(ready[at[at < len(ready)]])
        begins = begins[begins < n]
        states = np.concatenate([[auto.start * c], self.synced_state[pairs[begins - 2]]]).astype(np.int32)
        begins = np.concatenate([[0], begins])
        lengths = np.diff(np.append(begins, n))
        order = np.argsort(-lengths, kind="stable")
        begins, lengths, states = begins[order], lengths[order], states[order]
        active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right") if n else []
        border, step, where, masks = auto.first_accepting * c, auto.step, [], []
        accepts = np.array(auto.accepts)
        for t, k in enumerate(active):
            states = step[states[:k] + kinds[begins[:k] + t]]
            hit = states >= border
            if hit.any():
                lanes = np.flatnonzero(hit)
                where.append(begins[lanes] + t)
                masks.append(accepts[states[lanes] // c])
        if not where:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        where, masks = np.concatenate(where), np.concatenate(masks)
        order = np.argsort(where, kind="stable")
        return where[order], masks[order]

    def spans(self, text: bytes, r: int, ends: list[int]) -> list[tuple[int, int]]:
        """Leftmost non-overlapping matches of rule ``r`` whose triggers end at ``ends``; short bodies use up their text."""
        out, resume = [], 0
        for end in ends:
            if end < resume:
                continue
            start = self.back[r].run(text, range(end, resume - 1, -1))
            if start < 0:
                continue
            last = self.full[r].run(text, range(start, len(text)))
            if last < 0:
                continue
            body = max(start, self.head[r].run(text, range(start, last + 1)) + 1) if self.rules[r].head else start
            if last + 1 - body >= self.rules[r].least:
                out.append((start, last + 1))
            resume = last + 1
        return out

    def scan(self, texts: list[str]) -> list[list[tuple[int, str, int]]]:
        """Per text: (start, kind, end) in code points, by start, then in the order of the rules."""
        coded = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n".join(coded) + b"\n", dtype=np.uint8)
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in coded])])
        where, masks = self.events(data)
        owner = np.searchsorted(begins, where, side="right") - 1
        out: list = [[] for _ in texts]
        for doc in np.unique(owner):
            mine = owner == doc if len(owner) < 64 else slice(*np.searchsorted(owner, [doc, doc + 1]))
            at, mask, text = where[mine] - begins[doc], masks[mine], coded[doc]
            found = [(s, r, e) for r in range(len(self.rules)) if (mask >> r & 1).any()
                     for s, e in self.spans(text, r, at[(mask >> r & 1) == 1].tolist())]
            if found:
                starts_char = np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)
                char = lambda b: int(starts_char[b - 1]) if b else 0
                out[doc] = [(char(s), self.rules[r].kind, char(e)) for s, r, e in sorted(found)]
        return out


class Rules:
    """The compiled rules; a Python worker compiles them once."""

    def __init__(self, rules: list[Rule]):
        self.rules, self.scanner = rules, None

    def ready(self) -> Scanner:
        if self.scanner is None:
            self.scanner = Scanner(self.rules)
        return self.scanner


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, found array<struct<start, kind, end>>): secrets of every whole text; a map without a shuffle.

    Offsets count code points, ends are exclusive. Null and empty texts give an empty array, repeated rows
    repeated rows; other columns are not read.
    """
    shared = Shared(docs.sparkSession, Rules(rules or RULES))

    def make():
        scanner = shared.value.ready()

        def work(rows):
            found = scanner.scan([t or "" for t in rows["text"]])
            return {"id": rows["id"], "found": [[{"start": s, "kind": k, "end": e} for s, k, e in spans] for spans in found]}

        return work

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    out = map_slices(own, make, f"id {kind}, found array<struct<start:long,kind:string,end:long>>")
    return out.withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as one string."""
    text = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(id_col, *map(count, BASE), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))
