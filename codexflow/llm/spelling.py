"""Spelling variant grouping by a bit-sliced position index (operator 11).

Words that differ by one inserted, deleted or replaced code point agree in their first or in their last half,
so they meet in a bucket of that half; only the rests are left to compare. There, a bitset per (position,
letter) tells which words hold that letter at that position. For a query's rest, recurrences over its letters
update four bitsets, 64 words at a time: words without an error so far, and words with one replaced letter, one
letter less or one letter more, whose letters are looked up at the same, the previous or the next position.

Rows of a bucket are ordered by falling count, so the lowest bit of a result is the most frequent near word and
its bits count the near words: a query gives one row per cell, never its pairs.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexflow.llm.common import by_value, map_slices, written

by_value(__name__)

LETTERS = 91  # of the index: none, a to z, U+00C0 to U+00FF
SPAN = 32  # positions indexed at once
SLAB_ROWS, SLAB_BYTES = 1 << 16, 16 << 20
WORK_ROWS = 1 << 19
HELD_WORDS = 400_000  # distinct words a task counts before it hands them on

PLACE = np.zeros(256, dtype=np.uint8)
PLACE[97:123] = np.arange(1, 27)
PLACE[192:256] = np.arange(27, 91)


def text_words(doc_id, text: str, shortest: int, every: int) -> Counter:
    """Counts of a text's words: runs of letters, A-Z in lower case, a code point missing where the crc32 says so."""
    found: Counter = Counter()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    data = text.encode("latin-1", "replace").lower()  # bytes.lower() changes A-Z only
    for run, n in Counter(re.findall(rb"[a-z\xc0-\xff]{%d,}" % shortest, data)).items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < shortest:
                continue
        found[run] += n
    return found


def count_words(docs: DataFrame, shortest: int = 6, every: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): occurrences of each word over all texts, counted in the tasks first."""
    own = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter("text is not null")

    def make():
        def work(rows):
            held: Counter = Counter()
            words, counts = [], []
            for doc_id, text in zip(rows["id"], rows["text"]):
                held.update(text_words(doc_id, text, shortest, every))
                if len(held) > HELD_WORDS:
                    words += [w.decode("latin-1") for w in held]
                    counts += held.values()
                    held.clear()
            words += [w.decode("latin-1") for w in held]
            return {"word": words, "n": [*counts, *held.values()]}

        return work

    return map_slices(own, make, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Index:
    """Bitsets per (position, letter) over rows of one half length; row r is bit r % 64 of lane r // 64."""

    def __init__(self, rests: list[str], half: int):
        self.half, self.lengths = half, np.array([len(r) for r in rests])
        width = int(self.lengths.max())
        letters = np.frombuffer("".join(r.ljust(width, "\0") for r in rests).encode("latin-1"), dtype=np.uint8)
        self.codes = PLACE[letters].reshape(len(rests), width)
        self.lane = np.arange(len(rests)) // 64
        self.bit = np.uint64(1) << (np.arange(len(rests)) % 64).astype(np.uint64)
        self.lanes, self.base, self.sets = int(self.lane[-1]) + 1, -1, None

    def window(self, base: int) -> np.ndarray:
        """The bitsets of positions ``base`` to ``base + SPAN + 1``, as one flat array."""
        if self.base != base:
            part = self.codes[:, base:base + SPAN + 2]
            self.base, self.sets = base, np.zeros(self.lanes * (SPAN + 2) * LETTERS, dtype=np.uint64)
            at = (self.lane[:, None] * (SPAN + 2) + np.arange(part.shape[1])) * LETTERS + part
            np.bitwise_or.at(self.sets, at.ravel(), np.repeat(self.bit, part.shape[1]))
        return self.sets

    def of_length(self, length: int) -> np.ndarray:
        sets, rows = np.zeros(self.lanes, dtype=np.uint64), np.flatnonzero(self.lengths == length)
        np.bitwise_or.at(sets, self.lane[rows], self.bit[rows])
        return sets

    def near(self, queries: np.ndarray, lo: np.ndarray, hi: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, first row) of the rows ``lo`` to ``hi`` with exactly one error, per query row; all queries of one length."""
        m, half = int(self.lengths[queries[0]]), self.half
        lanes = (hi - 1) // 64 - lo // 64 + 1
        own = np.repeat(np.arange(len(queries)), lanes)
        lane = np.arange(len(own)) - np.repeat(np.cumsum(lanes) - lanes, lanes) + (lo // 64)[own]
        ones = np.uint64(2 ** 64 - 1)
        zero = ((ones << np.maximum(lo[own] - lane * 64, 0).astype(np.uint64))
                & (ones >> np.maximum((lane + 1) * 64 - hi[own], 0).astype(np.uint64)))
        replaced, less, more, agree = np.zeros_like(zero), np.zeros_like(zero), zero, zero
        for i in range(m):
            base = max(i // SPAN * SPAN - 1, 0)
            sets = self.window(base)
            spot = (lane * (SPAN + 2) + (i - base)) * LETTERS + self.codes[queries, i][own]
            here = sets[spot]
            less = (less & sets[spot - LETTERS] | zero) if i else zero
            replaced = replaced & here | zero & ~here
            zero = zero & here
            more = more & sets[spot + LETTERS] | zero
            if i + 1 == half:
                agree = zero
        found = np.zeros_like(zero)
        if (half + m - 1) // 2 == half:  # a pair belongs to the buckets of half its shorter word
            found |= less & self.of_length(m - 1)[lane]
        if (half + m) // 2 == half:
            found |= replaced & self.of_length(m)[lane] | more & self.of_length(m + 1)[lane]
        found &= ~np.where(suffix[own], agree, np.uint64(0))  # words that also agree in the first half meet in its bucket
        count, first = np.zeros(len(queries), dtype=np.int64), np.full(len(queries), len(self.lane))
        hit = np.flatnonzero(found)
        np.add.at(count, own[hit], np.bitwise_count(found[hit]).astype(np.int64))
        np.minimum.at(first, own[hit], lane[hit] * 64 + np.bitwise_count((found[hit] & -found[hit]) - np.uint64(1)).astype(np.int64))
        return count, first


def near_of_half(half: int, cell: np.ndarray, suffix: np.ndarray, sides: np.ndarray, rests: list[str]):
    """Yield (rows, counts, first near rows) over rows of one half length, sorted by (cell, side).

    ``sides``: 0 where a cell is one block, else 1 or 2; rows of one block are compared with those of the other.
    """
    index, key = Index(rests, half), cell * 3 + sides
    sought = cell * 3 + np.array([0, 2, 1])[sides]
    lo, hi = np.searchsorted(key, sought), np.searchsorted(key, sought, "right")
    for m in np.unique(index.lengths).tolist():
        rows = np.flatnonzero((index.lengths == m) & (hi - lo > (sides == 0)))
        work = np.cumsum((hi[rows] - lo[rows]) // 64 + 2)
        for part in np.split(rows, np.flatnonzero(np.diff(work // WORK_ROWS)) + 1):
            if len(part):
                count, first = index.near(part, lo[part], hi[part], suffix[part])
                yield part[count > 0], count[count > 0], first[count > 0]


def compare(batches):
    """Rows sorted by ``ORDER`` in; (word, n_near, near_n, near) out, one row per word and cell with near words."""
    held: dict[str, list] = {}

    def close(rows):
        half = np.array(rows["half"])
        low, high, block = (np.array(rows[c]) for c in ("low", "high", "block"))
        suffix = np.array(rows["suffix"], dtype=bool)
        change = np.r_[True, (np.diff(low) != 0) | (np.diff(high) != 0) | (np.diff(half) != 0) | (np.diff(suffix) != 0)
                       | np.fromiter((a != b for a, b in zip(rows["key"], rows["key"][1:])), dtype=bool, count=len(half) - 1)]
        cell, sides = np.cumsum(change), np.where(low == high, 0, np.where(block == low, 1, 2))
        for h in np.unique(half).tolist():
            lo, hi = np.searchsorted(half, h), np.searchsorted(half, h, "right")
            words, counts = rows["word"][lo:hi], rows["n"][lo:hi]
            for own, count, first in near_of_half(h, cell[lo:hi], suffix[lo:hi], sides[lo:hi], rows["rest"][lo:hi]):
                first = first.tolist()
                yield pa.RecordBatch.from_pydict(
                    {"word": [words[i] for i in own.tolist()], "n_near": count.tolist(),
                     "near_n": [counts[i] for i in first], "near": [words[i] for i in first]}, schema=FOUND)

    size = 0
    for batch in batches:
        rows = batch.to_pydict()
        # a slab ends where a cell ends
        keys = list(zip(rows["half"], rows["suffix"], rows["key"], rows["low"], rows["high"]))
        start = 0
        for i, key in enumerate(keys):
            last = keys[i - 1] if i else held and tuple(held[c][-1] for c in ("half", "suffix", "key", "low", "high"))
            if size > SLAB_BYTES or len(held.get("word", ())) + i - start >= SLAB_ROWS:
                if key != last:
                    for c, values in rows.items():
                        held.setdefault(c, []).extend(values[start:i])
                    yield from close(held)
                    held, start, size = {}, i, 0
            size += len(rows["rest"][i])
        for c, values in rows.items():
            held.setdefault(c, []).extend(values[start:])
    if held and held["word"]:
        yield from close(held)


FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())])
CELL = ["half", "suffix", "key", "low", "high"]


def near_words(vocabulary: DataFrame, cell: int = 1 << 14) -> DataFrame:
    """(word, n_near, near_n, near) for the words of ``vocabulary`` (word, n; no repeats) that differ from another in one code point.

    ``near`` is the near word of largest count, ``near_n`` its count; ties go to the smaller word. Buckets of more
    than ``cell`` words are compared in cells of two blocks each.
    """
    length = F.length("word")
    halves = F.array_distinct(F.array(F.floor(length / 2).cast("int"), F.floor((length - 1) / 2).cast("int")))
    halved = vocabulary.select("word", "n", F.explode(halves).alias("half"))
    first = halved.select("half", F.lit(False).alias("suffix"), F.expr("left(word, half)").alias("key"), F.expr("substring(word, half + 1)").alias("rest"), "word", "n")
    last = halved.select("half", F.lit(True).alias("suffix"), F.expr("right(word, half)").alias("key"), F.expr("left(word, length(word) - half)").alias("rest"), "word", "n")
    member = first.unionByName(last)
    # at most members / cell buckets are larger than a cell; Spark decides how to join them
    large = member.groupBy("suffix", "key").agg(F.count("*").alias("members")).filter(F.col("members") > cell)
    large = written(large.select("suffix", "key", F.ceil(F.col("members") / cell).cast("int").alias("blocks")), "large-buckets")
    dealt = (member.join(large, ["suffix", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
             .withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
             .select("half", "suffix", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rest", "word", "n"))
    sorted_cells = dealt.repartition(*CELL).sortWithinPartitions(*CELL, "block", F.desc("n"), "word")
    found = sorted_cells.mapInArrow(compare, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
            .select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near")))


def variants(docs: DataFrame, shortest: int = 6, least: int = 5, ratio: int = 5, every: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of all texts with their more frequent spellings.

    Words are runs of letters with at least ``shortest`` code points and ``least`` occurrences. ``form`` is the
    near word of largest count if that is ``ratio`` times the word's own, ``root`` the last of the forms that
    follow from it. Null and empty texts have no words; a row with a null id counts under an empty id; repeated
    rows count again; very long texts and runs are read whole; an empty table gives no word; other columns are not read.
    """
    if shortest < 6:
        raise ValueError("words of six code points at least have two halves of three that one error cannot both touch")
    vocabulary = written(count_words(docs, shortest, every, id_col, text_col).filter(F.col("n") >= least), "words")
    met = written(near_words(vocabulary), "near-words")
    formed = met.join(vocabulary, "word").filter(F.col("near_n") >= ratio * F.col("n"))
    formed = written(formed.select("word", F.col("near").alias("form"), F.col("near_n").alias("form_n")), "forms")
    # each step multiplies the count by the ratio, so paths are short; every round doubles the steps followed
    most = vocabulary.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(max(most / least, 2), ratio)) + 1)
    roots = formed.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if formed.head(1) else 0):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = written(roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return (vocabulary.join(met.select("word", "n_near"), "word", "left").join(formed, "word", "left").join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n"))
