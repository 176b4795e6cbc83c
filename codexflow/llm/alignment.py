"""Alignment of two tokenizers' tokens (operator 13).

Both tokenizers encode a whole text. Byte offsets where a token that begins with white space starts in both are
anchors; each is a verified end shared by the tokens before it, so the text falls into windows of token ids that
can be aligned alone. Windows are mostly words, and words repeat: alignments are kept by the windows' ids.

Tokens of the two sides are linked where their bytes overlap. How often a pair of ids is linked is counted over the
corpus and brought back to the documents: frequent pairs travel to the tasks, rare ones are joined.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexflow.llm.bpe import PRETOKENS, Codec
from codexflow.llm.common import Shared, by_value, map_slices, written

by_value(__name__)

KEPT_WINDOWS, KEPT_LINKS = 100_000, 1_000_000  # of a worker; it forgets them all when either is reached
SLICE = 1 << 20  # bytes of text aligned at once
FREQUENT_PAIRS = 1 << 18  # most rows of pair counts that travel to every task


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


class Aligner:
    """Both vocabularies, built once per Python worker, and the windows met so far: their groups as text and their links."""

    def __init__(self, spec: str, model: bytes):
        self.spec, self.model, self.codec = spec, model, None

    def ready(self) -> Aligner:
        if self.codec is None:
            self.codec = Codec(self.spec)
            special = set(self.codec.special)
            ranks = {t: i for i, t in self.codec.tokens.items() if t.decode("utf-8", "replace") not in special}
            self.encode_a = tiktoken.Encoding("a", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.pieces = sentencepiece.SentencePieceProcessor(model_proto=self.model)
            a_bytes = [self.codec.tokens.get(i, b"") for i in range(max(self.codec.tokens) + 1)]
            names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
            b_bytes = [bytes([int(p[3:-1], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
            self.bytes = a_bytes, b_bytes
            self.flat = [np.frombuffer(b"".join(side), dtype=np.uint8) for side in self.bytes]
            self.sizes = [np.array([len(t) for t in side]) for side in self.bytes]
            self.starts = [np.cumsum(size) - size for size in self.sizes]
            self.spaced = [np.array([t[:1] == b" " for t in side]) for side in self.bytes]
            # an id as text, followed by what stands after a token within its group, and after the last one
            self.named = [np.array([[f"{i}," for i in range(len(side))], [f"{i}{end}" for i in range(len(side))]], dtype=object)
                          for side, end in zip(self.bytes, "|;")]
            self.forget()
        return self

    def forget(self) -> None:
        self.kept, self.texts, self.n_groups = {}, [], []
        self.links, self.link_starts = np.zeros(0, dtype=np.int64), [0]

    def unchanged(self, side: int, ids: list[np.ndarray], data: list[bytes]) -> np.ndarray:
        """For each text, whether its tokens' bytes are the text's."""
        joined = np.concatenate(ids)
        size = self.sizes[side][joined]
        found = self.flat[side][ranges(self.starts[side][joined], size)].tobytes()
        ends = np.cumsum(size)[np.cumsum([len(x) for x in ids]) - 1].tolist()
        return np.array([found[lo:hi] == d for lo, hi, d in zip([0, *ends], ends, data)])

    def learn(self, sides: list[np.ndarray], count: list[np.ndarray]) -> None:
        """Align new windows, ``count`` ids of each side in every one, all in one pass over their bytes."""
        ends = [np.cumsum(size[ids]) for ids, size in zip(sides, self.sizes)]
        marks = [np.zeros(int(ends[0][-1]) + 1, dtype=bool) for _ in sides]
        for mark, end in zip(marks, ends):
            mark[end] = True
        either, both = np.flatnonzero(marks[0] | marks[1]), marks[0] & marks[1]  # each stretch up to one of ``either`` is a link
        place = [(np.cumsum(mark) - mark)[either] for mark in marks]
        links = sides[0][place[0]].astype(np.int64) * len(self.bytes[1]) + sides[1][place[1]]
        groups_before = np.cumsum(both) - both
        last = np.cumsum(count[0]) - 1
        window_end = ends[0][last]
        # tokens in the order of the text: by group, side, place
        group = np.concatenate([groups_before[e] for e in ends])
        names = np.concatenate([name[both[e].astype(np.int64), ids] for name, e, ids in zip(self.named, ends, sides)])
        order = np.argsort(group * 2 + np.repeat([0, 1], [len(ids) for ids in sides]), kind="stable")
        names, cuts = names[order].tolist(), [0, *np.cumsum(count[0] + count[1]).tolist()]
        self.texts += ["".join(names[lo:hi])[:-1] for lo, hi in zip(cuts, cuts[1:])]
        self.n_groups += np.diff(groups_before[window_end] + 1, prepend=0).tolist()
        first = self.link_starts[-1]
        self.link_starts += (first + np.searchsorted(either, window_end, "right")).tolist()
        self.links = np.concatenate([self.links, links])

    def windows(self, sides: list[np.ndarray]):
        """(numbers of the windows in the order of the text, byte places where they start).

        A window starts where a token that begins with a space starts on both sides; windows met for the first time are aligned.
        """
        starts = [np.cumsum(size[ids]) - size[ids] for ids, size in zip(sides, self.sizes)]
        marks = np.zeros(int(starts[0][-1]) + int(self.sizes[0][sides[0][-1]]), dtype=np.int8)
        for start, ids, flag in zip(starts, sides, self.spaced):
            marks[start[flag[ids]]] += 1
        anchors = np.flatnonzero(marks == 2)
        first = [np.searchsorted(start, anchors) for start in starts]
        count = [np.diff(np.r_[f, len(ids)]) for f, ids in zip(first, sides)]
        # a window's key: the ids of one side, a mark, the ids of the other
        width = count[0] + count[1] + 1
        at = np.cumsum(width) - width
        mixed = np.full(int(width.sum()), 2 ** 32 - 1, dtype="<u4")
        mixed[ranges(at, count[0])], mixed[ranges(at + count[0] + 1, count[1])] = sides
        data, cuts = mixed.tobytes(), [*(4 * at).tolist(), 4 * len(mixed)]
        number = [self.kept.setdefault(data[lo:hi], -1) for lo, hi in zip(cuts, cuts[1:])]
        number = np.array(number)
        unknown = np.flatnonzero(number < 0).tolist()
        if unknown:
            new = []
            for i in unknown:
                key = data[cuts[i]:cuts[i + 1]]
                if self.kept[key] < 0:
                    self.kept[key] = len(self.texts) + len(new)
                    new.append(i)
                number[i] = self.kept[key]
            new = np.array(new)
            self.learn([ids[ranges(f[new], c[new])] for ids, f, c in zip(sides, first, count)], [c[new] for c in count])
        return number, anchors

    def align(self, texts: list[str]) -> dict[str, list]:
        """Columns of ``ALIGNED``, a row per text; zeros where either side's bytes are not the text's."""
        used = [i for i, text in enumerate(texts) if text]
        data = [b" " + texts[i].encode() for i in used]
        a_ids = [np.array(self.encode_a(" " + texts[i]), dtype="<u4") for i in used]
        b_ids = [np.array(p, dtype="<u4") for p in self.pieces.encode([texts[i] for i in used], num_threads=1)]
        if used:
            whole = np.flatnonzero(self.unchanged(0, a_ids, data) & self.unchanged(1, b_ids, data)).tolist()
            used, data, a_ids, b_ids = ([side[i] for i in whole] for side in (used, data, a_ids, b_ids))
        size = [len(d) for d in data]
        out = {c: np.zeros(len(texts), dtype=np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
        hashes, per_text, pairs, times = [""] * len(texts), np.zeros(len(texts), dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if used:
            if len(self.kept) > KEPT_WINDOWS or self.link_starts[-1] > KEPT_LINKS:
                self.forget()
            out["n_a"][used], out["n_b"][used] = [len(x) for x in a_ids], [len(x) for x in b_ids]
            # every text begins with the added space on both sides, so windows never cross texts
            number, anchors = self.windows([np.concatenate(a_ids), np.concatenate(b_ids)])
            cuts = [*np.searchsorted(anchors, np.cumsum(size) - size).tolist(), len(number)]
            told = [self.texts[w] for w in number.tolist()]
            for i, lo, hi in zip(used, cuts, cuts[1:]):
                hashes[i] = hashlib.sha256(";".join(told[lo:hi]).encode()).hexdigest()
            first = np.array(self.link_starts)
            counts = np.diff(first)[number]
            owner = np.repeat(used, np.diff(cuts))
            np.add.at(out["n_groups"], owner, np.array(self.n_groups)[number])
            np.add.at(out["n_links"], owner, counts)
            vocabulary = len(self.bytes[0]) * len(self.bytes[1])
            links = np.repeat(owner, counts) * vocabulary + self.links[ranges(first[number], counts)]
            links, times = np.unique(links, return_counts=True)
            pairs, per_text = links % vocabulary, np.bincount(links // vocabulary, minlength=len(texts))
        ends = np.r_[0, np.cumsum(per_text)].astype(np.int32)
        return {**out, "groups_sha256": hashes, "pairs": pa.ListArray.from_arrays(ends, pa.array(pairs)), "times": pa.ListArray.from_arrays(ends, pa.array(times))}


ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): one row per input row, written.

    ``pairs``: the different id pairs a text links, as a's id times the size of b's vocabulary plus b's id;
    ``times``: how many of its links hold each.
    """
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        shared = Shared(docs.sparkSession, Aligner(a.read(), b.read()))

    def make():
        aligner = shared.value.ready()

        def work(rows):
            return {"row": rows["row"], "id": rows["id"], **aligner.align([t or "" for t in rows["text"]])}

        return work

    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return written(map_slices(own, make, f"row long, id {own.schema['id'].dataType.simpleString()}, {ALIGNED}", limit=SLICE), "aligned")


def pair_counts(found: DataFrame, b_size: int) -> DataFrame:
    """(pair, count, best): links that hold each pair over all texts; ``best`` where no pair of its b id has more."""
    counts = (found.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair"))
              .agg(F.sum("x.times").alias("count")))
    counts = written(counts.withColumn("b", F.col("pair") % b_size), "pair-counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))  # one row per id of b: the vocabulary bounds it
    return written(counts.join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "pairs")


def align(docs: DataFrame, a_path: str, b_path: str, frequent: int = FREQUENT_PAIRS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per input row.

    ``n_best``: links whose pair has its b id's highest count in the corpus, ties included; ``count_sum``: the sum of the
    pairs' counts over all links. Null and empty texts, and texts that either tokenizer changes, have no tokens: zeros and
    ''. Very long texts are encoded whole; repeated rows count again and give repeated rows; an empty table gives none;
    other columns are not read. ``frequent`` bounds the pairs that are broadcast and changes no result.
    """
    found = aligned(docs, a_path, b_path, id_col, text_col)
    counts = pair_counts(found, sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size())
    levels = counts.groupBy(F.floor(F.log2("count")).alias("level")).agg(F.count("*").alias("n")).collect()  # 64 rows at most
    floor, rows = 64, 0
    for level, n in sorted(((r.level, r.n) for r in levels), reverse=True):
        if rows + n > frequent:
            break
        floor, rows = level, rows + n
    is_frequent = F.floor(F.log2("count")) >= floor
    often = F.broadcast(counts.filter(is_frequent))  # ``frequent`` rows at most
    linked = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")]
    rare = linked.join(often, "pair", "left_anti").join(counts.filter(~is_frequent), "pair")
    both = linked.join(often, "pair").groupBy("row").agg(*sums).unionByName(rare.groupBy("row").agg(*sums))
    total = both.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.drop("pairs", "times").join(total, "row", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
