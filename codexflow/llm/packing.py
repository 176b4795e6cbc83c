"""Best-fit packing of tokenised documents into fixed-length sequences (operator 3).

Bulk-synchronous best fit over two tables, waiting pieces and open gaps. Pieces come in bands of length,
long ones first. A superstep range-sorts the band's pieces and the gaps that may hold them, largest first,
and sweeps every range in its own task: each piece goes to its successor, the smallest gap of the range
that holds it, and the gap shrinks. What a range could not place meets the gaps left in the ranges before
it, all of which are large enough: one row of counts per range says which, and ranks resolve the conflicts, the
k-th piece taking the k-th gap in a join. Supersteps repeat until no gap holds a waiting piece; the
rest open new sequences, range by range. Every step is a written table.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexflow.llm.bpe import vocabulary
from codexflow.llm.common import by_value, map_slices, written

by_value(__name__)

PLACED, WAITING, GAP = 0, 1, 2
STATE_SCHEMA = "kind int, size long, place long, sequence long, at long, range int, nth long"
ROWS_PER_RANGE = 1 << 18  # pieces and gaps one task sweeps


def cut(n_ids: int, room: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, the remainder first."""
    first = n_ids % room
    bounds = ([0] if first else []) + list(range(first, n_ids + 1, room))
    return [(lo, hi - lo) for lo, hi in zip(bounds, bounds[1:])]


def pieces(docs: DataFrame, path: str, room: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
           keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32 [, ids]): every document's ids plus ``end_id``, cut to ``room``."""
    shared = vocabulary(docs.sparkSession, path)

    def make():
        codec, end = shared.value.ready(), np.array([end_id], dtype="<u4").tobytes()

        def work(rows):
            out = {k: [] for k in ("id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []))}
            for doc, text in zip(rows["id"], rows["text"]):
                ids = codec.encode(text or "") + end
                for i, (start, length) in enumerate(cut(len(ids) // 4, room)):
                    own = ids[4 * start:4 * (start + length)]
                    for key, value in zip(out, (doc, i, start, length, zlib.crc32(own), own)):
                        out[key].append(value)
            return out

        return work

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    return map_slices(own, make, f"id {kind}, piece int, start long, length long, ids_crc32 long"
                      + (", ids binary" if keep_ids else ""))


def best_fit(waiting: dict[int, np.ndarray], gaps: dict[int, np.ndarray], room: int, first_new: int | None):
    """Best fit of one range, long pieces first: (placed, left waiting, left gaps).

    ``waiting`` maps a length to its pieces and ``gaps`` a room to its sequences. A gap that took a piece stays the
    successor for that length while it holds one more, so it takes as many as fit at once. With
    ``first_new`` pieces that fit nowhere open sequences numbered from there, without it they are left.
    """
    gaps = {size: [own] for size, own in gaps.items()}
    sizes, placed, left = sorted(gaps), [], {}

    def open_gaps(size, sequences):
        if size > 0 and len(sequences):
            if size not in gaps:
                gaps[size] = []
                insort(sizes, size)
            gaps[size].append(sequences)

    for length in sorted(waiting, reverse=True):
        rest = waiting[length]
        while len(rest):
            at = bisect_left(sizes, length)
            if at < len(sizes):
                size = sizes[at]
                sequences = gaps[size].pop()
                if not gaps[size]:
                    del gaps[size]
                    sizes.pop(at)
            elif first_new is None:
                left[length] = rest
                break
            else:
                size, n = room, -(-len(rest) // (room // length))
                sequences = np.arange(first_new, first_new + n)
                first_new += n
            each = size // length
            full = min(len(sequences), len(rest) // each)
            n, used = (full * each, full) if full else (len(rest), 1)
            filled = each if full else n
            placed.append((rest[:n], np.repeat(sequences[:used], filled), room - size + np.tile(np.arange(filled) * length, used)))
            open_gaps(size - filled * length, sequences[:used])
            open_gaps(size, sequences[used:])
            rest = rest[n:]
    return placed, left, {size: np.concatenate(own) for size, own in gaps.items()}


def by_size(sizes: np.ndarray, names: np.ndarray) -> dict[int, np.ndarray]:
    values, starts = np.unique(sizes, return_index=True)
    return dict(zip(values.tolist(), np.split(names, starts[1:])))


def sweep(rows: DataFrame, ranges: int, room: int, step: int, opening: bool) -> DataFrame:
    """One sweep over the range-sorted union of pieces and gaps; ``range`` and ``nth`` number what is left.

    Ranges are in descending order of size, gaps before pieces, so a gap numbered in a range holds every piece
    of a later one. Gaps shrunk below their range have no number until the next superstep.
    """
    schema = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("size", "place", "sequence", "at")),
                        ("range", pa.int32()), ("nth", pa.int64())])

    def run(batches):
        parts = [[b.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "size", "name")] for b in batches if b.num_rows]
        if not parts:
            return
        number = TaskContext.get().partitionId()
        kind, size, name = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(size, kind="stable")
        kind, size, name = kind[order], size[order], name[order]
        lone = kind == WAITING
        first_new = ((step << 20 | number) << 32) if opening else None
        placed, left, gaps = best_fit(by_size(size[lone], name[lone]), by_size(size[~lone], name[~lone]), room, first_new)

        def batch(kind, n, **columns):
            columns = {"kind": np.full(n, kind), "range": np.full(n, number)} | columns
            arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema]
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        if placed:
            own, sequences, at = (np.concatenate(c) for c in zip(*placed))
            yield batch(PLACED, len(own), place=own, sequence=sequences, at=at)
        if left:
            lengths = sorted(left, reverse=True)
            own = np.concatenate([left[length] for length in lengths])
            yield batch(WAITING, len(own), size=np.repeat(lengths, [len(left[length]) for length in lengths]), place=own, nth=np.arange(len(own)))
        for steady in (True, False):
            held = [g for g in sorted(gaps) if (g >= size[0]) == steady]  # the smallest first
            if held:
                own = np.concatenate([gaps[g] for g in held])
                nth = {"nth": np.arange(len(own))} if steady else {}
                yield batch(GAP, len(own), size=np.repeat(held, [len(gaps[g]) for g in held]), sequence=own, **nth)

    sort = [F.desc("size"), F.desc("kind")]
    dealt = rows.repartitionByRange(ranges, *sort, F.xxhash64("name")) if ranges > 1 else rows.repartition(1)
    return dealt.mapInArrow(run, STATE_SCHEMA)


def carried(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Which gaps of earlier ranges the pieces left in a range take, nearest range first, from counts per range.

    ``counts`` holds (range, pieces left, gaps numbered) in order; the result (range, lo, hi, gap range, first gap)
    says that pieces lo..hi-1 take the gaps from ``first gap`` on.
    """
    out, stack = [], []
    for number, waiting, gaps in counts:
        lo = 0
        while lo < waiting and stack:
            held, first, n = stack.pop()
            taken = min(n, waiting - lo)
            out.append((number, lo, lo + taken, held, first))
            lo += taken
            if taken < n:
                stack.append((held, first + taken, n - taken))
        if gaps:
            stack.append((number, 0, gaps))
    return out


def resolve(state: DataFrame, intervals: list[tuple[int, int, int, int, int]], room: int) -> DataFrame:
    """Pieces left by the sweep take their gaps of earlier ranges: the k-th piece the k-th gap, in a join on both numbers."""
    spark = state.sparkSession
    taken = F.broadcast(spark.createDataFrame(intervals, "own long, lo long, hi long, gap_range long, first long"))  # two rows a range at most
    waiting = state.filter(F.col("kind") == WAITING).join(
        taken, (F.col("range") == F.col("own")) & (F.col("nth") >= F.col("lo")) & (F.col("nth") < F.col("hi")), "left")
    waiting = waiting.select(F.col("size").alias("length"), F.col("place").alias("piece_place"),
                             F.coalesce("gap_range", F.lit(-1) - F.col("range")).alias("r"),  # negative: meets no gap
                             F.coalesce(F.col("first") + F.col("nth") - F.col("lo"), F.col("nth")).alias("k"))
    numbered = F.col("nth").isNotNull()
    gaps = state.filter((F.col("kind") == GAP) & numbered).select(
        F.col("size").alias("held"), F.col("sequence").alias("own_sequence"), F.col("range").cast("long").alias("r"), F.col("nth").alias("k"))
    met = waiting.join(gaps, ["r", "k"], "full")
    both, none = F.col("length").isNotNull() & F.col("held").isNotNull(), F.lit(None).cast("long")

    def row(kind, size=none, place=none, sequence=none, at=none):
        return F.struct(F.lit(kind).alias("kind"), size.alias("size"), place.alias("place"), sequence.alias("sequence"), at.alias("at"),
                        F.lit(None).cast("int").alias("range"), none.alias("nth"))

    piece, sequence = F.col("piece_place"), F.col("own_sequence")
    rows = F.when(both, F.array(row(PLACED, place=piece, sequence=sequence, at=room - F.col("held")),
                                row(GAP, F.col("held") - F.col("length"), sequence=sequence)))
    rows = rows.when(F.col("held").isNull(), F.array(row(WAITING, F.col("length"), piece))).otherwise(F.array(row(GAP, F.col("held"), sequence=sequence)))
    settled = state.filter((F.col("kind") == PLACED) | ((F.col("kind") == GAP) & ~numbered))
    return settled.unionByName(met.select(F.inline(rows)).filter((F.col("kind") != GAP) | (F.col("size") > 0)))


def bands(room: int) -> list[tuple[int, int]]:
    """(over, up to): halves of the sequence four times, then the rest."""
    ends = [room >> k for k in range(5) if room >> k]
    return list(zip([*ends[1:], 0], ends))


def match(cut_up: DataFrame, room: int, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame | None:
    """(place, sequence, at) of every row (place, length): supersteps band by band. None for an empty table."""
    sized = cut_up.select(F.lit(WAITING).alias("kind"), F.col("length").alias("size"), F.col("place").alias("name"))
    floor = reduce(lambda c, b: c.when(F.col("size") > b[0], b[0]), bands(room), F.when(F.lit(False), 0))
    n_of = {r["floor"]: r["n"] for r in sized.groupBy(floor.alias("floor")).agg(F.count("*").alias("n")).collect()}  # one row a band
    step, gaps, placed = 0, None, []
    for over, up_to in bands(room):
        waiting, n, stuck = sized.filter((F.col("size") > over) & (F.col("size") <= up_to)), n_of.get(over, 0), False
        while n:
            fitting = None if stuck or gaps is None else gaps.filter(F.col("size") > over)
            n_fitting = 0 if fitting is None else fitting.count()
            ranges = -(-(n + n_fitting) // rows_per_range)
            opening = ranges == 1 or not n_fitting  # one range sees every gap there is
            rows = waiting.unionByName(fitting.select("kind", "size", F.col("sequence").alias("name"))) if n_fitting else waiting
            state = written(sweep(rows, ranges, room, step, opening), "sweep")
            if not opening:
                counts = state.filter("nth is not null").groupBy("range").agg(
                    F.count(F.when(F.col("kind") == WAITING, 1)).alias("waiting"), F.count(F.when(F.col("kind") == GAP, 1)).alias("gaps")).collect()
                intervals = carried(sorted((r["range"], r["waiting"], r["gaps"]) for r in counts))  # one row a range
                if intervals:
                    state = written(resolve(state, intervals, room), "resolved")
            kinds = {r["kind"]: r["n"] for r in state.groupBy("kind").agg(F.count("*").alias("n")).collect()}
            placed.append(state.filter(F.col("kind") == PLACED).select("place", "sequence", "at"))
            found = state.filter(F.col("kind") == GAP).select("kind", "size", "sequence")
            aside = gaps.filter(F.col("size") <= over) if n_fitting else gaps
            gaps = found if aside is None else found.unionByName(aside)
            waiting = state.filter(F.col("kind") == WAITING).select("kind", "size", F.col("place").alias("name"))
            n, stuck, step = kinds.get(WAITING, 0), not kinds.get(PLACED, 0), step + 1
        if n_of.get(over):
            gaps = written(gaps, "gaps")
    return reduce(DataFrame.unionByName, placed) if placed else None


def pack(docs: DataFrame, path: str, room: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
         keep_ids: bool = False, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset [, ids].

    Null and empty texts give one piece with only ``end_id``. Repeated rows are packed as often as they
    come; which of equal lengths goes where may differ between runs. An empty table gives no rows. Other columns are not read.
    ``rows_per_range`` sets how many pieces and gaps one task sweeps: with one range the result is best-fit decreasing.
    """
    named = pieces(docs, path, room, end_id, id_col, text_col, keep_ids).withColumn("place", F.monotonically_increasing_id())
    cut_up = written(named, "pieces")
    found = match(cut_up, room, rows_per_range)
    if found is None:
        found = cut_up.select("place", F.lit(None).cast("long").alias("sequence"), F.lit(None).cast("long").alias("at"))
    return cut_up.join(found, "place").select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        F.col("sequence").alias("sequence_id"), F.col("at").alias("offset"), *(["ids"] if keep_ids else []))
