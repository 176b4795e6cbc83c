"""Plain Python helpers that run inside Arrow batches on executors.

The module is pickled by value, so executors need no copy of this package.
"""

import hashlib
import sys
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def fill_chunks(text: str, bounds: list[int], size: int, overlap: int) -> list[str]:
    """Greedy chunks over pieces ``text[bounds[i]:bounds[i+1]]``.

    A chunk closes before the piece that would exceed ``size``; the next one
    reopens at the earliest piece that leaves at most ``overlap`` characters
    and still fits.
    """
    out, first = [], 0
    for i in range(len(bounds) - 1):
        end, nxt = bounds[i], bounds[i + 1]
        if i > first and nxt - bounds[first] > size:
            out.append(text[bounds[first]:end].strip())
            while end - bounds[first] > overlap or (nxt - bounds[first] > size and end > bounds[first]):
                first += 1
    out.append(text[bounds[first]:bounds[-1]].strip())
    return [c for c in out if c]


def split_text(text: str, separators: list[str], size: int, overlap: int) -> list[str]:
    """Cut at the first separator that occurs; oversize pieces try later ones.

    A separator stays at the start of the piece it opens.
    """
    for level, sep in enumerate(separators):
        if sep in text:
            break
    else:
        return [text] if len(text) >= size else [c for c in [text.strip()] if c]
    bounds, at = [0], text.find(sep)
    while at >= 0:
        if at > 0:
            bounds.append(at)
        at = text.find(sep, at + len(sep))
    bounds.append(len(text))
    out, run = [], [0]
    for lo, hi in zip(bounds, bounds[1:]):
        if hi - lo < size:
            run.append(hi)
            continue
        if len(run) > 1:
            out += fill_chunks(text, run, size, overlap)
        rest = separators[level + 1:]
        out += split_text(text[lo:hi], rest, size, overlap) if rest else [text[lo:hi]]
        run = [hi]
    return out + (fill_chunks(text, run, size, overlap) if len(run) > 1 else [])


def batch_splitter(separators: list[str], size: int, overlap: int, limit: int = 4 << 20):
    """Array of text arrays -> array of arrays of chunk arrays; about ``limit`` bytes of text become Python strings at once."""
    kind = pa.list_(pa.list_(pa.string()))

    def split(batch: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.binary_length(batch.flatten()), 0).to_numpy(zero_copy_only=False)
        lengths = pc.fill_null(batch.value_lengths(), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(np.bincount(np.repeat(np.arange(len(batch)), lengths), sizes, len(batch))) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
        return pa.concat_arrays([pa.array([None if row is None else [None if t is None else split_text(t, separators, size, overlap) for t in row]
                                           for row in batch.slice(lo, hi - lo).to_pylist()], kind) for lo, hi in zip(cuts, cuts[1:])])

    return split


def chunk_table(separators: list[str], size: int, overlap: int):
    """A table function's class: the chunks of one text as rows, none for a null text."""
    class Chunks:
        def eval(self, text: str):
            yield from enumerate(split_text(text, separators, size, overlap) if text is not None else [])

    return Chunks


class Best:
    """The k best rows of every question, numbered from 0; equal scores go to the smaller id.

    Rows under a question's k-th score are dropped as they come; the others are sorted when many have gathered.
    """

    def __init__(self, n: int, k: int):
        self.k, self.floor, self.parts, self.size = k, np.full(n, -np.inf), [], 0
        self.most = max(4 * n * k, 1 << 18)

    def add(self, question: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        kept = scores >= self.floor[question]
        self.parts.append((question[kept], ids[kept], scores[kept]))
        self.size += len(self.parts[-1][0])
        if self.size > self.most:
            self.prune()

    def prune(self) -> None:
        if not self.parts:
            return
        question, ids, scores = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((pd.factorize(ids, sort=True)[0] if ids.dtype == object else ids, -scores, question))
        question, ids, scores = question[order], ids[order], scores[order]
        first = np.searchsorted(question, question)
        rank = np.arange(len(question)) - first
        last = rank == self.k - 1
        self.floor[question[last]] = scores[last]
        kept = rank < self.k
        self.parts = [(question[kept], ids[kept], scores[kept])]
        self.size = int(kept.sum())

    def frames(self, qids: list, rows: int = 1 << 16):
        self.prune()
        for question, ids, scores in self.parts:
            for lo in range(0, len(question), rows):
                part = question[lo:lo + rows].tolist()
                yield pd.DataFrame({"qid": [qids[q] for q in part], "id": ids[lo:lo + rows], "score": scores[lo:lo + rows].astype(np.float64)})


def scan_topk(queries: dict, k: int, digits: int, block: int = 1_024, batch_rows: int = 2_048):
    """mapInPandas body: ``queries`` maps a key to (qids, vectors); corpus rows
    meet only the questions with their own key, ``block`` of them at a time."""
    def run(batches):
        held = {key: Best(len(qids), k) for key, (qids, _) in queries.items()}
        for pdf in batches:
            for key, group in pdf.groupby("key", sort=False):
                if key not in queries:
                    continue
                vectors, best = queries[key][1], held[key]
                for start in range(0, len(group), batch_rows):
                    part = group.iloc[start:start + batch_rows]
                    ids, vecs = part["id"].to_numpy(), np.stack(part["vec"].to_numpy()).astype(np.float64)
                    for low in range(0, len(vectors), block):
                        scores = np.round(vectors[low:low + block] @ vecs.T, digits) + 0.0
                        if len(ids) > k:  # of a tile, no question needs more than its k best and their equals
                            cut = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
                            question, row = np.nonzero(scores >= np.maximum(cut, best.floor[low:low + block])[:, None])
                        else:
                            question, row = np.nonzero(scores >= best.floor[low:low + block, None])
                        best.add(question + low, ids[row], scores[question, row])
        for key, best in held.items():
            yield from best.frames(queries[key][0])

    return run


class Asked:
    """Questions as three lists (qid, term, weight), to be found in Arrow lists of terms and summed up.

    Terms of over a quarter of the questions lie in a table of terms x questions, which has fewer than four cells per entry.
    """

    def __init__(self, qids: list, terms: list, weights):
        place: dict = {}
        question = np.array([place.setdefault(q, len(place)) for q in qids], dtype=np.int64)
        self.qids, self.n = list(place), len(place)
        coded = pa.array(terms, pa.string()).dictionary_encode()
        self.terms, code = coded.dictionary, coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        code, self.question, self.weight = code[order], question[order], np.array(weights, dtype=np.float64)[order]
        self.start = np.searchsorted(code, np.arange(len(self.terms) + 1))
        self.size = np.diff(self.start)
        often = np.flatnonzero(self.size * 4 > self.n)
        self.column = np.full(len(self.terms), -1)
        self.column[often] = np.arange(len(often))
        self.size[often] = 0
        self.table, self.shared = np.zeros((len(often), self.n)), np.zeros((len(often), self.n), dtype=np.float32)
        dense = self.column[code] >= 0
        at = self.column[code[dense]], self.question[dense]
        np.add.at(self.table, at, self.weight[dense])
        self.shared[at] = 1

    def tiles(self, lists: pa.ListArray, cells: int = 1 << 20, terms: int = 1 << 20):
        """(first row, rows, row, code, place) of the asked terms in some rows at a time; ``place`` counts terms from the first list on.

        About ``terms`` terms are looked up at once, and a tile has about ``cells`` pairs of row and question.
        """
        ends = np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        step, low, before = max(1, min(256, cells // max(self.n, 1))), 0, 0
        while low < len(lists):
            high = max(low + 1, int(np.searchsorted(ends, before + terms, "right")))
            flat = lists.slice(low, high - low).flatten()
            code = pc.fill_null(pc.index_in(flat, value_set=self.terms.cast(flat.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.flatnonzero(code >= 0)
            row, code = np.searchsorted(ends, before + at, "right"), code[at]
            load = np.cumsum(np.bincount(row - low, self.size[code], high - low))
            first = low
            while first < high:
                most = (load[first - low - 1] if first > low else 0) + 4 * cells
                last = min(first + step, high, max(first + 1, low + int(np.searchsorted(load, most, "right"))))
                lo, hi = np.searchsorted(row, (first, last))
                yield first, last - first, row[lo:hi] - first, code[lo:hi], before + at[lo:hi]
                first = last
            low, before = high, int(ends[high - 1])

    def sums(self, rows: int, row: np.ndarray, code: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(total, met), both rows x questions: sums of weight x part, and where a term is shared. No pair (row, code) repeats."""
        column = self.column[code]
        dense = column >= 0
        parts = np.zeros((rows, len(self.table)))
        parts[row[dense], column[dense]] = part[dense]
        total, met = parts @ self.table, (parts != 0).astype(np.float32) @ self.shared > 0
        row, code, part = row[~dense], code[~dense], part[~dense]
        size = self.size[code]
        at = np.arange(size.sum()) + np.repeat(self.start[code] - np.cumsum(size) + size, size)
        cell = np.repeat(row, size) * self.n + self.question[at]
        total += np.bincount(cell, self.weight[at] * np.repeat(part, size), rows * self.n).reshape(total.shape)
        met.reshape(-1)[cell] = True
        return total, met


def runs(sizes, most: int):
    """(first row, row after the last) of neighbours, with ``sizes`` of about ``most`` in all."""
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    return zip(cuts, cuts[1:])


def tile_scores(asked: Asked, lists: pa.ListArray, lengths: np.ndarray, avgdl: float, k1: float, b: float, digits: int):
    """(first row, total, met) of some rows at a time: BM25 scores, rows x questions, and where a term is shared."""
    for first, rows, row, code, _ in asked.tiles(lists):
        pair, tf = np.unique(row * len(asked.terms) + code, return_counts=True)
        row, code = np.divmod(pair, max(len(asked.terms), 1))
        total, met = asked.sums(rows, row, code, term_part(tf, lengths[first + row], avgdl, k1, b))
        yield first, np.round(total, digits) + 0.0, met


def scan_terms(weights: tuple, k: int, avgdl: float, k1: float, b: float, digits: int, most: int = 8 << 20):
    """mapInPandas body: BM25 of rows (id, dl, text) for the questions of ``weights``, three lists (qid, term, weight).

    All questions are scored in one pass. ``text`` holds a document's terms, a line each; they become Arrow lists, of about
    ``most`` characters at a time, and only numbers of the asked ones are looked at.
    """
    def run(batches):
        asked = Asked(*weights)
        best = Best(asked.n, k)
        for pdf in batches:
            ids, lengths = pdf["id"].to_numpy(), pdf["dl"].to_numpy()
            for low, high in runs([len(t) for t in pdf["text"]], most):
                lists = pc.split_pattern(pa.array(pdf["text"].iloc[low:high], pa.string()), "\n")
                for first, total, met in tile_scores(asked, lists, lengths[low:high], avgdl, k1, b, digits):
                    at, question = np.nonzero(met & (total >= best.floor[None]))
                    best.add(question, ids[low + first + at], total[at, question])
        yield from best.frames(asked.qids)

    return run


def scan_scores(weights: tuple, avgdl: float, k1: float, b: float, digits: int, schema: pa.Schema, most: int = 8 << 20):
    """mapInArrow body: ``scan_terms`` without a k. Every pair of a question and a row that share a term is given out as it comes."""
    def run(batches):
        asked = Asked(*weights)
        qids = pa.array(asked.qids, schema.field("qid").type)
        for batch in batches:
            ids, lengths, text = batch.column("id"), batch.column("dl").to_numpy(zero_copy_only=False), batch.column("text")
            for low, high in runs(pc.binary_length(text).to_numpy(zero_copy_only=False), most):
                lists = pc.split_pattern(text.slice(low, high - low), "\n")
                for first, total, met in tile_scores(asked, lists, lengths[low:high], avgdl, k1, b, digits):
                    at, question = np.nonzero(met)
                    pairs = [qids.take(pa.array(question)), ids.take(pa.array(low + first + at)), pa.array(total[at, question])]
                    yield pa.RecordBatch.from_arrays(pairs, schema=schema)

    return run


def scan_bounds(weights: tuple, floors: dict, best: int | None, digits: int, schema: pa.Schema):
    """mapInArrow body over rows (block, terms, tops): upper bounds of the scores in each block.

    With ``best``: the blocks of the highest bounds per question. Without: the blocks whose bound reaches the
    floor of some question, or is above 0 for a question without one.
    """
    def run(batches):
        qids, terms, values = weights
        asked = Asked(qids, terms, np.maximum(np.array(values, dtype=np.float64), 0.0))  # a negative part cannot raise a score
        slack = 10.0 ** -digits  # scores are rounded
        least = np.array([floors.get(q, slack) - slack for q in asked.qids]) if floors else np.zeros(asked.n)
        kept = Best(asked.n, best or 1)
        for batch in batches:
            blocks, tops = batch.column("block").to_numpy(), batch.column("tops").flatten().to_numpy(zero_copy_only=False)
            for first, rows, row, code, place in asked.tiles(batch.column("terms")):
                bound, _ = asked.sums(rows, row, code, tops[place])
                if best:
                    at, question = np.nonzero(bound)
                    kept.add(question, blocks[first + at], bound[at, question])
                else:
                    reached = ((bound > 0) & (bound >= least)).any(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(blocks[first:first + rows][reached])], schema=schema)
        if best:
            for frame in kept.frames(asked.qids):
                yield pa.RecordBatch.from_pandas(frame.rename(columns={"id": "block", "score": "bound"}), schema, preserve_index=False)

    return run


def term_part(tf, dl, avgdl: float, k1: float, b: float):
    """A term's part of a document's BM25 score, before its weight."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / max(avgdl, 1e-9)))


def counted_terms(lists: pa.ListArray, most: int = 1 << 20):
    """(row, code, tf, terms): each different term of each list, by its number among ``terms``; about ``most`` terms at once."""
    lengths = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
    ends, low, before = np.cumsum(lengths, dtype=np.int64), 0, 0
    while low < len(lists):
        high = max(low + 1, int(np.searchsorted(ends, before + most, "right")))
        coded = lists.slice(low, high - low).flatten().dictionary_encode()
        terms = coded.dictionary
        row = np.repeat(np.arange(low, high), lengths[low:high])
        pair, tf = np.unique(row * max(len(terms), 1) + coded.indices.to_numpy(), return_counts=True)
        yield *np.divmod(pair, max(len(terms), 1)), tf, terms
        low, before = high, int(ends[high - 1])


def weighty_terms(common: pa.Array, idf: np.ndarray, avgdl: float, k1: float, b: float, schema: pa.Schema):
    """mapInArrow body over (id, dl, toks): (id, term, part) of the weightiest ``common`` term of each row, and of all terms that are not common."""
    def run(batches):
        for batch in batches:
            lengths = batch.column("dl").to_numpy(zero_copy_only=False)
            for row, code, tf, terms in counted_terms(batch.column("toks")):
                place = pc.fill_null(pc.index_in(terms, value_set=common.cast(terms.type)), -1).to_numpy(zero_copy_only=False)[code]
                part = term_part(tf, lengths[row], avgdl, k1, b)
                known = np.flatnonzero(place >= 0)
                order = known[np.lexsort((idf[place[known]] * part[known], row[known]))]
                last = order[np.flatnonzero(np.diff(row[order], append=-1))]
                kept = np.concatenate([last, np.flatnonzero(place < 0)])
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row[kept])), terms.take(pa.array(code[kept])), pa.array(part[kept])], schema=schema)

    return run


def block_tops(avgdl: float, k1: float, b: float, schema: pa.Schema):
    """mapInArrow body over (block, dl, toks), sorted by block: (block, terms, tops), each term's largest part in the block."""
    def run(batches):
        for batch in batches:
            blocks, lengths = batch.column("block").to_numpy(), batch.column("dl").to_numpy(zero_copy_only=False)
            for row, code, tf, terms in counted_terms(batch.column("toks")):
                found, own = np.unique(blocks[row], return_inverse=True)
                pair = own * max(len(terms), 1) + code
                order = np.argsort(pair, kind="stable")
                first = np.flatnonzero(np.diff(pair[order], prepend=-1))
                if not len(first):
                    continue
                tops = np.maximum.reduceat(term_part(tf, lengths[row], avgdl, k1, b)[order], first)
                ends = pa.array(np.r_[np.searchsorted(own[order][first], np.arange(len(found))), len(first)].astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, terms.take(pa.array(code[order][first]))), pa.ListArray.from_arrays(ends, pa.array(tops))
                yield pa.RecordBatch.from_arrays([pa.array(found), *(x.cast(schema.field(i).type) for i, x in enumerate(lists, 1))], schema=schema)

    return run


def nearest_center(points: np.ndarray, centers: np.ndarray, rows: int = 8_192) -> np.ndarray:
    norms = (centers ** 2).sum(axis=1)
    return np.concatenate([np.argmin(norms - 2 * points[lo:lo + rows] @ centers.T, axis=1) for lo in range(0, len(points), rows)] or [np.zeros(0, dtype=np.int64)])


def kmeans(points: np.ndarray, k: int, random, rounds: int = 12) -> np.ndarray:
    """Lloyd's centers; fewer than ``k`` where there are fewer different points."""
    different = np.unique(points, axis=0)
    centers = different[random.choice(len(different), min(k, len(different)), replace=False)]
    for _ in range(rounds):
        own = nearest_center(points, centers)
        size = np.bincount(own, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, own, points)
        centers = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centers)
    return centers


def encode_vectors(centroids: np.ndarray, books: np.ndarray):
    """mapInPandas body over (id, vec): list, code of the residual, distance of what the code stands for."""
    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            vecs = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
            own = nearest_center(vecs, centroids)
            rest = vecs - centroids[own]
            parts = np.split(rest, len(books), axis=1)
            code = np.stack([nearest_center(p, book) for p, book in zip(parts, books)], axis=1)
            error = np.sqrt(sum(((p - book[c]) ** 2).sum(axis=1) for p, book, c in zip(parts, books, code.T)))
            yield pd.DataFrame({"id": pdf["id"], "vec": list(vecs), "code": [c.tobytes() for c in code.astype(np.uint8)], "error": error, "list": own.astype(np.int32)})

    return run


def scan_codes(qids: list, vectors: np.ndarray, chosen: np.ndarray, centroids: np.ndarray, books: np.ndarray, keep: int, exact: bool,
               floors: np.ndarray | None = None, cells: int = 1 << 18):
    """mapInPandas body over (id, code, error, list): members of the chosen lists with bounds of their inner product.

    The ``keep`` of highest low bound per question and task, or with ``floors`` all whose high bound reaches the
    question's floor, which are given out as they come. Tiles have about ``cells`` pairs of question and member.
    """
    def run(batches):
        tables = [part @ book.T for part, book in zip(np.split(vectors, len(books), axis=1), books)]
        length = np.linalg.norm(vectors, axis=1) if exact else np.zeros(len(vectors))
        best = Best(len(qids), keep)

        def bounds(pdf):
            for number, group in pdf.groupby("list", sort=False):
                asked = np.flatnonzero(chosen[:, number])
                step = max(1, cells // max(len(asked), 1))
                for start in range(0, len(group) if len(asked) else 0, step):
                    tile = group.iloc[start:start + step]
                    code = np.frombuffer(b"".join(tile["code"]), dtype=np.uint8).reshape(len(tile), -1)
                    about = (vectors[asked] @ centroids[number])[:, None] + sum(t[asked][:, c] for t, c in zip(tables, code.T))
                    off = length[asked][:, None] * tile["error"].to_numpy()[None]
                    yield number, asked, tile["id"].to_numpy(), about - off, about + off + 1e-6 if exact else about

        for pdf in batches:
            for number, asked, ids, low, high in bounds(pdf):
                if floors is not None:
                    q, r = np.nonzero(high >= floors[asked][:, None])
                    yield pd.DataFrame({"qid": [qids[i] for i in asked[q].tolist()], "id": ids[r], "list": np.full(len(r), number, dtype=np.int32), "low": low[q, r], "high": high[q, r]})
                    continue
                floor = best.floor[asked]
                if len(ids) > keep:  # of a tile, no question needs more than its best and their equals
                    floor = np.maximum(floor, np.partition(low, len(ids) - keep, axis=1)[:, len(ids) - keep])
                q, r = np.nonzero(low >= floor[:, None])
                best.add(asked[q], np.array([(i, number) for i in ids[r]] + [None], dtype=object)[:-1], low[q, r])
        if floors is None:
            for frame in best.frames(qids):
                yield pd.DataFrame({"qid": frame["qid"], "id": [i for i, _ in frame["id"]], "list": np.array([n for _, n in frame["id"]], dtype=np.int32),
                                    "low": frame["score"], "high": frame["score"]})

    return run


class Digest:
    """SHA-256 of a file of known size that comes as its lines, without the newlines between them.

    The reader of lines drops a byte order mark at a file's start and does not tell whether a newline ends it; the size
    does. So there is one sum with the mark and one without.
    """

    MARK = b"\xef\xbb\xbf"

    def __init__(self, path: str, size: int):
        self.path, self.size, self.read, self.begun = path, size, 0, False
        self.plain, self.marked = hashlib.sha256(), hashlib.sha256(self.MARK)

    def update(self, part) -> None:
        self.plain.update(part)
        self.marked.update(part)
        self.read += len(part)

    def add(self, lines: pa.BinaryArray) -> None:
        if self.begun:
            self.update(b"\n")
        self.begun = True
        self.update(memoryview(pc.binary_join(pa.ListArray.from_arrays([0, len(lines)], lines), b"\n")[0].as_buffer()))

    def row(self) -> tuple[str, int, str]:
        mark, newline = divmod(self.size - self.read, len(self.MARK))
        if mark not in (0, 1) or newline not in (0, 1):
            raise ValueError(f"{self.path}: {self.read} bytes were read of {self.size}")
        self.update(b"\n" * newline)
        return unquote(self.path), self.size, (self.marked if mark else self.plain).hexdigest()


def digest_lines(batches):
    """mapInArrow body over the lines (file_path, file_size, line) of files, each whole and in order: (path, length, sha256)."""
    file = None
    for batch in batches:
        paths, sizes, lines = batch.column("file_path"), batch.column("file_size"), batch.column("line")
        code = paths.dictionary_encode().indices.to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
        for low, high in zip(cuts, cuts[1:]):
            if low == high:
                continue
            if file is None or file.path != paths[low].as_py():
                if file is not None:
                    yield digest_row(file)
                file = Digest(paths[low].as_py(), sizes[low].as_py())
            file.add(lines.slice(low, high - low))
    if file is not None:
        yield digest_row(file)


def digest_row(file: Digest) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x]) for x in file.row()], names=["path", "length", "sha256"])
