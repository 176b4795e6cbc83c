"""Nearest neighbours by adaptive dimension scan (operator 2).

Vectors get one more component that makes the largest inner product the smallest distance, and every vector
goes to the inverted list of its nearest centroid. A query meets the lists with the nearest centroids. In a
list, vectors are rotated and held in column blocks: after each block a hypothesis test drops the candidates
whose partial distance is already too large, at the chosen significance, to stay among the k nearest.
Survivors are scored exactly on the original vectors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codexflow.llm.common import Shared, by_value, is_usable, map_slices, written

by_value(__name__)

COLUMNS = 16  # dimensions read between two tests
QUERIES_AT_ONCE = 256
HELD = 20_000  # queries whose best rows a task keeps before handing them on


@dataclass
class Index:
    """Centroids of the augmented vectors, the rotation, and what the tests need. Its size is set by ``lists``."""

    centroids: np.ndarray
    rotation: np.ndarray
    largest: float  # longest vector, squared
    strictness: float

    def augmented(self, vectors, query: bool) -> np.ndarray:
        x = np.array(vectors, dtype=np.float64)
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.largest - (x * x).sum(axis=1)))
        return np.column_stack([x, rest])

    def nearest_first(self, augmented: np.ndarray) -> np.ndarray:
        far = (self.centroids ** 2).sum(axis=1) - 2 * augmented @ self.centroids.T
        return np.argsort(far, axis=1, kind="stable")

    def survivors(self, query: np.ndarray, block: np.ndarray, k: int, worst: float) -> np.ndarray:
        """Positions in ``block`` (dimensions x candidates, rotated) that no test abandons.

        ``worst`` is the distance to beat, infinite while fewer than k rows are known.
        """
        dims, n = block.shape
        alive, partial = np.arange(n), np.zeros(n)
        for lo in range(0, dims, COLUMNS):
            hi = min(dims, lo + COLUMNS)
            part = block[lo:hi] if len(alive) == n else block[lo:hi, alive]
            partial = partial + np.square(part - query[lo:hi, None]).sum(axis=0)
            if lo == 0 and n > k:  # the k that look best are measured in full: they bound the rest
                trial = np.argpartition(partial, k - 1)[:k]
                worst = min(worst, np.square(block[:, trial] - query[:, None]).sum(axis=0).max())
            slack = 1.0 if hi == dims else (1 + self.strictness / math.sqrt(hi)) ** 2 * hi / dims
            keep = partial <= worst * slack * (1 + 1e-9) + 1e-9
            if not keep.all():
                alive, partial = alive[keep], partial[keep]
        return alive


def train(vectors: DataFrame, lists: int, bound: int, strictness: float, seed: int = 11, rounds: int = 8) -> Index | None:
    """K-means on at most ``bound`` rows drawn by a hash of the id; None for an empty table."""
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    largest = vectors.agg(F.max(square).alias("m")).first()["m"]
    if largest is None:
        return None
    drawn = vectors.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(bound).toPandas()
    index = Index(np.zeros((1, 1)), np.zeros((1, 1)), largest, strictness)
    x, random = index.augmented(drawn["vector"].tolist(), query=False), np.random.default_rng(seed)
    centroids = x[random.permutation(len(x))[:lists]]
    for _ in range(rounds):
        near = np.argmin((centroids ** 2).sum(axis=1) - 2 * x @ centroids.T, axis=1)
        order = np.argsort(near, kind="stable")
        sums = np.zeros_like(centroids)
        np.add.at(sums, near[order], x[order])
        n = np.bincount(near, minlength=len(centroids))[:, None]
        centroids = np.where(n > 0, sums / np.maximum(n, 1), centroids)
    index.centroids = centroids
    index.rotation = np.linalg.qr(random.normal(size=(x.shape[1], x.shape[1])))[0]
    return index


def scan_cells(shared, k: int, id_type):
    """Rows sorted by (list, block, queries last) in; each query's k best of what the task has seen out."""
    schema = to_arrow_schema(T.StructType([T.StructField("query_id", id_type), T.StructField("id", id_type), T.StructField("score", T.DoubleType())]))

    def run(batches):
        index = shared.value
        best: dict = {}  # query -> (scores, ids), best first
        cell, ids, vectors, block, asked = None, [], [], None, []

        def answer():
            nonlocal block
            if not asked or not ids:
                asked.clear()
                return
            if block is None:
                x = np.array(vectors, dtype=np.float64)
                block = (np.array(ids), x, np.ascontiguousarray((index.augmented(x, query=False) @ index.rotation).T))
            names, originals, rotated = block
            q = np.array([v for _, v in asked], dtype=np.float64)
            for query_id, plain, turned in zip((i for i, _ in asked), q, index.augmented(q, query=True) @ index.rotation):
                known = best.get(query_id)
                reach = plain @ plain + index.largest
                worst = reach - 2 * known[0][k - 1] if known is not None and len(known[0]) >= k else math.inf
                at = index.survivors(turned, rotated, k + 1, worst)  # one more: the query's own row may be here
                at = at[names[at] != query_id]
                if not len(at):
                    continue
                scores, found = (originals[at] * plain).sum(axis=1), names[at]
                if known is not None:
                    scores, found = np.concatenate([known[0], scores]), np.concatenate([known[1], found])
                order = np.lexsort((found, -scores))[:k]
                best[query_id] = (scores[order], found[order])
            asked.clear()

        def hand_on():
            rows = [(q, i, s) for q, (scores, found) in best.items() for s, i in zip(scores.tolist(), found.tolist())]
            best.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            rows = batch.to_pydict()
            for number, part, is_query, row_id, vector in zip(*(rows[c] for c in ("list", "block", "is_query", "id", "vector"))):
                if cell != (number, part):
                    answer()
                    cell, ids, vectors, block = (number, part), [], [], None
                if is_query:
                    asked.append((row_id, vector))
                    if len(asked) >= QUERIES_AT_ONCE:
                        answer()
                        if len(best) >= HELD:
                            yield from hand_on()
                else:
                    ids.append(row_id)
                    vectors.append(vector)
        answer()
        yield from hand_on()

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, lists: int = 128, probe_share: float = 0.7, block: int = 4096,
           bound: int = 20_000, strictness: float = 2.1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, id, score): each query's k rows of largest inner product, ties to the smaller id.

    ``queries`` has the same two columns; a query's own row (the same id) is no candidate. The index covers
    every row: lists are cut into blocks of about ``block`` rows by a hash of the id, so a list that holds a
    third of all rows is searched by many tasks. Centroids come from at most ``bound`` rows. Where the data
    have no clusters a small share of the lists holds few of the neighbours, hence the large ``probe_share``;
    a probed list is cheap, as most of its rows are abandoned after the first columns.

    Rows with a null id, or a vector that is null, zero, or holds null or non-finite components, take no part,
    nor do rows whose length differs from the most frequent one. Repeated rows are candidates as often as they
    come. Fewer candidates than k give fewer rows, an empty table none. Other columns are not read.
    """
    own = lambda df: df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).filter(F.col("id").isNotNull() & is_usable("vector"))
    spark, rows, asked = vectors.sparkSession, own(vectors), own(queries)
    id_type = rows.schema["id"].dataType
    out = T.StructType([T.StructField("query_id", id_type), T.StructField("id", id_type), T.StructField("score", T.DoubleType())])
    size = rows.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    if size is None:
        return spark.createDataFrame([], out).select("query_id", F.lit(0).alias("rank"), F.col("id").alias(id_col), "score")
    rows, asked = (df.filter(F.size("vector") == size["dims"]) for df in (rows, asked))
    index = train(rows, max(1, min(lists, size["n"] // 32)), bound, strictness)
    shared = Shared(spark, index)
    probes = max(1, math.ceil(len(index.centroids) * probe_share))

    with_lists = T.StructType([*rows.schema.fields, T.StructField("lists", T.ArrayType(T.IntegerType()))])

    def index_row():
        return lambda part: part | {"lists": shared.value.nearest_first(shared.value.augmented(part["vector"], False))[:, :1].tolist()}

    listed = written(map_slices(rows, index_row, with_lists, text_col=None).select("id", "vector", F.col("lists")[0].alias("list")), "lists")
    sizes = listed.groupBy("list").agg(F.count("*").alias("n"))
    held = np.zeros(len(index.centroids), dtype=np.int64)
    for r in sizes.collect():  # one row per centroid
        held[r["list"]] = r["n"]

    def probed_lists():
        def work(part):
            near = shared.value.nearest_first(shared.value.augmented(part["vector"], True))
            enough = (np.cumsum(held[near], axis=1) <= k).sum(axis=1) + 1  # lists that hold k rows beside the query's own
            return part | {"lists": [row[:max(probes, n)].tolist() for row, n in zip(near, enough)]}

        return work

    blocks = F.broadcast(sizes.select("list", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    candidates = listed.join(blocks, "list").select("list", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("is_query"), "id", "vector")
    probing = (map_slices(asked, probed_lists, with_lists, text_col=None).select("id", "vector", F.explode("lists").alias("list")).join(blocks, "list")
               .select("list", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.lit(True).alias("is_query"), "id", "vector"))
    dealt = candidates.unionByName(probing).repartition(F.col("list"), F.col("block")).sortWithinPartitions("list", "block", "is_query")
    found = dealt.mapInArrow(scan_cells(shared, k, id_type), out)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.select("query_id", place.alias("rank"), F.col("id").alias(id_col), "score").filter(F.col("rank") <= k)
