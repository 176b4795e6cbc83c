"""An inverted-file index over vectors, with product-quantised residuals.

Centroids and code books are fitted on a bounded sample; every vector of the corpus is indexed. The table is partitioned by
list, so Spark reads only the lists that some question probes. Codes rank the members of those lists, the best of them
are scored exactly, and a question with fewer than k hits is searched exactly.

Each row also keeps how far its code is from the vector, and each list its radius: with ``exact=True`` these bounds tell
which lists and members can reach the k best, and the result is that of ``dense_topk``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexflow.functions.workers import encode_vectors, kmeans, nearest_center, scan_codes
from codexflow.operators.dense import dense_topk
from codexflow.operators.lexical import SCORE_DIGITS, rank
from codexflow.session import cut_lineage


@dataclass
class VectorIndex:
    """members: (id, code, error, vec, list), partitioned by list. radius: of each list, the farthest member's distance."""

    members: DataFrame
    centroids: np.ndarray
    books: np.ndarray  # (parts, codes, numbers of a part)
    radius: np.ndarray


def build(corpus: DataFrame, path: str, lists: int = 64, parts: int = 8, codes: int = 64, sample: int = 50_000, seed: int = 7) -> VectorIndex:
    """Index ``corpus`` (id, vec; all of one length that ``parts`` divides) below ``path``.

    At most ``sample`` vectors, drawn by a hash of their id, are fitted on the driver.
    """
    spark = corpus.sparkSession
    drawn = corpus.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").toArrow().column("vec").to_pylist()
    points = np.array(drawn, dtype=np.float64)
    random = np.random.default_rng(seed)
    centroids = kmeans(points, lists, random)
    rest = points - centroids[nearest_center(points, centroids)]
    books = np.stack([kmeans(np.ascontiguousarray(p), codes, random) for p in np.split(rest, parts, axis=1)])
    kind = corpus.schema["id"].dataType.simpleString()
    coded = corpus.select("id", "vec").mapInPandas(encode_vectors(centroids, books), f"id {kind}, vec array<double>, code binary, error double, list int")
    coded.repartition("list").write.mode("errorifexists").partitionBy("list").parquet(f"{path}/members")
    far = spark.read.parquet(f"{path}/members")
    center = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, center array<double>")
    apart = F.sqrt(F.aggregate(F.zip_with("vec", "center", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    radius = far.join(F.broadcast(center), "list").groupBy("list").agg(F.max(apart).alias("radius"))  # one row per list
    radius = {r["list"]: r["radius"] for r in radius.collect()}
    rows = [("centroid", i, c.tolist(), radius.get(i, -1.0)) for i, c in enumerate(centroids)]
    rows += [(f"book {p}", i, c.tolist(), 0.0) for p, book in enumerate(books) for i, c in enumerate(book)]
    spark.createDataFrame(rows, "what string, place int, numbers array<double>, radius double").write.parquet(f"{path}/model")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> VectorIndex:
    rows: dict = {}
    for r in spark.read.parquet(f"{path}/model").collect():  # lists + parts x codes rows
        rows.setdefault(r["what"], []).append((r["place"], r["numbers"], r["radius"]))
    ordered = {what: sorted(found) for what, found in rows.items()}
    centers = ordered.pop("centroid")
    books = np.array([[n for _, n, _ in ordered[f"book {p}"]] for p in range(len(ordered))])
    return VectorIndex(spark.read.parquet(f"{path}/members"), np.array([n for _, n, _ in centers]), books, np.array([r for _, _, r in centers]))


def probed_lists(index: VectorIndex, vectors: np.ndarray, probe: int) -> np.ndarray:
    """(questions x lists) of bool: the ``probe`` lists whose bound on the inner product is highest, of those that have members."""
    bound = vectors @ index.centroids.T + np.linalg.norm(vectors, axis=1)[:, None] * np.maximum(index.radius, 0)
    bound[:, index.radius < 0] = -np.inf
    order = np.argsort(-bound, axis=1, kind="stable")[:, :probe]
    chosen = np.zeros(bound.shape, dtype=bool)
    np.put_along_axis(chosen, order, True, axis=1)
    return chosen & (index.radius >= 0)


def search(index: VectorIndex, questions: DataFrame, k: int, probe: int = 16, refine: int = 8, exact: bool = False) -> DataFrame:
    """(qid, id, score, rank): the k largest inner products found among each question's ``probe`` lists.

    Codes choose ``refine`` x k members per question, which are scored exactly. With ``exact`` all lists are probed and all
    members that the codes do not rule out are scored: one scan finds each question's k-th low bound, another gives out what reaches it. Questions (qid, qvec) travel to the scan; their number is to
    be such that the vectors fit there, as in ``dense_topk``.
    """
    asked = cut_lineage(questions.select("qid", "qvec"), "question-vectors").toArrow().to_pydict()
    if not asked["qid"]:
        return dense_topk(questions, index.members.select("id", "vec"), k)
    vectors = np.array(asked["qvec"], dtype=np.float64)
    chosen = probed_lists(index, vectors, len(index.centroids) if exact else probe)
    wanted = np.flatnonzero(chosen.any(axis=0)).tolist()
    members = index.members.filter(F.col("list").isin(wanted))  # partitions of other lists are not read
    kind, asked_kind = (t.simpleString() for t in (index.members.schema["id"].dataType, questions.schema["qid"].dataType))
    codes, result = members.select("id", "code", "error", "list"), f"qid {asked_kind}, id {kind}, list int, low double, high double"
    keep = k if exact else refine * k
    scan = lambda floors=None: codes.mapInPandas(
        scan_codes(asked["qid"], vectors, chosen, index.centroids, index.books, keep, exact, floors), result)
    found = rank(scan(), keep, [F.desc("low"), F.asc("id")])
    if exact:
        last = found.filter(F.col("rank") == k).select("qid", "low").toArrow().to_pydict()  # a number per question
        floor = dict(zip(last["qid"], last["low"]))
        found = scan(np.array([floor.get(q, -np.inf) for q in asked["qid"]]))
    found = cut_lineage(found.select("qid", "id", "list"), "candidates")
    product = F.aggregate(F.zip_with("qvec", "vec", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    scored = (found.join(members.select("id", "vec", "list"), ["list", "id"]).join(questions.select("qid", "qvec"), "qid")
              .select("qid", "id", (F.round(product, SCORE_DIGITS) + 0.0).alias("score")))
    best = cut_lineage(rank(scored, k, [F.desc("score"), F.asc("id")]), "index-hits")
    full = best.groupBy("qid").count().filter(F.col("count") >= k)
    short = questions.select("qid", "qvec").join(full, "qid", "left_anti")
    return best.join(full, "qid", "left_semi").unionByName(dense_topk(short, index.members.select("id", "vec"), k).select(*best.columns))
