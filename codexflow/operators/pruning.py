"""BM25 top k that reads only the blocks which can hold a hit.

Documents are stored in blocks of alike ones, and a small table keeps, for every block and term, the largest score part
the term has in it (block-max index, Ding and Suel, 2011). For a question, the sum of its terms' largest parts bounds every
score of the block. The most promising blocks are scored first; their k-th score then rules out the blocks whose
bound does not reach it. What is left is scored in full, so the rows are those of ``lexical.topk``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexflow.functions import fixed_values as V
from codexflow.functions.workers import block_tops, scan_bounds, weighty_terms
from codexflow.operators import lexical
from codexflow.session import cut_lineage

BLOCKS_AT_ONCE = 1_000_000  # block numbers, 8 MB, that travel to the scan
TERMS_AT_ONCE = 200_000  # terms with their weights, some 5 MB, that travel to the documents


@dataclass
class BlockIndex:
    """bounds: (block, terms, tops); a block read in two parts has a row for each. corpus.documents: (block, id, dl, toks), sorted by block."""

    corpus: lexical.Bm25Index
    bounds: DataFrame


def save_blocks(index: lexical.Bm25Index, path: str, size: int = 128) -> BlockIndex:
    """Write the block tables of a BM25 index below ``path``.

    Documents that share their weightiest term are neighbours; ``size`` of them make a block. Documents without a
    term are in no block: no question finds them.
    """
    bm25 = index.avgdl, V.BM25_K1, V.BM25_B
    rows = index.documents.filter(F.size("toks") > 0).select("id", "dl", "toks")
    common = _common_terms(index.terms).toArrow().combine_chunks()
    term, idf = (pa.array([], pa.string()), []) if not common.num_rows else (common["term"].combine_chunks(), common["idf"].to_numpy())
    result = f"id {rows.schema['id'].dataType.simpleString()}, term string, part double"
    parts = rows.mapInArrow(weighty_terms(term, np.array(idf, dtype=np.float64), *bm25, lexical.arrow_schema(result)), result)
    heavy = parts.join(index.terms.select("term", "idf"), "term").groupBy("id").agg(F.max_by("term", F.struct(F.col("idf") * F.col("part"), "term")).alias("subject"))
    # a document moves as one text, a third of its list; no term holds white space
    texts = rows.select("id", "dl", F.array_join("toks", "\n").alias("text"))
    placed = (texts.join(heavy, "id").repartitionByRange("subject", "id").sortWithinPartitions("subject", "id")
              .withColumn("place", F.monotonically_increasing_id()))  # partition, and place in it
    block = F.shiftright("place", 33) * (1 << 32) + F.floor(F.col("place").bitwiseAND((1 << 33) - 1) / size)
    placed.select(block.alias("block"), "id", "dl", F.split("text", "\n").alias("toks")).write.mode("errorifexists").parquet(f"{path}/documents")
    stored = index.terms.sparkSession.read.parquet(f"{path}/documents")
    result = "block long, terms array<string>, tops array<double>"
    tops = stored.select("block", "dl", "toks").mapInArrow(block_tops(*bm25, lexical.arrow_schema(result)), result)
    tops.write.parquet(f"{path}/bounds")
    spark = index.terms.sparkSession
    spark.createDataFrame([(index.n_docs, index.avgdl)], "n_docs bigint, avgdl double").write.parquet(f"{path}/corpus")
    index.terms.write.parquet(f"{path}/terms")
    return load_blocks(spark, path)


def _common_terms(terms: DataFrame) -> DataFrame:
    """(term, idf): the terms in most documents, ``TERMS_AT_ONCE`` at most, cut at a power of two of documents."""
    power = F.floor(F.log2("df"))
    total, least = 0, 64
    for row in sorted(terms.groupBy(power.alias("power")).count().collect(), key=lambda r: -r["power"]):  # at most 63 rows
        total += row["count"]
        if total > TERMS_AT_ONCE:
            break
        least = row["power"]
    return terms.filter(power >= least).select("term", "idf")


def load_blocks(spark: SparkSession, path: str) -> BlockIndex:
    return BlockIndex(lexical.load_index(spark, path), spark.read.parquet(f"{path}/bounds"))


def _scored(index: BlockIndex, blocks: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    near = F.broadcast(blocks) if blocks.count() <= BLOCKS_AT_ONCE else blocks
    corpus = lexical.Bm25Index(index.corpus.n_docs, index.corpus.avgdl, index.corpus.terms, index.corpus.documents.join(near, "block", "left_semi"))
    return lexical.score_weighted(corpus, weights, k).filter("score > 0")


def pruned_topk(index: BlockIndex, questions: DataFrame, k: int = 2 * V.TOP_K, probe: int = 4) -> tuple[DataFrame, DataFrame]:
    """(hits, blocks): the rows of ``lexical.topk``, and the blocks (block) that were read for them.

    ``probe`` blocks per question are scored first. A block is read if any question's bound reaches its k-th score.
    """
    weighted = lexical.query_terms(questions).join(index.corpus.terms, "term").select("qid", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
    weighted = cut_lineage(weighted, "question-terms")
    asked = weighted.schema["qid"].dataType.simpleString()
    parts = list(lexical.in_parts(weighted, weighted.count(), lexical.ROWS_AT_ONCE))

    def bound(floors: dict, best: int | None) -> DataFrame:
        out = None
        for part in parts:
            rows = part.toArrow().to_pydict()  # ``ROWS_AT_ONCE`` rows or about
            result = f"qid {asked}, block long, bound double" if best else "block long"
            scan = scan_bounds((rows["qid"], rows["term"], rows["weight"]), floors, best, lexical.SCORE_DIGITS, lexical.arrow_schema(result))
            found = index.bounds.select("block", "terms", "tops").mapInArrow(scan, result)
            out = found if out is None else out.unionByName(found)
        return out

    promising = lexical.rank(bound({}, probe), probe, [F.desc("bound"), F.asc("block")])
    first = cut_lineage(promising.select("block").distinct(), "probed-blocks")
    scores = lexical.rank(_scored(index, first, weighted, k), k, [F.desc("score"), F.asc("id")])
    floors = scores.filter(F.col("rank") == k).select("qid", "score").toArrow().to_pydict()  # a number per question, fewer than its terms
    needed = cut_lineage(bound(dict(zip(floors["qid"], floors["score"])), None).distinct(), "read-blocks")
    return lexical.rank(_scored(index, needed, weighted, k), k, [F.desc("score"), F.asc("id")]), needed
