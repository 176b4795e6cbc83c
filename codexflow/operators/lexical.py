"""BM25 over many chunks for many questions at once."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codexflow.functions import fixed_values as V
from codexflow.functions.text import tokens
from codexflow.functions.workers import scan_scores, scan_terms
from codexflow.session import cut_lineage

SCORE_DIGITS = 6
BLOCK = 1_024  # question vectors that meet a batch of the corpus at once, inside a task
ROWS_AT_ONCE = 4_000_000  # question terms, some 100 MB, that travel to one scan


@dataclass
class Bm25Index:
    """terms: (term, df, idf), a written table. documents: (id, dl, toks)."""

    n_docs: int
    avgdl: float
    terms: DataFrame
    documents: DataFrame

    def save(self, path: str) -> Bm25Index:
        spark = self.terms.sparkSession
        corpus = spark.createDataFrame([(self.n_docs, self.avgdl)], "n_docs bigint, avgdl double")
        for name, df in (("corpus", corpus), ("terms", self.terms), ("documents", self.documents)):
            df.write.mode("errorifexists").parquet(f"{path}/{name}")
        return load_index(spark, path)


def load_index(spark: SparkSession, path: str) -> Bm25Index:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    n_docs, avgdl = read("corpus").first()
    return Bm25Index(n_docs, avgdl, read("terms"), read("documents"))


def build_index(chunks: DataFrame, id_col: str = "doc_id", text: str = "text") -> Bm25Index:
    """One pass over the texts: a document adds one to each of its terms, and its
    length to the NULL term. The counts go to a written table."""
    documents = chunks.select(F.col(id_col).alias("id"), tokens(F.col(text)).alias("toks")).select(
        "id", F.size("toks").alias("dl"), "toks")
    one = lambda term, n: F.struct(term.alias("term"), n.cast("bigint").alias("n"))
    length = one(F.lit(None).cast("string"), F.coalesce(F.greatest("dl", F.lit(0)), F.lit(0)))
    seen = F.transform(F.array_distinct(F.coalesce("toks", F.array().cast("array<string>"))), lambda t: one(t, F.lit(1)))
    rows = documents.select(F.explode_outer(F.concat(seen, F.array(length))).alias("r")).select("r.*")
    counted = cut_lineage(rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("n")), "bm25-terms")
    whole = counted.filter("term IS NULL").first()
    n_docs, total = (whole["df"], whole["n"]) if whole else (0, 0)
    raw = F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    named = counted.filter("term IS NOT NULL")
    floor = V.BM25_EPSILON * (named.agg(F.avg(raw)).first()[0] or 0.0)
    terms = named.select("term", "df", F.when(raw < 0, F.lit(floor)).otherwise(raw).alias("idf"))
    return Bm25Index(n_docs, total / n_docs if n_docs else 0.0, terms, documents)


def query_terms(questions: DataFrame, qid: str = "qid", question: str = "question") -> DataFrame:
    """(qid, term, qtf): a repeated token counts as often as it occurs."""
    # the outer form spares the size filter that Spark infers for a plain explode, which would tokenize twice
    rows = questions.select(F.col(qid).alias("qid"), F.explode_outer(tokens(F.col(question))).alias("term"))
    return rows.filter("term IS NOT NULL").groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def in_parts(rows: DataFrame, size: int, most: int, key: str = "qid"):
    """The rows by a hash of the key, in as many parts as keep ``size`` under ``most`` in each: one, unless they are very many."""
    parts = max(1, -(-size // most))
    for part in range(parts):
        yield rows.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == part)


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(schema))


def score(index: Bm25Index, questions: DataFrame, k: int | None = None, most: int = ROWS_AT_ONCE) -> DataFrame:
    """(qid, id, score) of all chunks that share a term with each question, or of the ``k`` best of them.

    A chunk is scored in its own row for all questions: their weights travel to one scan, and
    neither postings nor (question, chunk) pairs are shuffled. Without ``k`` the pairs leave the scan
    as they come, with it each task keeps k rows per question. Only questions of more than ``most``
    terms in all need another scan.
    """
    weighted = query_terms(questions).join(index.terms, "term").select("qid", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
    return score_weighted(index, weighted, k, most)


def score_weighted(index: Bm25Index, weights: DataFrame, k: int | None, most: int = ROWS_AT_ONCE) -> DataFrame:
    """``score`` for questions given as (qid, term, weight), the weights times idf."""
    weighted = cut_lineage(weights, "question-terms")
    kind = index.documents.schema["id"].dataType.simpleString()
    asked = weighted.schema["qid"].dataType.simpleString()
    result = f"qid {asked}, id {kind}, score double"
    documents = index.documents.filter(F.size("toks") > 0).select("id", "dl", F.array_join("toks", "\n").alias("text"))
    bm25 = index.avgdl, V.BM25_K1, V.BM25_B, SCORE_DIGITS
    out = None
    for part in in_parts(weighted, weighted.count(), most):
        rows = part.toArrow().to_pydict()  # ``most`` rows or about
        asked_terms = rows["qid"], rows["term"], rows["weight"]
        if k is None:
            found = documents.mapInArrow(scan_scores(asked_terms, *bm25, arrow_schema(result)), result)
        else:
            found = documents.mapInPandas(scan_terms(asked_terms, k, *bm25), result)
        out = found if out is None else out.unionByName(found)
    return out if k is None else rank(out, k, [F.desc("score"), F.asc("id")]).drop("rank")


def rank(scored: DataFrame, k: int, order: list, by: str = "qid") -> DataFrame:
    """Top k per question. Spark keeps k rows per question in each task before
    the shuffle (WindowGroupLimit), so a question matching everything is safe."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(
        F.col("rank") <= k)


def topk(index: Bm25Index, questions: DataFrame, k: int = 2 * V.TOP_K) -> DataFrame:
    positive = score(index, questions, k).filter("score > 0")
    return rank(positive, k, [F.desc("score"), F.asc("id")])
