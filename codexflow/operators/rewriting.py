"""Better questions: completion from the conversation, expansion by feedback, several variants fused, evidence compressed.

Expansion is a relevance model (Lavrenko and Croft, 2001) interpolated with the question (RM3): the first hits of a
question stand for what it is about, and their terms weigh by how much of a hit they make up and how well it scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexflow.functions import fixed_values as V
from codexflow.functions.arrays import let
from codexflow.functions.text import tokens
from codexflow.operators import fusion, lexical
from codexflow.operators.hierarchy import sentences
from codexflow.session import cut_lineage

DIGITS = 6


# ------------------------------------------------------------ from history

def content_terms(text: Column, least: int = 4) -> Column:
    """Distinct terms with at least ``least`` letters, in order, without the marks around them."""
    bare = F.transform(tokens(text), lambda t: F.regexp_replace(t, r"(?U)^\W+|\W+$", ""))
    return F.filter(F.array_distinct(bare), lambda t: (F.length(t) >= least) & ~t.isin(V.POINTING_WORDS))


def is_vague(text: Column, least_terms: int = 4) -> Column:
    """A question that points back, or that has fewer than ``least_terms`` terms of its own."""
    bare = F.transform(tokens(text), lambda t: F.regexp_replace(t, r"(?U)^\W+|\W+$", ""))
    return F.exists(bare, lambda t: t.isin(V.POINTING_WORDS)) | (F.size(content_terms(text)) < least_terms)


def complete_questions(messages: DataFrame, back: int = 4, keep: int = 8, least_terms: int = 4) -> DataFrame:
    """(conv_id, turn, question, vague, rewritten) for the user's turns of ``messages`` (conv_id, turn, role, text).

    A vague question gets up to ``keep`` terms of the user's last question within the ``back`` turns before it. Turns
    find each other by (conversation, turn), so a conversation of very many turns is no single task; of turns
    that occur twice the smaller text counts. Null texts are empty.
    """
    own = messages.filter("role = 'user'").groupBy("conv_id", "turn").agg(F.min(F.coalesce("text", F.lit(""))).alias("question"))
    ahead = F.explode(F.sequence(F.col("turn") + 1, F.col("turn") + back)).alias("turn")
    earlier = own.select("conv_id", F.col("turn").alias("at"), content_terms(F.col("question")).alias("terms"), ahead)
    last = earlier.groupBy("conv_id", "turn").agg(F.max_by("terms", "at").alias("terms"))  # ``back`` rows at most
    told = own.join(last, ["conv_id", "turn"], "left").withColumn("vague", is_vague(F.col("question"), least_terms))
    added = F.slice(F.array_except(F.coalesce("terms", F.array().cast("array<string>")), content_terms(F.col("question"))), 1, keep)
    whole = F.when(F.col("vague") & (F.size(added) > 0), F.concat_ws(" ", "question", F.array_join(added, " "))).otherwise(F.col("question"))
    return told.select("conv_id", "turn", "question", "vague", whole.alias("rewritten"))


# ------------------------------------------------------------ by feedback

def hit_terms(index: lexical.Bm25Index, hits: DataFrame, least_idf: float) -> DataFrame:
    """(qid, id, rank, term, weight): P(term | hit) P(hit | question) for the terms of at least ``least_idf``.

    Only the hits' own token lists are fetched; P(hit | question) is the hit's share of the scores.
    """
    total = hits.groupBy("qid").agg(F.sum("score").alias("total"))
    found = hits.join(total, "qid").select("qid", "id", "rank", (F.col("score") / F.col("total")).alias("share"))
    rows = found.join(index.documents, "id").select("qid", "id", "rank", "share", "dl", F.explode("toks").alias("term"))
    counted = rows.groupBy("qid", "id", "rank", "share", "dl", "term").agg(F.count("*").alias("tf"))
    telling = index.terms.filter(F.round("idf", DIGITS) >= least_idf).select("term")
    return counted.join(telling, "term").select("qid", "id", "rank", "term", (F.col("tf") / F.col("dl") * F.col("share")).alias("weight"))


def relevance_model(found: DataFrame, keep: int) -> DataFrame:
    """(qid, term, weight): the ``keep`` heaviest terms of a question's hits, their weights adding up to 1."""
    summed = found.groupBy("qid", "term").agg(F.round(F.sum("weight"), 9).alias("weight"))
    best = lexical.rank(summed, keep, [F.desc("weight"), F.asc("term")])
    return best.join(best.groupBy("qid").agg(F.sum("weight").alias("total")), "qid").select("qid", "term", (F.col("weight") / F.col("total")).alias("weight"))


def rewrite(index: lexical.Bm25Index, questions: DataFrame, hits: int = 10, keep: int = 12, mix: float = 0.5, least_idf: float = 1.0) -> DataFrame:
    """(qid, term, weight): the question's terms and those of its first ``hits``, weights adding up to 1.

    A term weighs ``1 - mix`` times its share of the question plus ``mix`` times its share of the relevance model.
    A question without hits keeps its own terms alone; one without terms gives no row.
    """
    first = cut_lineage(lexical.topk(index, questions, hits), "feedback-hits")
    model = relevance_model(hit_terms(index, first, least_idf), keep)
    own = lexical.query_terms(questions)
    length = own.groupBy("qid").agg(F.sum("qtf").alias("total"))
    asked = own.join(length, "qid").select("qid", "term", (F.col("qtf") / F.col("total")).alias("own"))
    # a question whose hits hold no telling term stays as it was asked
    told = model.select("qid").distinct().withColumn("told", F.lit(True))
    both = asked.join(model, ["qid", "term"], "full").join(told, "qid", "left")
    share = F.when(F.coalesce("told", F.lit(False)), F.lit(mix)).otherwise(0.0)
    weight = (1 - share) * F.coalesce("own", F.lit(0.0)) + share * F.coalesce("weight", F.lit(0.0))
    return both.select("qid", "term", F.round(weight, DIGITS).alias("weight"))


def topk_weighted(index: lexical.Bm25Index, weights: DataFrame, k: int = 2 * V.TOP_K) -> DataFrame:
    """(qid, id, score, rank) by BM25 with weighted question terms (qid, term, weight)."""
    scored = lexical.score_weighted(index, weights.join(index.terms, "term").select("qid", "term", (F.col("weight") * F.col("idf")).alias("weight")), k)
    return lexical.rank(scored.filter("score > 0"), k, [F.desc("score"), F.asc("id")])


# --------------------------------------------------------------- variants

def variants(index: lexical.Bm25Index, questions: DataFrame, n: int = 3, hits: int = 10, keep: int = 12, add: int = 4, least_idf: float = 1.0) -> DataFrame:
    """(qid, variant, question): the question itself (0) and up to ``n`` variants that cover its feedback terms.

    Greedy maximal coverage: each variant follows the hit whose terms, of those no variant has yet, weigh most, and adds
    the ``add`` heaviest of them to the question. Hits and terms of a question are one row, at most ``hits`` x ``keep``.
    """
    first = cut_lineage(lexical.topk(index, questions, hits), "feedback-hits")
    found = cut_lineage(hit_terms(index, first, least_idf), "hit-terms")
    model = relevance_model(found, keep)
    held = found.join(model.select("qid", "term", F.round("weight", DIGITS).alias("share")), ["qid", "term"])
    term = F.struct((-F.col("share")).alias("less"), "term")
    rows = (held.groupBy("qid", "rank").agg(F.array_sort(F.collect_list(term)).alias("terms"))
            .groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "terms"))).alias("hits")))
    state = rows.select("qid", "hits", F.array().cast("array<string>").alias("used"), F.array().cast("array<array<string>>").alias("variants"))
    for _ in range(n):
        fresh = lambda h: F.filter(h["terms"], lambda t: ~F.array_contains("used", t["term"]))
        gains = F.transform("hits", lambda h: let(fresh(h), lambda f: F.struct(
            F.round(F.aggregate(f, F.lit(0.0), lambda s, t: s + t["less"]), DIGITS).alias("less"), h["rank"].alias("rank"),
            F.slice(F.transform(f, lambda t: t["term"]), 1, add).alias("added"))))
        state = state.withColumn("best", F.array_min(F.filter(gains, lambda g: F.size(g["added"]) > 0)))
        added = F.coalesce(F.col("best.added"), F.array().cast("array<string>"))
        state = state.select("qid", "hits", F.concat("used", added).alias("used"),
                             F.when(F.size(added) > 0, F.concat("variants", F.array(added))).otherwise(F.col("variants")).alias("variants"))
    extended = questions.join(state.select("qid", "variants"), "qid", "left")
    own = F.array(F.col("question"))
    more = F.transform(F.coalesce("variants", F.array().cast("array<array<string>>")), lambda v: F.concat_ws(" ", F.col("question"), F.array_join(v, " ")))
    return extended.select("qid", F.posexplode(F.concat(own, more)).alias("variant", "question"))


def multi_query_retrieve(index: lexical.Bm25Index, questions: DataFrame, n: int = 3, k: int = 2 * V.TOP_K, top_k: int = V.TOP_K, **feedback) -> DataFrame:
    """(qid, id, score, rank): the hits of a question and its variants, fused by reciprocal rank.

    All variants of all questions are searched in one corpus scan.
    """
    asked = cut_lineage(variants(index, questions, n, **feedback), "variants")
    key = F.struct(F.col("qid").alias("qid"), F.col("variant").alias("variant"))
    named = asked.select(F.to_json(key).alias("qid"), "question", F.col("qid").alias("asked"))
    found = lexical.topk(index, named.select("qid", "question"), k)
    hits = found.join(named.select("qid", "asked"), "qid").select(F.col("asked").alias("qid"), "id", F.col("rank").alias("branch_rank"))
    return fusion.fuse_rrf(hits).filter(F.col("rank") <= top_k)


# ------------------------------------------------------------- compression

def best_run(values: Column) -> Column:
    """(sum, first, last) of the contiguous run of largest sum, one fold over the array; null if none is above 0.

    Equal sums: the run that ends first; of those the shortest.
    """
    state = lambda at, run, start, total, first, last: F.struct(
        at.alias("at"), run.alias("run"), start.alias("start"), total.alias("sum"), first.alias("first"), last.alias("last"))
    zero, none = F.lit(0).cast("long"), F.lit(-1).cast("long")

    def step(s, v):
        fresh = s["run"] <= 0
        run, start = F.when(fresh, v).otherwise(s["run"] + v), F.when(fresh, s["at"]).otherwise(s["start"])
        better = run > s["sum"]
        return state(s["at"] + 1, run, start, F.when(better, run).otherwise(s["sum"]),
                     F.when(better, start).otherwise(s["first"]), F.when(better, s["at"]).otherwise(s["last"]))

    told = lambda s: F.when(s["sum"] > 0, F.struct(s["sum"].alias("sum"), s["first"].alias("first"), s["last"].alias("last")))
    return F.aggregate(values, state(zero, zero, zero, zero, none, none), step, told)


def compress_context(hits: DataFrame, cost: int = 1, gain: int = 2) -> DataFrame:
    """hits (qid, id, question, content, ...) with ``first``, ``last`` and ``compressed``: the run of sentences that serves the question best.

    A sentence is worth ``gain`` for each distinct question term in it, less ``cost``; the run of largest worth stays. A
    hit that shares no term keeps its whole content. The run is found in the hit's own row, in time linear in its sentences.
    """
    asked = F.array_distinct(tokens(F.col("question")))
    parts = hits.withColumn("_sentences", sentences(F.coalesce("content", F.lit(""))))
    worth = let(asked, lambda q: F.transform("_sentences", lambda s: (gain * F.size(F.array_intersect(q, tokens(s))) - cost).cast("long")))
    run = parts.withColumn("_run", best_run(worth))
    text = F.array_join(F.slice("_sentences", (F.col("_run.first") + 1).cast("int"), (F.col("_run.last") - F.col("_run.first") + 1).cast("int")), " ")
    return run.withColumns({"first": F.col("_run.first"), "last": F.col("_run.last"),
                            "compressed": F.when(F.col("_run").isNull(), F.col("content")).otherwise(text)}).drop("_sentences", "_run")
