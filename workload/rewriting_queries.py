"""Question completion, expansion, variants and compressed evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexflow.functions import fixed_values as V
from codexflow.operators import lexical as X
from codexflow.operators import rewriting as R
from workload import retrieval_queries as Q
from workload import sqlviews as S
from workload import views as W
from workload.registry import query

POINTING = ", ".join(f"'{w}'" for w in V.POINTING_WORDS)
BARE = lambda text: rf"list_transform({S.tokens(text)}, lambda t: regexp_replace(t, '^[^\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_]+$', '', 'g'))"
# distinct in order of appearance
ORDERED = lambda items: f"list_filter({items}, lambda t, i: list_position({items}, t) = i)"
TERMS = lambda text: f"list_filter({ORDERED(BARE(text))}, lambda t: length(t) >= 4 AND t NOT IN ({POINTING}))"


@query("question_complete", f"""
WITH own AS (SELECT conv_id, turn, min(coalesce(text, '')) AS question FROM conversations WHERE role = 'user' GROUP BY ALL),
told AS (SELECT *, {TERMS('question')} AS terms, len(list_filter({BARE('question')}, lambda t: t IN ({POINTING}))) > 0 AS points FROM own),
last AS (SELECT t.conv_id, t.turn, arg_max(e.terms, e.turn) AS earlier FROM told t JOIN told e ON e.conv_id = t.conv_id AND e.turn BETWEEN t.turn - 4 AND t.turn - 1 GROUP BY ALL),
added AS (SELECT t.*, points OR len(terms) < 4 AS vague, list_filter(coalesce(earlier, []), lambda x: NOT list_contains(terms, x))[1:8] AS more
  FROM told t LEFT JOIN last USING (conv_id, turn))
SELECT conv_id, turn, question, vague, CASE WHEN vague AND len(more) > 0 THEN question || ' ' || array_to_string(more, ' ') ELSE question END AS rewritten FROM added""")
def question_complete(spark, sf):
    return R.complete_questions(W.table(spark, sf, "conversations"))


# the relevance model over the first ten hits
MODEL = f"""{Q.BM25},
fb AS (SELECT qid, id, rank, score / sum(score) OVER (PARTITION BY qid) AS share FROM sparse WHERE rank <= 10),
ht AS MATERIALIZED (SELECT qid, fb.id, rank, term, tf::DOUBLE / dl * share AS weight FROM fb JOIN tf ON tf.id = fb.id JOIN ln_ ON ln_.id = fb.id
  JOIN idf USING (term) WHERE round(idf, 6) >= 1),
rm AS (SELECT qid, term, round(sum(weight), 9) AS weight FROM ht GROUP BY ALL),
best_terms AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY weight DESC, term) AS place FROM rm QUALIFY place <= 12),
model AS MATERIALIZED (SELECT qid, term, weight / sum(weight) OVER (PARTITION BY qid) AS weight FROM best_terms)"""

REWRITTEN = f"""{MODEL},
asked AS (SELECT qid, term, qtf::DOUBLE / sum(qtf) OVER (PARTITION BY qid) AS own FROM qt),
mixed AS MATERIALIZED (SELECT qid, term, round(CASE WHEN qid IN (SELECT qid FROM model) THEN 0.5 * coalesce(own, 0) + 0.5 * coalesce(weight, 0) ELSE coalesce(own, 0) END, 6) AS weight
  FROM asked FULL JOIN model USING (qid, term))"""


@query("query_rewrite", f"WITH {REWRITTEN} SELECT qid, term, weight FROM mixed")
def query_rewrite(spark, sf):
    return R.rewrite(Q._index(spark, sf), W.questions(spark, sf))


@query("rewritten_topk", f"""WITH {REWRITTEN},
rescored AS (SELECT qid, tf.id, round(sum(weight * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score
  FROM mixed JOIN tf USING (term) JOIN idf USING (term) JOIN ln_ ON ln_.id = tf.id, st GROUP BY qid, tf.id)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM rescored WHERE score > 0 QUALIFY rank <= 10""")
def rewritten_topk(spark, sf):
    """The second retrieval that follows a rewritten question."""
    index = Q._index(spark, sf)
    return Q._ranked(R.topk_weighted(index, R.rewrite(index, W.questions(spark, sf)), 10), "score")


def _pick(n: int) -> str:
    """One greedy step: of the hits, the one whose unused terms weigh most."""
    return f"""
gain{n} AS (SELECT qid, rank, round(sum(share), 6) AS gain, list(term ORDER BY share DESC, term)[1:4] AS added
  FROM held WHERE NOT EXISTS (SELECT 1 FROM used{n - 1} u WHERE u.qid = held.qid AND list_contains(u.used, held.term)) GROUP BY qid, rank),
pick{n} AS (SELECT qid, added FROM gain{n} QUALIFY row_number() OVER (PARTITION BY qid ORDER BY gain DESC, rank) = 1),
used{n} AS MATERIALIZED (SELECT u.qid, list_concat(used, coalesce(added, [])) AS used, list_concat(chosen, CASE WHEN added IS NULL THEN [] ELSE [added] END) AS chosen
  FROM used{n - 1} u LEFT JOIN pick{n} USING (qid))"""


VARIANTS = f"""{MODEL},
held AS MATERIALIZED (SELECT qid, rank, term, round(model.weight, 6) AS share FROM ht JOIN model USING (qid, term)),
used0 AS (SELECT qid, []::VARCHAR[] AS used, []::VARCHAR[][] AS chosen FROM questions),{_pick(1)},{_pick(2)},{_pick(3)},
variants AS MATERIALIZED (SELECT qid, 0 AS variant, question FROM questions
  UNION ALL SELECT qid, variant, question || ' ' || array_to_string(chosen[variant], ' ') FROM (
    SELECT qid, chosen, question, unnest(generate_series(1, len(chosen))) AS variant FROM used3 JOIN questions USING (qid)))"""


@query("query_variants", f"WITH {VARIANTS} SELECT qid, CAST(variant AS INTEGER) AS variant, question FROM variants")
def query_variants(spark, sf):
    return R.variants(Q._index(spark, sf), W.questions(spark, sf))


@query("multi_query_retrieve", f"""WITH {VARIANTS},
vt AS MATERIALIZED (SELECT qid, variant, term, count(*) AS qtf FROM (SELECT qid, variant, unnest({S.tokens('question')}) AS term FROM variants) GROUP BY ALL),
vs AS MATERIALIZED (SELECT qid, variant, tf.id, round(sum(qtf * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score
  FROM vt JOIN tf USING (term) JOIN idf USING (term) JOIN ln_ ON ln_.id = tf.id, st GROUP BY qid, variant, tf.id),
vr AS (SELECT *, row_number() OVER (PARTITION BY qid, variant ORDER BY score DESC, id) AS place FROM vs WHERE score > 0 QUALIFY place <= 20),
rrf AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + place)), 9) AS score FROM vr GROUP BY qid, id)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM rrf QUALIFY rank <= 10""")
def multi_query_retrieve(spark, sf):
    return Q._ranked(R.multi_query_retrieve(Q._index(spark, sf), W.questions(spark, sf)), "score")


@query("compress_context", f"""WITH {Q.BM25},
sents AS (SELECT qid, id, list_distinct({S.tokens('question')}) AS q, list_filter(string_split(regexp_replace(content, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda s: trim(s, ' ') <> '') AS ss, content
  FROM sparse JOIN questions USING (qid) JOIN passages ON doc_id = id WHERE rank <= 5),
w AS (SELECT qid, id, i, 2 * len(list_intersect(q, list_distinct({S.tokens('s')}))) - 1 AS v FROM (SELECT qid, id, q, unnest(ss) AS s, unnest(generate_series(0, len(ss) - 1)) AS i FROM sents)),
p AS (SELECT *, sum(v) OVER (PARTITION BY qid, id ORDER BY i) AS upto FROM w),
m AS (SELECT *, least(-1, coalesce(min((upto * 10000000 - i - 2)::BIGINT) OVER (PARTITION BY qid, id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)) AS low FROM p),
r AS (SELECT qid, id, i AS last, CAST(ceil(low / 10000000.0) AS BIGINT) AS before, low, upto FROM m),
b AS (SELECT qid, id, last, before * 10000000 - low - 1 AS first, upto - before AS worth FROM r),
best AS (SELECT * FROM b WHERE worth > 0 QUALIFY row_number() OVER (PARTITION BY qid, id ORDER BY worth DESC, last) = 1)
SELECT qid, id, first, last, CASE WHEN last IS NULL THEN content ELSE array_to_string(ss[first + 1:last + 1], ' ') END AS compressed FROM sents LEFT JOIN best USING (qid, id)""")
def compress_context(spark, sf):
    """The five best passages of each question, cut to what serves it."""
    hits = X.topk(Q._index(spark, sf), W.questions(spark, sf), 5).select("qid", "id").join(W.questions(spark, sf), "qid")
    texts = W.passages(spark, sf).select(F.col("doc_id").alias("id"), "content")
    return R.compress_context(hits.join(texts, "id")).select("qid", "id", "first", "last", "compressed")
