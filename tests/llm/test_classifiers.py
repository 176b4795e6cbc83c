"""Held-out accuracy of the learned operators, and their behaviour on odd rows."""

import numpy as np
import pytest

from codexflow.llm import language, quality, toxicity
from codexflow.llm.queries import QUERIES, marks

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name,label,least", [("op1_toxicity", "toxic", 0.9), ("op9_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    rows = QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert len(rows) and rows["score"].between(0, 1).all()
    assert ((rows["score"] >= 0.3).astype(int) == rows["predicted"]).all()
    assert (rows["predicted"] == rows[label]).mean() >= least


def test_language_accuracy(spark):
    rows = QUERIES["op6_language"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (rows["lang_pred"] == rows["lang"]).mean() >= 0.97


def test_language_of_very_long_texts(spark):
    """Three megabytes of each language, all its texts one after the other."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("lang is not null")
    model = language.fit(docs)
    rows = [(lang, " ".join(r["text"] for r in docs.filter(docs["lang"] == lang).collect())) for lang in sorted(r["lang"] for r in docs.select("lang").distinct().collect())]
    long = spark.createDataFrame([(lang, text * (1 + 3_000_000 // len(text))) for lang, text in rows], "doc_id string, text string")
    assert all(r["doc_id"] == r["lang_pred"] for r in language.predict(long, model).collect())


def test_grammar_weighs_clauses():
    model = toxicity.Model({s + "$": 4.0 for s in toxicity.SEEDS}).ready()
    score = model.score
    assert score("") == score("a harmless clause") < 0.1
    assert score("You are an idiot.") > 0.9
    assert score("He wrote: you are not an idiot") < score("You are an idiot")
    assert score("Nobody here is not an idiot") < score("Everybody here is an idiot")
    assert score('Somebody said "what an idiot"') < score("What an idiot")
    assert score("I will kill you") > 0.5 > score("The frost will kill the roses")
    assert score("idiotic") == score("videot") == score("")


def test_quotations_and_reports_outlast_a_clause():
    score = toxicity.Model({s + "$": 4.0 for s in toxicity.SEEDS}).ready().score
    plain = score("What an idiot.")
    assert score('"Fine. Good." What an idiot.') == score("He is fine. What an idiot.") == score("He said so. What an idiot.") == plain
    assert score('He wrote: "I met them. What an idiot. Bye."') == score('He wrote: "What an idiot."') == score("“Fine. What an idiot.”") < plain
    assert score('An open " mark\n\nWhat an idiot.') == plain  # a paragraph's end closes it
    assert score("Not today. What an idiot.") == plain > score("You are not an idiot.")
    assert score("I will not kill you") < score("I will kill you") > score("kill you")


def test_fitted_order_of_clauses(spark):
    """Learned weights keep the order that the grammar stands for, whatever the labels."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, marks(spark, SF, "toxic", 4, 2)).ready()
    score = model.score
    assert score("a harmless clause") < 0.3 < score("What an idiot.") <= score("You idiot.")
    for weaker in ("You are not an idiot.", 'He wrote: "I met them. What an idiot. Bye."', "She said what an idiot.", 'He wrote: "What an idiot."'):
        assert score(weaker) < score("What an idiot.")
    assert score("I will not kill you") <= score("I will kill you")


def test_composition_runs_the_parts_in_turn():
    parts = [toxicity.insult(), toxicity.threat(), toxicity.negation(), toxicity.reported_speech(), toxicity.target()]
    both, random = toxicity.grammar(), np.random.default_rng(0)
    for _ in range(200):
        states, c = [0] * len(parts), 0
        for s in random.choice(sorted(toxicity.SYMBOLS), 30):
            out = s
            for i, part in enumerate(parts):
                states[i], out = part.arcs[states[i], out]
            c, got = both.arcs[c, s]
            assert got == out


def totals_by_rules(text, model):
    """The weights per path by looking at every hit's surroundings, word by word."""
    words = [*toxicity.WORD.findall(text.lower()), "\n"]
    kind = [{".": "E", "!": "E", "?": "E", ";": "E"}.get(w) or toxicity.MARKS.get(w) or model.classes.get(w, "w") for w in words]
    kind = ["i" if model.insult(w) else "v" if w in toxicity.THREATS else k for w, k in zip(words, kind)]
    out, quoted, reported, start = np.zeros(len(toxicity.PATHS)), False, False, 0
    for end, k in enumerate(kind):
        if k in "EP":
            clause = kind[start:end]
            for i, own in enumerate(clause):
                if own in ("Q", "Qo", "Qc"):
                    opens = own == "Qo" or (own == "Q" and not quoted)
                    quoted, reported = (True, reported) if opens else (False, False)
                elif own == "S":
                    reported = True
                elif own in "iv":
                    near, n = 0, i - 1
                    negated = False
                    while n >= 0 and near < toxicity.SCOPE and not negated:
                        negated = clause[n] == "N"
                        near += not clause[n].startswith("Q")
                        n -= 1
                    hit = "I" if own == "i" else "M" if "F" in clause[:i] else "T"
                    path = toxicity.PATHS.index((hit, int(negated), int(quoted or reported), int("Y" in clause)))
                    out[path] += model.insult(words[start + i]) or 3.0
            reported = reported and quoted
            if k == "P":
                quoted = reported = False
            start = end + 1
    return out


def test_totals_equal_the_rules_over_whole_texts():
    model, random = toxicity.Model({s + "$": 4.0 for s in toxicity.SEEDS} | {"scumm": 3.5}).ready(), np.random.default_rng(4)
    bag = ["idiot", "scummy", "kill", "you", "not", "said", "will", "plain", "word", "words", '"', "“", "”", "„", "«", "»", ".", "!", ";", "\n", "I", "é", "no"]
    for _ in range(400):
        text = " ".join(random.choice(bag, int(random.integers(1, 60))))
        assert np.allclose(model.totals(text), totals_by_rules(text, model)), text
    long = "plain words. " * 200_000 + "You idiot. " * 50_000
    assert model.totals(long).sum() == 50_000 * 4.0


def test_shrunk_discriminant_equals_the_densities():
    random = np.random.default_rng(2)
    x, y = random.normal(size=(400, 20)), (random.random(400) < 0.4).astype(int)
    x[y == 1] += 0.7
    model = quality.solve(x, y)
    z = np.clip((x - model.centre) / model.scale, -8, 8)
    want = np.zeros(len(x))
    for k, sign in ((0, -1), (1, 1)):
        covariance = np.linalg.inv(model.factors[k].T @ model.factors[k])
        d = z - model.means[k]
        want += sign * -0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(covariance), d) + np.linalg.slogdet(covariance)[1])
    assert np.allclose(model.differences(x), want)


def test_kernel_counts_common_ngrams():
    x = language.batch_presence(["abcd", "abcd", "wxyz", ""])
    assert np.isclose(x[0] @ x[1], 1) and x[0] @ x[2] < 0.2 and (x[3] == 0).all()


def test_odd_rows(spark, odd, empty, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for module, label in ((toxicity, "toxic"), (quality, "quality")):
        model = module.fit(docs, marks(spark, sf, label, 4, 2))
        rows = module.score(odd, model).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert module.score(empty, model).count() == 0
        kept = module.keep(odd, model)
        assert kept.columns == odd.columns
        none = module.fit(empty, spark.createDataFrame([], "doc_id long, label int"))
        assert module.score(odd, none).count() == odd.count()
    model = language.fit(docs)
    got = {r["doc_id"]: r for r in language.predict(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 9)] == ["und"] * 4 and got[6]["lang_pred"] in model.languages
    assert language.predict(empty, model).count() == 0
    assert {r["lang_pred"] for r in language.predict(odd, language.fit(empty)).collect()} == {"und"}
