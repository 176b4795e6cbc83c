"""Secret and personal-data scans against plain regular expressions."""

import hashlib
import math
import re
import time
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codexflow.llm import pii, secret_scan
from codexflow.llm.automaton import Automaton, mirrored, parse
from codexflow.llm.queries import QUERIES

SCANNER = secret_scan.Scanner(secret_scan.RULES)
LETTER = lambda c: f"[{c}{c.upper()}]" if c.isalpha() else c
KEYWORDS = "|".join("".join(map(LETTER, w)) for w in ("password", "passwd", "secret", "token", "api_?key"))
PLAIN = {
    "assign": rf"""((?:{KEYWORDS})["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""",
    **{r.kind: f"({r.head})({r.body})" for r in secret_scan.RULES[1:]}}
LEAST = {r.kind: r.least for r in secret_scan.RULES}


def secrets(text, kinds=tuple(PLAIN)):
    found = [(m.start(), i, m.end(), k) for i, k in enumerate(kinds) for m in re.finditer(PLAIN[k], text or "") if m.end() - m.start(2) >= LEAST[k]]
    return [(s, k, e) for s, _, e, k in sorted(found)]


PARTS = ["password", "PassWd", "secret", "token", "api_key", "apikey", ":", "=", " ", '"', "'", "AKIA", "A1B2", "abcdef", "0123456789", "é", "\n",
         "zz", ".", "_", "ghp_", "a" * 30, "eyJab.", "-----BEGIN ", "PRIVATE KEY-----", "RSA ", "xoxb-", "AIza", "K", "ſ", "字", "🙂"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=40).map("".join), min_size=1, max_size=4))
def test_scanner_equals_regular_expressions(texts):
    assert SCANNER.scan(texts) == [secrets(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(["a(b|c)*d?", "[0-9a-f]{3}", "(ab|a)(c|bcd)", "x{2,}y", r"\x20*[:=]"]), st.text("abcdxy :=0f", max_size=12))
def test_automaton_accepts_what_the_expression_does(pattern, text):
    data = text.encode()
    for tree, source in ((parse(pattern), data), (mirrored(parse(pattern)), data[::-1])):
        last = Automaton([tree], search=False).run(source, range(len(source)))
        ends = [n for n in range(1, len(data) + 1) if re.fullmatch(pattern, (source[:n] if source is data else source[:n][::-1]).decode())]
        assert last + 1 == max(ends, default=0)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()


def test_op5_rows(spark, sf, small, odd, empty):
    for rows, docs in ((QUERIES["op5_secrets"](spark, sf), small), (secret_scan.digest(secret_scan.scan(odd)), odd)):
        got = sorted((r["doc_id"] is None, r["doc_id"], r["base_sha256"], r["n_assign"] + r["n_access"] + r["n_hex"]) for r in rows.collect())
        base = {d: secrets(t, secret_scan.BASE) for d, t in {(r["doc_id"], r["text"]): r["text"] for r in docs.collect()}.items()}
        assert got == sorted((r["doc_id"] is None, r["doc_id"], digest(base[r["doc_id"], r["text"]]), len(base[r["doc_id"], r["text"]])) for r in docs.collect())
    assert secret_scan.scan(empty).count() == 0


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
PERSONAL = {"email": EMAIL, "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def counts(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in value.split(".")), "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
            "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def personal(text):
    found = [(m.start(), i, m.end(), k) for i, k in enumerate(PERSONAL) for m in re.finditer(PERSONAL[k], text or "") if counts(k, m[0])]
    return [(s, k, e) for s, _, e, k in sorted(found)]


def test_op4_rows(spark, sf, small):
    got = {r["doc_id"]: r for r in QUERIES["op4_pii"](spark, sf).collect()}
    for r in small.collect():
        spans = personal(r["text"])
        assert got[r["doc_id"]]["base_sha256"] == digest(spans)
        assert [got[r["doc_id"]][f"n_{k}"] for k in PERSONAL] == [sum(s[1] == k for s in spans) for k in PERSONAL]


TRICKY = [
    "a@b.com.x_y@z.org", "1.2.3.4.5.6.7.8", "256.1.1.1 01.002.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (614) 555-8001 x +12", "é🙂 a@b.c 字 q@r.s",
    "a@b", "@", "+", "1 " * 9_000, "a." * 9_000 + "@x.yz", "+1" + " " * 9_000 + "x", "00000000000000000000", None, ""]


def test_tricky_texts(spark, odd, empty):
    df = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in pii.find(df).collect()}
    assert got == {i: personal(t) for i, t in enumerate(TRICKY)}
    assert pii.find(odd).count() == odd.count() and pii.find(empty).count() == 0
    kept = pii.sanitise(pii.find(odd.drop("spans")))
    assert kept.columns == odd.drop("spans").columns and kept.filter("text is null").count() == 1


def test_disclosing_terms_are_found_wherever_they_stand(spark):
    """A code word seen next to one number in many contexts, and almost nowhere else, gives that number away."""
    filler = [a + b for a in ("al", "bra", "char", "del", "ech", "fox", "gol", "hot") for b in ("pha", "vo", "lie", "ta", "oes", "trot", "fed", "elo")]
    pick = lambda i, k: filler[(i * 7 + k * 13 + i * k) % 64]
    rows = [(i, f"{pick(i, 1)} {pick(i, 2)} quokka +1 (614) 555-8001 {pick(i, 3)} {pick(i, 4)}") for i in range(20)]
    rows += [(100 + i, " ".join(pick(i, k) for k in range(12))) for i in range(80)]
    near = lambda i: "same passage zebu 10.0.0.1 again and " + ("once more" if i % 6 else pick(i, 5))
    rows += [(200, "the Quokka is not a quokkas"), (201, near(1)), *[(300 + i, near(i)) for i in range(40)]]
    found = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s["start"], s["kind"], s["end"], s["value"]) for s in found[200]] == [(4, "term", 10, "removed")]
    assert [s["kind"] for s in found[201]] == ["ip"], "copies and near copies of one passage are one piece of evidence"
    assert all(not found[100 + i] for i in range(80))
    clean = pii.sanitise(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).filter("doc_id in (0, 200)").collect()
    texts = {r["doc_id"]: r["text"] for r in clean}
    assert "[PHONE]" in texts[0] and "quokka" not in texts[0] and texts[200] == "the  is not a quokkas"


def test_evidence_of_signatures_and_beside_copies(spark):
    """A name in the same signature on different documents is found; copies of a template do not switch evidence off."""
    filler = [a + b for a in ("al", "bra", "char", "del", "ech", "fox", "gol", "hot") for b in ("pha", "vo", "lie", "ta", "oes", "trot", "fed", "elo")]
    pick = lambda i, k: filler[(i * 7 + k * 13 + i * k) % 64]
    prose = lambda i: " ".join(pick(i, k) for k in range(40))
    rows = [(i, f"{prose(i)} kind regards yours okapi +1 (614) 555-8001 head office north gate") for i in range(30)]
    rows += [(100 + i, f"{pick(i, 1)} {pick(i, 2)} quokka 10.0.0.1 {pick(i, 3)} {pick(i, 4)}") for i in range(20)]
    rows += [(200 + i, "one template with a quokka 10.0.0.1 that is copied often") for i in range(1000)]
    rows += [(2000, "an okapi and a quokka"), *[(2100 + i, prose(i + 31)) for i in range(200)]]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id = 2000").first()["spans"]
    assert [(s["start"], s["kind"], s["end"], s["value"]) for s in found] == [(3, "term", 8, "removed"), (15, "term", 21, "removed")]


def test_many_mentions_in_one_text_take_time_in_proportion(spark):
    def seconds(n):
        text = " ".join(f"mail joe{i}@example.org or call +1 (614) 555-80{i % 90 + 10} about the weather" for i in range(n // 2))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.time()
        found = pii.find(df)
        row = found.withColumn("spans", F.filter("spans", lambda s: s["kind"] != "term")).first()
        if n <= 1000:
            assert [(s["start"], s["kind"], s["end"]) for s in row["spans"]] == personal(text)
        assert len(row["spans"]) == n // 2 * 2
        assert pii.sanitise(found.withColumn("spans", F.filter("spans", lambda s: s["kind"] != "term"))).first()["text"].count("[EMAIL]") == n // 2
        return time.time() - start

    seconds(100)
    few = seconds(1_000)
    assert seconds(10_000) < 10 * max(few, 2.0)


def test_terms_disclose_what_counting_says(spark):
    """The disclosing terms from the contexts, by plain counting of words, contexts and mutual information."""
    pick = lambda i, k: f"word{'abcdefghij'[(i * 3 + k * 7) % 10]}{'abcdefghij'[(i + k * k) % 10]}"
    rows = [(i, f"{pick(i, 1)} {'numbat' if i % 3 else 'tapir'} {pick(i, 2)} call +1 (614) 555-80{i % 2}1 {pick(i, 3)} at {pick(i, 4)}") for i in range(60)]
    rows += [(100 + i, " ".join(pick(i, k) for k in range(30)) + (" tapir" if i % 4 == 0 else "")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans, told = pii.base_spans(docs), []
    for threshold, support in ((0.8, 5), (0.5, 3), (0.3, 8)):
        seen = defaultdict(list)
        for r in pii.contexts(spans).collect():
            for t in r["words"]:
                seen[r["entity"], t].append((frozenset(w for w in r["words"] if w != t), r["source"]))
        words = Counter(w for _, t in rows for w in re.split(r"[^a-zA-Z]+", t.lower()) if len(w) >= 3)
        total, near = sum(words.values()), Counter()
        for (entity, _), found in seen.items():
            near[entity] += len(found)
        want = {}
        for (entity, t), found in seen.items():
            information = -math.log2(near[entity] / total)
            disclosed = math.log2(min(len(found) / words[t], 1.0)) + information
            # a sketch tells contexts apart by their smallest hash, so it may count fewer than there are
            most = max(len({c for c, _ in found}), len({s for _, s in found}))
            if most >= support and information > 0 and disclosed >= threshold * information:
                want[t] = want.get(t, False) or ":" in entity
        got = {r["term"]: r["removed"] for r in pii.disclosing_terms(docs, spans, threshold, support).collect()}
        assert got.keys() <= want.keys() and all(want[t] or not r for t, r in got.items())
        assert {"numbat"} <= got.keys()
        told.append(len(want) - len(got))
    assert min(told) == 0


@pytest.mark.parametrize("text,spans", [("token=abc", []), ("secret=token:abcdefghijklmnop", [])])
def test_short_bodies_use_up_their_text(text, spans):
    assert SCANNER.scan([text]) == [spans]
