"""Near words, forms and roots against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from codexflow.llm import spelling
from codexflow.llm.queries import QUERIES


def near_by_brute_force(words):
    letters, out = sorted({c for w in words for c in w}), {}
    for w in words:
        near = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters} | {w[:i] + w[i + 1:] for i in range(len(w))}
        near |= {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in letters}
        out[w] = (near - {w}) & words.keys()
    return out


def expected(words, ratio=5):
    words = {w: n for w, n in words.items() if n >= 5}
    near, form = near_by_brute_force(words), {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items())


def words_of(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                out[run] += 1
    return out


def table(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_op11_rows(spark, sf, small):
    assert table(QUERIES["op11_spelling"](spark, sf)) == expected(words_of(small.select("doc_id", "text").collect()))


@pytest.mark.parametrize("cell", [1 << 14, 40])
def test_near_words_in_hot_buckets(spark, cell):
    """Words of two letters, long and short, so that buckets are full; in one cell or many."""
    draw, words = random.Random(1), Counter()
    for _ in range(2500):
        size = draw.choice([6, 6, 7, 7, 8, 9, 12, 40, 70])
        w = [draw.choice("abÿ") if size < 12 else "a" for _ in range(size)]
        for _ in range(draw.randrange(3) if size >= 12 else 0):
            w[draw.randrange(size)] = "b"
        words["".join(w)] = draw.choice([5, 5, 6, 25, 30, 125])
    got = {r["word"]: (r["n_near"], r["near_n"], r["near"]) for r in spelling.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), cell).collect()}
    near = near_by_brute_force(words)
    best = {w: min(found, key=lambda x: (-words[x], x)) for w, found in near.items() if found}
    assert got == {w: (len(near[w]), words[b], b) for w, b in best.items()}


def test_forms_lead_to_a_root(spark):
    chain = {"coloured": 5, "colourede": 25, "colouredes": 125, "colouredest": 700, "unrelated": 9, "fewwords": 4}
    rows = [(None, " ".join([w] * n) + ".") for w, n in chain.items()]
    got = {r[0]: r[1:] for r in table(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), every=10 ** 9))}
    assert got["coloured"] == ("colourede", "colouredest", 5, 1, 25) and got["colouredest"] == (None, "colouredest", 700, 1, None)
    assert got["unrelated"] == (None, "unrelated", 9, 0, None) and "fewwords" not in got


def test_odd_rows(odd, empty):
    assert table(spelling.variants(odd)) == expected(words_of([(r["doc_id"], r["text"]) for r in odd.collect()]))
    assert spelling.variants(empty).count() == 0


def test_very_long_words(spark):
    """Words longer than the index's window, one letter apart at every kind of place."""
    base = "abcdefghij" * 30
    words = {base, base[:-1], base[1:], base[:150] + "z" + base[150:], base[:33] + "z" + base[34:], base + "z", "z" + base, base[:64] + base[65:]}
    got = {r["word"]: r["n_near"] for r in spelling.near_words(spark.createDataFrame([(w, 5) for w in words], "word string, n long")).collect()}
    assert got == {w: len(f) for w, f in near_by_brute_force(dict.fromkeys(words, 5)).items() if f}
