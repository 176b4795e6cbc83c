"""Token alignment against byte owners, for whole texts and single windows."""

import hashlib
from collections import Counter

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from codexflow.llm import alignment
from codexflow.llm.bpe import byte_of_symbol
from codexflow.llm.queries import PIECES, QUERIES, VOCABULARY

SYMBOL = byte_of_symbol()
TOKENIZER = Tokenizer.from_file(VOCABULARY)
TOKENIZER.encode_special_tokens = True
MODEL = sentencepiece.SentencePieceProcessor(model_file=PIECES)


def aligned(text):
    """(ids of a, ids of b, groups, linked pairs) or None, by giving every byte its two tokens."""
    data = (" " + (text or "")).encode()
    a, b = TOKENIZER.encode(" " + (text or ""), add_special_tokens=False).ids, MODEL.encode(text or "")
    a_bytes = [bytes(SYMBOL[c] for c in TOKENIZER.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(MODEL.id_to_piece(i)[3:-1], 16)]) if MODEL.is_byte(i) else MODEL.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not text or b"".join(a_bytes) != data or b"".join(b_bytes) != data:
        return None
    owner = [[i for i, t in enumerate(side) for _ in t] for side in (a_bytes, b_bytes)]
    ends = [{sum(map(len, side[:i + 1])) for i in range(len(side))} if len(side) < 200 else set(__import__("itertools").accumulate(map(len, side))) for side in (a_bytes, b_bytes)]
    pairs = [(a[i], b[j]) for i, j in sorted(set(zip(*owner)))]
    groups, low = [], 0
    for cut in sorted(ends[0] & ends[1]):
        groups.append(",".join(str(a[i]) for i in range(owner[0][low], owner[0][cut - 1] + 1)) + "|" + ",".join(str(b[j]) for j in range(owner[1][low], owner[1][cut - 1] + 1)))
        low = cut
    return a, b, groups, pairs


def expected(rows):
    told = [(doc_id, aligned(text)) for doc_id, text in rows]
    counts = Counter(p for _, x in told if x for p in x[3])
    most: dict = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for doc_id, x in told:
        out.append((doc_id, 0, 0, 0, 0, 0, 0, "") if x is None else (
            doc_id, len(x[0]), len(x[1]), len(x[2]), len(x[3]), sum(counts[p] == most[p[1]] for p in x[3]), sum(counts[p] for p in x[3]),
            hashlib.sha256(";".join(x[2]).encode()).hexdigest()))
    return sorted(out, key=str)


def test_op13_rows(spark, sf, small):
    got = QUERIES["op13_alignment"](spark, sf)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(small.select("doc_id", "text").collect())


@pytest.mark.parametrize("frequent", [1 << 18, 50, 0])
def test_odd_rows(spark, odd, empty, frequent):
    more = spark.createDataFrame([(90, "▁ is changed"), (91, "a <|endoftext|> b <unk> </s> c"), (92, "tab\tline\r\n\r\n  spaces   end "), (93, "no" * 3000), (94, "▁"), (95, " lead")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(more)
    got = alignment.align(docs, VOCABULARY, PIECES, frequent=frequent)
    assert sorted(map(tuple, got.collect()), key=str) == expected([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert alignment.align(empty, VOCABULARY, PIECES).count() == 0


ALIGNER = alignment.Aligner(open(VOCABULARY, encoding="utf-8").read(), open(PIECES, "rb").read()).ready()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["the", " ", "  ", "\n", "Straße", "über", "🙂", "字", "x", "'s", "1234", ".", "…", "\x00", "ing", "▁"]), max_size=20).map("".join), min_size=1, max_size=4))
def test_slices_equal_byte_owners(texts):
    got = ALIGNER.align(texts)
    for i, text in enumerate(texts):
        x = aligned(text)
        want = (0, 0, 0, 0) if x is None else tuple(map(len, x))
        assert tuple(int(got[c][i]) for c in ("n_a", "n_b", "n_groups", "n_links")) == want
        assert got["groups_sha256"][i] == ("" if x is None else hashlib.sha256(";".join(x[2]).encode()).hexdigest())
        pairs = dict(zip(got["pairs"][i].as_py(), got["times"][i].as_py()))
        assert pairs == Counter(a * len(ALIGNER.bytes[1]) + b for a, b in (x[3] if x else []))


def test_forgetting_changes_nothing(monkeypatch):
    texts = [f"window {i} of {i * 7} words" for i in range(200)]
    whole = ALIGNER.align(texts)["groups_sha256"]
    monkeypatch.setattr(alignment, "KEPT_WINDOWS", 3)
    assert [ALIGNER.align([t])["groups_sha256"][0] for t in texts] == whole
