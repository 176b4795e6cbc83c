"""BPE and packing against the tokenizers library and the packing rules."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from codexflow.llm import bpe, packing
from codexflow.llm.queries import QUERIES, VOCABULARY


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


CODEC = bpe.Codec(open(VOCABULARY, encoding="utf-8").read())
LIBRARY = Tokenizer.from_file(VOCABULARY)
ids_of = lambda t: np.array(LIBRARY.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'sTre.,12éß字🙂\x1c\x1f　 ")), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_equal_the_library(text):
    assert CODEC.encode(text) == ids_of(text)
    assert CODEC.decode(CODEC.encode(text)) == LIBRARY.decode(LIBRARY.encode(text, add_special_tokens=False).ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a <|endoftext|>b", "<|endoftext|><|endoftext|>", "<|endoftext|", "it's we'll 'S !'s", "  a  b \n\n c"])
def test_special_and_contractions(text):
    assert CODEC.encode(text) == ids_of(text)


def test_fragments_are_cut_at_pairs_no_token_holds():
    cut = CODEC.fragments(b"q\xff\x00z")
    assert b"".join(cut) == b"q\xff\x00z" and len(cut) > 1


def test_op8_rows(spark, sf, small, library):
    got = {r["doc_id"]: r for r in QUERIES["op8_bpe"](spark, sf).collect()}
    for r in small.collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        row = got[r["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(odd, empty):
    rows = bpe.encode(odd, VOCABULARY).collect()
    assert len(rows) == odd.count() and rows[0]["ids"] == b"" and rows[0]["decoded"] == ""
    assert bpe.encode(empty, VOCABULARY).count() == 0


def packed(df, docs, library, room=2048):
    rows = df.collect()
    filled = {}
    for r in rows:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= room
    want = {}
    for d in docs.collect():
        ids = [*library.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        first = len(ids) % room
        bounds = ([0] if first else []) + list(range(first, len(ids) + 1, room))
        for i, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
            want.setdefault((d["doc_id"], i, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes())), []).append(1)
    got = {}
    for r in rows:
        got.setdefault(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), []).append(1)
    assert got == want
    return len(filled), -(-sum(r["length"] for r in rows) // room)


def test_op3_rows_and_number_of_sequences(spark, sf, small, library):
    sequences, bound = packed(QUERIES["op3_packing"](spark, sf), small, library)
    assert sequences <= bound + 1


def test_packing_odd_rows(odd, empty, library):
    packed(packing.pack(odd, VOCABULARY), odd, library)
    assert packing.pack(empty, VOCABULARY).count() == 0


def best_fit_rooms(lengths, room):
    """What is left in each sequence after best fit piece by piece, long ones first."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= length]
        left = min(fits) if fits else room
        if fits:
            rooms.remove(left)
        rooms.append(left - length)
    return rooms


def filled(found, lengths, room):
    """Number of sequences, after checking that every piece is placed once and every sequence is gapless."""
    used = {}
    assert sorted(place for place, _, _ in found) == list(range(len(lengths)))
    for place, sequence, at in found:
        used.setdefault(sequence, []).append((at, lengths[place]))
    for parts in used.values():
        ends = 0
        for at, length in sorted(parts):
            assert at == ends
            ends += length
        assert ends <= room
    return len(used)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1))
def test_sweep_of_one_range_is_best_fit_on_rows(counts):
    """A range is placed into as many sequences as best fit needs piece by piece, and every piece once."""
    lengths = np.repeat(list(counts), list(counts.values()))
    placed, left, _ = packing.best_fit(packing.by_size(np.sort(lengths), np.argsort(lengths, kind="stable")), {}, 64, 0)
    assert not left
    found = [row for part in placed for row in zip(*(c.tolist() for c in part))]
    assert filled(found, lengths, 64) == len(best_fit_rooms(lengths.tolist(), 64))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=8))
def test_carried_gaps_are_those_of_a_stack(counts):
    stack, want = [], {}
    for number, (waiting, gaps) in enumerate(counts):
        for piece in range(waiting):
            if stack:
                want[number, piece] = stack.pop()
        stack += [(number, gap) for gap in range(gaps)]
    got = packing.carried([(number, *both) for number, both in enumerate(counts)])
    assert sorted((r, lo + i) for r, lo, hi, _, _ in got for i in range(hi - lo)) == sorted(want)
    taken = [(g, first + i) for _, lo, hi, g, first in got for i in range(hi - lo)]
    assert len(set(taken)) == len(taken) == len(want)
    for r, lo, hi, g, first in got:
        assert g < r and 0 <= first and first + hi - lo <= counts[g][1]
        assert {want[r, lo + i][0] for i in range(hi - lo)} == {g}


@pytest.mark.parametrize("rows_per_range", [10**6, 400])
@pytest.mark.parametrize("kind", ["spread", "hot", "halves"])
def test_supersteps_over_many_ranges(spark, kind, rows_per_range):
    """Every piece once, no gaps, and over many ranges at most one open sequence a range beside best fit's."""
    random = np.random.default_rng(5)
    lengths = {"spread": random.integers(1, 65, 2000), "hot": np.where(random.random(2000) < 0.4, 40, random.integers(1, 30, 2000)),
               "halves": np.concatenate([np.full(1000, 33), np.full(1000, 31)])}[kind].tolist()
    rows = spark.createDataFrame(list(enumerate(lengths)), "place long, length long").repartition(4)
    found = [tuple(r) for r in packing.match(rows, 64, rows_per_range).select("place", "sequence", "at").collect()]
    sequences, best = filled(found, lengths, 64), len(best_fit_rooms(lengths, 64))
    assert sequences == best if rows_per_range > 2000 else best <= sequences <= best + 12


def test_op3_over_many_ranges(spark, small, library):
    sequences, bound = packed(packing.pack(small, VOCABULARY, rows_per_range=30), small, library)
    assert sequences <= 1.1 * bound + 1
