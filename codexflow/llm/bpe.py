"""Byte-pair encoding by forced-boundary splitting (operator 8).

A pair of bytes that occurs inside no vocabulary token can never end up within one id, so every
such pair is a certain cut. Texts are cut there first at white space, then inside each word;
the fragments are encoded on their own and the ids concatenated. Fragments repeat, so a bounded
cache answers most of them.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexflow.llm.common import Shared, by_value, map_slices

by_value(__name__)

PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the vocabulary's own pattern
# letters before plain punctuation end a token there; any other run up to white space stays whole
WORDS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[\s.,;:!?#$%&*|]|$)| ?\S+|\s+(?!\S)|\s+")
CONTROL_SPACE = re.compile("[\x1c-\x1f]")  # white space to Python's re, not to the vocabulary's pattern
CACHE = 300_000


def byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one byte-level BPE vocabulary (a tokenizers JSON file).

    ``encode`` returns ids as little-endian unsigned 32-bit integers, one bytes object per text.
    """

    def __init__(self, spec: str):
        data = json.loads(spec)
        symbol = byte_of_symbol()
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        ranks = {bytes(symbol[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in special}
        self.piece = tiktoken.Encoding("own", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.special = {s: np.array([i], dtype="<u4").tobytes() for s, i in special.items()}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        inside = np.zeros((256, 256), dtype=bool)
        for token in ranks:
            row = np.frombuffer(token, dtype=np.uint8)
            inside[row[:-1], row[1:]] = True
        self.joined = {(a, b) for a, b in np.argwhere(inside).tolist()}
        # a space after a byte that is no white space starts a token: the white-space cut is a forced one
        self.space_cuts = not any((b, 32) in self.joined for b in range(256) if b not in (9, 10, 11, 12, 13, 32, 0x85, 0xA0))
        self.tokens = {i: t for t, i in ranks.items()} | {i: s.encode() for s, i in special.items()}
        self.pretokens = regex.compile(PRETOKENS).findall
        self.cache: dict[str, bytes] = {}

    def fragments(self, token: bytes) -> list[bytes]:
        """Cut at every byte pair that no vocabulary token holds."""
        cuts = [0, *(i for i, pair in enumerate(zip(token, token[1:]), 1) if pair not in self.joined), len(token)]
        return [token[lo:hi] for lo, hi in zip(cuts, cuts[1:])]

    def encode_word(self, word: str) -> bytes:
        ids: list[int] = []
        for token in [word] if word.lstrip(" ").isalpha() and not word.startswith("  ") else self.pretokens(word):
            data = token.encode()
            if self.joined.issuperset(zip(data, data[1:])):
                ids += self.piece(data)
            else:
                for fragment in self.fragments(data):
                    ids += self.piece(fragment)
        return array("I", ids).tobytes()

    def encode_plain(self, text: str) -> bytes:
        words = WORDS.findall(text) if self.space_cuts and not CONTROL_SPACE.search(text) else [text] if text else []
        cache = self.cache
        found = list(map(cache.get, words))
        for i in [i for i, ids in enumerate(found) if ids is None]:
            word = words[i]
            found[i] = self.encode_word(word)
            if len(word) <= 64:
                if len(cache) >= CACHE:
                    cache.clear()
                cache[word] = found[i]
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        if self.special_cut is None or not any(s in text for s in self.special):
            return self.encode_plain(text)
        return b"".join(self.special.get(part) or self.encode_plain(part) for part in self.special_cut.split(text))

    def decode(self, ids: bytes) -> str:
        """Unknown ids give nothing; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.tokens.get, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


class Vocabulary:
    """A vocabulary file's content; a Python worker builds its codec once and keeps the cache."""

    def __init__(self, spec: str):
        self.spec, self.codec = spec, None

    def ready(self) -> Codec:
        if self.codec is None:
            self.codec = Codec(self.spec)
        return self.codec


def vocabulary(spark, path: str):
    """The vocabulary, read on the driver and broadcast (its size does not depend on the data)."""
    with open(path, encoding="utf-8") as f:
        return Shared(spark, Vocabulary(f.read()))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """(id, ids binary, n_tokens, ids_sha256, decoded, decoded_sha256), one row per input row.

    ``ids``: little-endian unsigned 32-bit. Null text counts as empty and gives no ids. Repeated
    rows give repeated rows; other columns of ``docs`` are not read. ``keep_ids=False`` leaves
    ``ids`` and ``decoded`` out. A map without a shuffle.
    """
    shared = vocabulary(docs.sparkSession, path)

    def make():
        codec = shared.value.ready()

        def work(rows):
            ids = [codec.encode(t or "") for t in rows["text"]]
            decoded = [codec.decode(x) for x in ids]
            out = {
                "id": rows["id"], "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(d.encode()).hexdigest() for d in decoded]}
            return out | {"ids": ids, "decoded": decoded} if keep_ids else out

        return work

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    more = ", ids binary, decoded string" if keep_ids else ""
    out = map_slices(own, make, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
    return out.withColumnRenamed("id", id_col)
