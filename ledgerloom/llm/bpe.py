"""Byte-level BPE encoding by backtracking, and decoding from an offset table.

A pretoken's encoding is the one sequence of tokens in which every neighbouring pair
is *compatible*: merging the pair's bytes on their own gives the pair again. The
encoder walks left to right, takes the longest token that an Aho-Corasick automaton
found at its place, steps down to shorter prefixes while the pair is incompatible or
the end is known to be a dead end, and steps back when none is left. Each place is
marked dead at most once, so time is linear in the text and the result equals the
merges' own. Pair checks are kept in a table.

Decoding keeps the bytes of all tokens in one buffer with their offsets, and gathers
whole chunks of texts at once.

Defined results: null text counts as empty and gives no ids; the strings of added
tokens in a text become their ids, as the tokenizers library does; an empty table
gives an empty result; only the id and text columns are read, so that others may have
any name.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import read_path
from ledgerloom.llm.textscan import chunks

#: The pretoken pattern of byte-level BPE (fixed values), and the same for texts whose
#: characters all lie below U+0250, where classes need no tables.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN = re.compile(r" ?[A-Za-zªµºÀ-ÖØ-öø-ɏ]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\sA-Za-z0-9ªµºÀ-ÖØ-öø-ɏ]+|\s+(?!\S)|\s+")
_UNUSUAL = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")
_FULL = regex.compile(PATTERN)
#: Pretokens whose ids a worker remembers, and pair checks.
REMEMBERED = 400_000

SCHEMA = "doc_id long, n_tokens long, ids binary, decoded binary"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokens:
    """A vocabulary in merge order, its automaton, splits, prefixes and offset table."""

    def __init__(self, blob: bytes):
        spec = json.loads(blob)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = {a + b for a, b in merges}
        names = [t for t in sorted(vocab, key=vocab.get) if t not in made] + [a + b for a, b in merges]
        order = {t: k for k, t in enumerate(names)}
        as_bytes = lambda t: bytes(letters[c] for c in t)
        self.number = [vocab[t] for t in names]
        self.width = [len(t) for t in names]
        self.split = [(k, k) for k in range(len(names))]
        self.merged = {}
        for a, b in merges:
            k = order[a + b]
            self.split[k] = order[a], order[b]
            self.merged[order[a], order[b]] = k
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, t in enumerate(names):
            if all(c in letters for c in t):
                self.automaton.add_word(as_bytes(t).decode("latin-1"), k)
        self.automaton.make_automaton()
        self.shorter = [next((order[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in order), -1) for t in names]
        self.added = {a["content"]: a["id"] for a in spec.get("added_tokens") or []}
        self.at_added = re.compile("(" + "|".join(re.escape(a) for a in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        held = {i: as_bytes(t) for t, i in vocab.items()} | {i: a.encode() for a, i in self.added.items()}
        size = np.array([len(held.get(i, b"")) for i in range(max(held) + 1)], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(size)])
        self.bytes = np.frombuffer(b"".join(held.get(i, b"") for i in range(len(size))), np.uint8)
        self.pairs: dict[tuple[int, int], bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging these two tokens' bytes gives these two tokens."""
        key = left, right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            known = self.pairs[key] = self._check(left, right)
        return known

    def _check(self, left: int, right: int) -> bool:
        """Undo the later merge of the two again and again: no merge across the border may come before it."""
        limit = len(self.split)
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < limit:
                return False
            inner_left, inner_right = self.split[left][1], self.split[right][0]
            if inner_left == left and inner_right == right:
                return True
            # merges at the right side of equal rank come later than the border's
            if inner_right == right or (inner_left != left and left > right):
                limit, left = left, inner_left
            else:
                limit, right = right + 1, inner_right

    def encode(self, word: bytes) -> list[int]:
        """The ids of one pretoken."""
        end = len(word)
        longest = [-1] * end
        for last, k in self.automaton.iter(word.decode("latin-1")):
            start = last - self.width[k] + 1
            if longest[start] < 0 or self.width[k] > self.width[longest[start]]:
                longest[start] = k
        if self.width[longest[0]] == end:
            return [self.number[longest[0]]]
        dead = bytearray(end + 1)
        taken: list[int] = []
        at, k = 0, longest[0]
        while True:
            while k >= 0:
                after = at + self.width[k]
                if not dead[after] and (not taken or self.compatible(taken[-1], k)):
                    break
                k = self.shorter[k]
            if k >= 0:
                taken.append(k)
                at += self.width[k]
                if at == end:
                    return [self.number[t] for t in taken]
                k = longest[at]
            else:
                dead[at] = 1
                k = taken.pop()
                at -= self.width[k]
                k = self.shorter[k]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where each id's bytes end."""
        begin = self.offset[ids]
        size = self.offset[ids + 1] - begin
        end = np.cumsum(size)
        return self.bytes[np.repeat(begin - (end - size), size) + np.arange(end[-1] if len(end) else 0)], end


class _Remembered(dict):
    """Pretoken to its ids' bytes; finds missing ones by encoding them."""

    def __init__(self, tokens: Tokens):
        super().__init__()
        self.tokens = tokens

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.tokens.encode(piece.encode())).tobytes()
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def _loaded(blob: bytes) -> tuple[Tokens, _Remembered]:
    tokens = Tokens(blob)
    return tokens, _Remembered(tokens)


def encode_text(text: str, tokens: Tokens, known: dict) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit integers."""
    parts = tokens.at_added.split(text) if tokens.at_added and any(a in text for a in tokens.added) else [text]
    out = []
    for k, part in enumerate(parts):
        if k % 2:
            out.append(array("I", [tokens.added[part]]).tobytes())
        else:
            find = _FULL.findall if _UNUSUAL.search(part) else _PLAIN.findall
            out.append(b"".join(map(known.__getitem__, find(part))))
    return b"".join(out)


def round_trip(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, its ids as little-endian unsigned 32-bit integers, and the bytes they decode to."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_path(spark, vocabulary))

    def run(batches):
        tokens, known = _loaded(shared.value)
        for batch in batches:
            for part in chunks(batch):
                ids = [encode_text(t or "", tokens, known) for t in part["text"].to_pylist()]
                flat = np.frombuffer(b"".join(ids), np.uint32).astype(np.int64)
                decoded, end = tokens.decode(flat)
                blob, count = decoded.tobytes(), np.array([len(x) // 4 for x in ids])
                cut = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(count)])].tolist()
                back = [blob[a:b] for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(count, pa.int64()), pa.array(ids, pa.binary()), pa.array(back, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, SCHEMA)
