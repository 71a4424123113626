"""Packing documents into token sequences: best fit, then swap-based local search.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt at random
into groups of about ``GROUP`` rows; each group is packed in one task: pieces in
falling length into the fullest bin that holds them, then a local search that moves a
document, exchanges one for one, or two for one between any underfull bins. Every step
raises the sum of squared fills, so bins run empty until no step is left. Bins that
stay underfull are dealt anew as they are and searched with those of other groups in a
further round, until one group holds them all or a round saves no sequence.

Rows carry lengths and checksums, not texts. Defined results: null and empty texts
are a single end token; repeated rows and null ids are packed as rows of their own; an
empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from ledgerloom.llm.common import read_path, stage
from ledgerloom.llm.textscan import chunks

GROUP = 8192
REMEMBERED = 300_000
_NEVER = 1 << 40
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Texts of these characters only are split into words here; others go to the library whole.
_UNUSUAL = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ſ]")
_WORDS = re.compile("'(?:[stmd]|re|ve|ll)|[a-zªµºß-öø-ſ]+|[0-9]|[^\\sa-z0-9ªµºß-öø-ſ]+")


@lru_cache(maxsize=2)
def _loaded(blob: bytes) -> tuple[Tokenizer, Tokenizer, tuple[str, ...]]:
    """The tokenizer, the same for words that are cut and in lower case already, and the added tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    whole, single = Tokenizer.from_buffer(blob), Tokenizer.from_buffer(blob)
    for t in (whole, single):
        t.no_truncation()
        t.no_padding()
    single.normalizer = None
    single.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
    return whole, single, tuple(a.content for a in whole.get_added_tokens_decoder().values())


def encode_texts(texts: list[str], whole: Tokenizer, single: Tokenizer, added: tuple[str, ...], known: dict[str, bytes]) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers; words that were met before are looked up."""
    plain = [None if _UNUSUAL.search(t) or any(a in t for a in added) else _WORDS.findall(t.lower()) for t in texts]
    new = list(set().union(*(p for p in plain if p)) - known.keys())
    if len(known) + len(new) > REMEMBERED:
        known.clear()
        new = list(set().union(*(p for p in plain if p)))
    for word, done in zip(new, single.encode_batch_fast(new, add_special_tokens=False)):
        known[word] = array("I", done.ids).tobytes()
    return [np.array(whole.encode(t, add_special_tokens=False).ids, np.uint32).tobytes() if p is None else b"".join(map(known.__getitem__, p)) for t, p in zip(texts, plain)]


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_path(spark, vocabulary))
    end = np.array([end_id], np.uint32).tobytes()

    def run(batches):
        loaded, known = _loaded(shared.value), {}  # words go when the task ends; its worker may run other stages next
        for batch in batches:
            for part in chunks(batch):
                out = []
                for i, ids in zip(part["doc_id"].to_pylist(), encode_texts([t or "" for t in part["text"].to_pylist()], *loaded, known)):
                    ids += end
                    for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[a : a + 4 * capacity]
                        out.append((i, k, a // 4, len(own) // 4, zlib.crc32(own)))
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Items in falling length, each into the fullest bin that holds it; bins as lists of item numbers."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0  # a bit for each amount of free space that some bin has
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = lengths[item]
        fits = used >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            k = by_free[free].pop()
            if not by_free[free]:
                used ^= 1 << free
            bins[k].append(item)
        else:
            free, k = capacity, len(bins)
            bins.append([item])
        by_free[free - size].append(k)
        used |= 1 << (free - size)
    return bins


class _OpenBins:
    """Underfull bins. ``held`` says by number of items (one or two), size and bin whether the bin holds items of that size together; ``least`` is the lowest fill of such a bin."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.items = [list(b) for b in bins]
        self.fill = np.array([sum(lengths[i] for i in b) for b in bins], np.int64)
        self.held = [np.zeros((capacity + 1, len(bins)), bool) for _ in range(2)]
        self.least = [np.full(capacity + 1, _NEVER) for _ in range(2)]
        self.sizes = [self._sums(k) for k in range(len(bins))]
        for k in range(len(bins)):
            self.put(k)

    def _sums(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct sizes of a bin's items, and of its pairs of items."""
        sizes, times = np.unique([self.lengths[i] for i in self.items[k]], return_counts=True)
        sizes = sizes.astype(np.int64)
        a, b = np.triu_indices(len(sizes), 1)
        return sizes, np.unique(np.concatenate([sizes[a] + sizes[b], 2 * sizes[times > 1]]))

    def put(self, k: int) -> None:
        for held, least, sizes in zip(self.held, self.least, self.sizes[k]):
            held[sizes, k] = True
            least[sizes] = np.minimum(least[sizes], self.fill[k])

    def remove(self, k: int) -> None:
        for held, least, sizes in zip(self.held, self.least, self.sizes[k]):
            held[sizes, k] = False
            own = sizes[least[sizes] == self.fill[k]]
            least[own] = np.where(held[own], self.fill, _NEVER).min(axis=1)

    def best_step(self, k: int) -> tuple[int, int, int, int, int] | None:
        """The step by which bin ``k``, which is taken out, gains most: (giver, items it gives, their size, items it gets, their size).

        The sum of squared fills rises when the taker ends fuller than the giver was.
        """
        gains = np.arange(1, self.capacity - int(self.fill[k]) + 1)
        best, step = 0, None
        sizes, pairs = self.sizes[k]
        for give, back, taken in ((0, 0, np.zeros(1, np.int64)), (0, 1, sizes), (1, 1, sizes), (0, 2, pairs)):
            if len(taken) and best < len(gains):
                hits = self.least[give][taken[:, None] + gains[best:]] < self.fill[k] + gains[best:]
                found = np.flatnonzero(hits.any(axis=0))
                if len(found):
                    best += int(found[-1]) + 1
                    size = int(taken[hits[:, found[-1]].argmax()])
                    step = (give, size + best, back, size)
        if not step:
            return None
        give, size, back, back_size = step
        giver = int(np.where(self.held[give][size], self.fill, _NEVER).argmin())
        return giver, give + 1, size, back, back_size

    def _pick(self, k: int, n: int, size: int) -> list[int]:
        """``n`` items of bin ``k`` that are ``size`` tokens together."""
        if n < 2:
            return [next(i for i in self.items[k] if self.lengths[i] == size)] if n else []
        seen: dict[int, int] = {}
        for i in self.items[k]:
            if (j := seen.get(size - self.lengths[i])) is not None:
                return [j, i]
            seen[self.lengths[i]] = i
        raise ValueError("no such items")

    def apply(self, k: int, step: tuple[int, int, int, int, int]) -> None:
        giver, n, size, back_n, back = step
        give, take = self._pick(giver, n, size), self._pick(k, back_n, back)
        self.remove(giver)
        for b, gone, new in ((giver, give, take), (k, take, give)):
            for i in gone:
                self.items[b].remove(i)
            self.items[b].extend(new)
            self.sizes[b] = self._sums(b)
        self.fill[giver] -= size - back
        self.fill[k] += size - back
        self.put(giver)


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Move documents, and exchange one for one or two for one, between any underfull bins until no step raises the sum of squared fills.

    The fullest bin comes first; each takes what raises its fill most, out of the emptiest
    bin that can give it. Bins take turns until none changes. Each step raises a bounded
    whole number, so the search ends.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    done = [b for b, f in zip(bins, fill) if f == capacity]
    found = _OpenBins([b for b, f in zip(bins, fill) if f < capacity], lengths, capacity)
    changed = True
    while changed:
        changed = False
        for k in np.argsort(-found.fill, kind="stable").tolist():
            found.remove(k)
            while 0 < found.fill[k] < capacity and (step := found.best_step(k)):
                found.apply(k, step)
                changed = True
            found.put(k)
    return done + [b for b in found.items if b]


def _pack_group(capacity: int, turn: int):
    """Best fit for pieces without a sequence, then the search over all sequences of the group."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        lengths = table["length"].to_pylist()
        if turn:
            own: dict[int, list[int]] = {}
            for i, k in enumerate(table["sequence_id"].to_pylist()):
                own.setdefault(k, []).append(i)
            bins = list(own.values())
        else:
            bins = best_fit(lengths, capacity)
        bins = local_search(bins, lengths, capacity)
        order, sequence, offset, free = [], [], [], []
        for k, held in enumerate(bins):
            at = 0
            for i in held:
                order.append(i)
                sequence.append((turn << 56) | (key[0].as_py() << 20) | k)
                offset.append(at)
                at += lengths[i]
            free += [capacity - at] * len(held)
        out = table.select(["doc_id", "piece", "start", "length", "ids_crc32"]).take(pa.array(order, pa.int64()))
        for name, values in (("sequence_id", sequence), ("offset", offset), ("free", free)):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    return run


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add sequence_id and offset to pieces."""
    done, left = [], stage(pieces.withColumn("sequence_id", F.lit(0).cast("long")), "pieces")
    rows, bins, turn = left.count(), None, 0
    while True:
        groups = -(-rows // GROUP) or 1
        # pieces are dealt one by one at first, sequences as a whole later
        by = F.col("sequence_id") if turn else F.monotonically_increasing_id()
        dealt = left.withColumn("group", F.pmod(F.xxhash64(by, F.lit(turn)), F.lit(groups)))
        packed = stage(dealt.groupBy("group").applyInArrow(_pack_group(capacity, turn), f"{PIECES}, sequence_id long, offset long, free long"), "packed")
        open_ = packed.filter("free > 0")
        rows, after, all_bins = packed.selectExpr("count_if(free > 0)", "count_if(free > 0 AND offset = 0)", "count_if(offset = 0)").head()
        if groups == 1 or not rows or all_bins == bins:
            done.append(packed)
            break
        done.append(packed.filter("free = 0"))
        left, bins, turn = open_.drop("offset", "free"), after, turn + 1
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.drop("free")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each piece of each row of ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(cut_pieces(docs, vocabulary, capacity, end_id, id_column, text_column), capacity)
