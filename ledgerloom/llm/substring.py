"""Removal of long passages that an earlier document already holds.

A window is ``WINDOW`` consecutive words of one document. A word goes if a window that
covers it also starts in a document with a smaller id. All windows of all documents
are judged, but few are ever shuffled:

1. Documents with the same words form a class. Of a class only the smallest id goes
   on; its other members are repeats of it from the first window to the last.
2. Anchors: runs of ``WINDOW - PERIOD + 1`` words are hashed only where the position
   modulo ``PERIOD`` lies in a difference cover. For any two positions some shift puts
   both in the cover, so any two equal windows share an anchor at the same shift.
   Anchors that only one document holds are dropped.
3. Extension: around the other anchors, each window of ``WINDOW`` words gets a 128-bit
   hash. Of each hash the smallest id is kept by a partial aggregation, and the
   windows of later documents are found in a join that can be split where a passage is
   very common. No pairs of documents are made.
4. Texts meet their removed windows by id.

Defined results: null and empty texts have no words; rows with a null id are left
whole and remove nothing; rows that share an id but not their words are judged apart,
and do not remove each other's words; an empty table gives an empty result; only the
id and text columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stage
from ledgerloom.llm.textscan import EXACT, Words, chunks, mix, window_hashes, window_starts, words

WINDOW = 50
PERIOD = 31
#: A difference cover modulo 31: each shift is a difference of two of its members.
COVER = (1, 5, 11, 24, 25, 27)
#: Ids are broadcast up to this many; beyond, texts are joined by a shuffle.
MOST_BROADCAST = 2_000_000
#: Windows that hold more than one part in ``HOT_WINDOWS`` of all places are told apart by a broadcast (there are no more than that), and dealt by ``SALTS``.
HOT_WINDOWS, SALTS = 10_000, 64
_SHORT = WINDOW - PERIOD + 1
_TAG = 1 << 32


def _whole(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of each text's word sequence."""
    n = w.counts
    place = np.arange(len(w.hash)) - np.repeat(w.first[:-1], n)
    one = mix(w.hash + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    two = mix(w.hash ^ mix(place.astype(np.uint64) + np.uint64(77)))
    cut = lambda x: np.diff(np.concatenate([[np.uint64(0)], np.cumsum(x)])[w.first])
    return mix(cut(one) + n.astype(np.uint64)).view(np.int64), mix(cut(two)).view(np.int64)


def _tags(one: np.ndarray) -> np.ndarray:
    """24 bits of a text's hash, which tell rows of the same id apart."""
    return (one & 0xFFFFFF) * _TAG


def _sequences(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                w = words(part["text"], EXACT)
                one, two = _whole(w)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(w.counts.astype(np.int64)), pa.array(one), pa.array(two)], ["doc_id", "n", "h1", "h2"])

    return docs.mapInArrow(run, "doc_id long, n long, h1 long, h2 long")


def _anchors(docs: DataFrame) -> DataFrame:
    """Hash, id and place of each anchor."""
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                w = words(part["text"], EXACT)
                one, _ = _whole(w)
                at = window_starts(w.first, _SHORT)
                doc = np.searchsorted(w.first, at, "right") - 1
                place = at - w.first[doc]
                keep = cover[place % PERIOD] & (w.counts[doc] >= WINDOW)
                at, doc, place = at[keep], doc[keep], place[keep]
                hashes = window_hashes(w.hash, _SHORT)[at].view(np.int64) if len(at) else np.zeros(0, np.int64)
                ids = part["doc_id"].to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(ids[doc].astype(np.int64)), pa.array(_tags(one)[doc] + place)], ["h", "doc_id", "spot"])

    return docs.mapInArrow(run, "h long, doc_id long, spot long")


def _windows(docs: DataFrame) -> DataFrame:
    """128-bit hash, id and place of each window around a text's repeated anchors (column spots)."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                w = words(part["text"], EXACT)
                one, _ = _whole(w)
                spots = part["spots"]
                flat = spots.flatten().to_numpy()
                doc = np.repeat(np.arange(len(part)), spots.value_lengths().to_numpy())
                ours = (flat - flat % _TAG) == _tags(one)[doc]
                doc, place = doc[ours], flat[ours] % _TAG
                # windows that hold an anchor start up to PERIOD - 1 words before it
                change = np.zeros(len(w.hash) + 2, np.int32)
                np.add.at(change, w.first[doc] + np.maximum(place - PERIOD + 1, 0), 1)
                np.add.at(change, w.first[doc] + place + 1, -1)
                at = window_starts(w.first, WINDOW)
                at = at[np.cumsum(change)[at] > 0]
                doc = np.searchsorted(w.first, at, "right") - 1
                if not len(at):
                    continue
                w1 = window_hashes(w.hash, WINDOW)[at].view(np.int64)
                w2 = window_hashes(mix(w.hash ^ np.uint64(0xA5A5A5A5A5A5A5A5)), WINDOW)[at].view(np.int64)
                ids = part["doc_id"].to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), pa.array(ids[doc].astype(np.int64)), pa.array(_tags(one)[doc] + at - w.first[doc])], ["w1", "w2", "doc_id", "spot"])

    return docs.mapInArrow(run, "w1 long, w2 long, doc_id long, spot long")


RESULT = "doc_id long, n_words long, n_removed long, kept_text binary, kept_sha256 string"


def _cut(docs: DataFrame, texts: bool) -> DataFrame:
    """Remove each text's windows (column spots), or all of it if its own tag is among tags."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                w = words(part["text"], EXACT)
                one, _ = _whole(w)
                n = w.counts
                spots = part["spots"]
                flat = spots.flatten().to_numpy()
                doc = np.repeat(np.arange(len(part)), spots.value_lengths().to_numpy())
                ours = (flat - flat % _TAG) == _tags(one)[doc]
                at = w.first[doc[ours]] + flat[ours] % _TAG
                change = np.zeros(len(w.hash) + WINDOW + 1, np.int32)
                np.add.at(change, at, 1)
                np.add.at(change, at + WINDOW, -1)
                gone = np.cumsum(change)[: len(w.hash)] > 0
                again = np.array([t in tags for t, tags in zip(_tags(one).tolist(), part["tags"].to_pylist())], bool) & (n >= WINDOW)
                gone |= np.repeat(again, n)
                kept = ~gone
                first = np.concatenate([[0], np.cumsum(kept)])[w.first]
                start, size = w.start[kept], (w.end - w.start)[kept]
                step = size + 1
                end = np.cumsum(step)
                blob = np.full(int(end[-1]) if len(end) else 0, 32, np.uint8)
                inner = np.repeat(end - step, size) + (np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size))
                blob[inner] = w.data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
                raw, cut = blob.tobytes(), np.concatenate([[0], end])[first].tolist()
                out = [raw[a : max(a, b - 1)] for a, b in zip(cut, cut[1:])]
                removed = n - np.diff(first)
                yield pa.RecordBatch.from_arrays([
                    part["doc_id"], pa.array(n.astype(np.int64)), pa.array(removed.astype(np.int64)),
                    pa.array(out if texts else [None] * len(out), pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in out])], ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return docs.mapInArrow(run, RESULT)


def remove_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", texts: bool = True) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, n_removed, kept_text (null unless ``texts``), kept_sha256."""
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    seqs = stage(_sequences(docs), "sequences")
    known = seqs.filter(F.col("doc_id").isNotNull() & (F.col("n") >= WINDOW)).select("doc_id", "n", "h1", "h2")
    least = known.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low <> high")
    # rows that are repeats of a smaller id, told apart from others of their id by their words
    again = stage(known.join(least, ["n", "h1", "h2"]).filter("doc_id > low").select("doc_id", (F.col("h1").bitwiseAND(0xFFFFFF) * _TAG).alias("tag")).distinct(), "again")
    many_ids = known.groupBy("doc_id").agg(F.countDistinct("h1").alias("k")).filter("k > 1")
    clear = again.select("doc_id") if many_ids.isEmpty() else again.select("doc_id").join(many_ids, "doc_id", "left_anti")
    few = again.count() <= MOST_BROADCAST
    first = docs.filter("doc_id IS NOT NULL").join(F.broadcast(clear) if few else clear, "doc_id", "left_anti")

    anchors = _anchors(first)
    shared = anchors.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low <> high").select("h")
    hits = stage(anchors.join(shared, "h", "left_semi").groupBy("doc_id").agg(F.collect_set("spot").alias("spots")), "anchors")
    ids = hits.select("doc_id")
    near = hits.count() <= MOST_BROADCAST
    held = (first.join(F.broadcast(ids), "doc_id", "left_semi") if near else first).join(hits, "doc_id").select("doc_id", "text", "spots")
    windows = _windows(held)
    earliest = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).filter("low <> high").select("w1", "w2", "low", "n")
    earliest = stage(earliest, "earliest")
    # no more than HOT_WINDOWS windows stand in more than that part of all places
    hot = F.col("n") > F.lit(earliest.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0] // HOT_WINDOWS)
    earliest = earliest.withColumn("hot", hot)
    often = F.broadcast(earliest.filter("hot").select("w1", "w2", "hot"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "spot"), F.lit(SALTS))).otherwise(0).alias("salt")
    dealt = windows.join(often, ["w1", "w2"], "left").select("w1", "w2", "doc_id", "spot", salt)
    salts = F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    late = dealt.join(earliest.select("w1", "w2", "low", F.explode(salts).alias("salt")), ["w1", "w2", "salt"]).filter("doc_id > low").select("doc_id", "spot")
    spans = late.groupBy("doc_id").agg(F.collect_set("spot").alias("spots"))
    marks = again.groupBy("doc_id").agg(F.collect_set("tag").alias("tags"))
    change = stage(spans.join(marks, "doc_id", "full"), "removed")

    ids = change.select("doc_id")
    nothing = F.array().cast("array<long>")
    none = docs.select("doc_id", "text", nothing.alias("spots"), nothing.alias("tags"))
    if change.count() <= MOST_BROADCAST:
        rest = none.join(F.broadcast(ids), "doc_id", "left_anti")
        touched = docs.join(F.broadcast(ids), "doc_id", "left_semi").join(change, "doc_id")
    else:
        rest = none.filter("doc_id IS NULL")
        touched = docs.filter("doc_id IS NOT NULL").join(change, "doc_id", "left")
    touched = touched.select("doc_id", "text", F.coalesce("spots", nothing).alias("spots"), F.coalesce("tags", nothing).alias("tags"))
    return _cut(rest, texts).union(_cut(touched, texts))

