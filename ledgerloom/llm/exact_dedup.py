"""Exact deduplication against a minimal perfect hash over historical digests.

Texts are equal when they are identical after white space is deleted; the SHA-256 of
that form is the digest. Rows are split into *historical* ones and *new* ones. The
distinct historical digests are dealt by prefix into shards, and each shard gets a
minimal perfect hash: levels of bit arrays in which every digest has one bit of its
own. The rank of that bit is the slot, and a slot holds the full digest and the
winner's locator (code points, id, row). The distinct new digests look their slot up
and compare all bytes: members join the historical group, nonmembers form groups of
their own. Rows then meet their group in a join on the digest.

Everything before that join is aggregated by digest before it is shuffled, so a group
that holds a third of all rows costs one row a task. Shards hold distinct digests
only, about ``SHARD_KEYS`` each; their number follows the input.

Defined results: null text counts as empty; null ids order after others; of repeated
rows (same id, same text) one is kept; an empty table gives an empty result; other
columns pass through :func:`drop_repeats` untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import free, stage
from ledgerloom.llm.textscan import mix

SHARD_KEYS = 4096
#: Rows (id, digest, size) that are broadcast, at most.
MOST_BROADCAST = 1_000_000
#: Bits of a level for each digest that reaches it.
GAMMA = 2

GROUPS = "digest binary, n_cp long, no_id boolean, keep_id long, keep_row long, group_size long"
INDEX = "shard long, levels binary, bits binary, digests binary, n_cp binary, no_id binary, keep_id binary, keep_row binary, group_size binary"
_LOCATOR = (("n_cp", np.int64), ("no_id", np.uint8), ("keep_id", np.int64), ("keep_row", np.int64), ("group_size", np.int64))


def digest_of(text: Column) -> Column:
    """SHA-256 of a text without ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    for space in " \t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(space), F.lit(""))
    return F.unhex(F.sha2(text, 256))


def default_history(id_column: Column) -> Column:
    """A stated half of the rows, as if stored earlier."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 2 == 0, F.lit(False))


def _distinct(rows: DataFrame, shards: int) -> DataFrame:
    """A row for each digest: its best row so far and its number of rows."""
    best = F.min(F.struct((-F.col("n_cp")).alias("neg"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row")))
    return rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size")).select(
        F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(shards)).alias("shard"), "digest",
        (-F.col("best.neg")).alias("n_cp"), F.col("best.no_id").alias("no_id"), F.coalesce("best.doc_id", F.lit(0)).alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    """A row of 32 bytes for each digest."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _place(digests: np.ndarray, level: int, size: int) -> np.ndarray:
    a, b = np.ascontiguousarray(digests[:, 8:24]).view(np.uint64).T
    return (mix(mix(a + np.uint64(level * 0x9E3779B9 + 1)) ^ b) % np.uint64(size)).astype(np.int64)


def build_levels(digests: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The levels' sizes, all their bits, and each digest's slot."""
    sizes, bits, spot, left, base = [], [], np.zeros(len(digests), np.int64), np.arange(len(digests)), 0
    while len(left):
        if len(sizes) > 200:
            raise ValueError("digests must be distinct")
        size = max(8, GAMMA * len(left))
        at = _place(digests[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        own = alone[at]
        spot[left[own]] = base + at[own]
        bits.append(alone)
        sizes.append(size)
        base += size
        left = left[~own]
    flat = np.concatenate(bits) if bits else np.zeros(0, bool)
    rank = np.cumsum(flat) - 1
    return sizes, flat, rank[spot] if len(digests) else spot


def find_slots(digests: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot that each digest would have; -1 if no level has a bit for it."""
    slot, left, base, rank = np.full(len(digests), -1), np.arange(len(digests)), 0, np.cumsum(bits) - 1
    for level, size in enumerate(sizes):
        if not len(left):
            break
        at = base + _place(digests[left], level, size)
        hit = bits[at]
        slot[left[hit]] = rank[at[hit]]
        left, base = left[~hit], base + size
    return slot


def _build_shard(key: tuple, table: pa.Table) -> pa.Table:
    digests = _digests(table["digest"])
    sizes, bits, slot = build_levels(digests)
    order = np.argsort(slot)
    row = {"shard": key[0].as_py(), "levels": np.array(sizes, np.int64).tobytes(), "bits": np.packbits(bits).tobytes(), "digests": digests[order].tobytes()}
    for name, kind in _LOCATOR:
        row[name] = table[name].to_numpy().astype(kind)[order].tobytes()
    return pa.Table.from_pylist([row], pa.schema([("shard", pa.int64()), *((c, pa.binary()) for c in ("levels", "bits", "digests", *(n for n, _ in _LOCATOR)))]))


def _look_up(index: pa.Table, new: pa.Table) -> pa.Table:
    """All groups of a shard: historical ones, with what the new rows add, and new ones."""
    digests = _digests(new["digest"])
    found = {n: new[n].to_numpy().astype(k) for n, k in _LOCATOR}
    if index.num_rows:
        row = index.to_pylist()[0]
        sizes = np.frombuffer(row["levels"], np.int64).tolist()
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool)
        stored = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        held = {n: np.frombuffer(row[n], k).copy() for n, k in _LOCATOR}
        slot = find_slots(digests, sizes, bits)
        member = slot >= 0
        member[member] = (stored[slot[member]] == digests[member]).all(axis=1)
        at = slot[member]
        ours = [found[n][member] for n in ("n_cp", "no_id", "keep_id", "keep_row")]
        theirs = [held[n][at] for n in ("n_cp", "no_id", "keep_id", "keep_row")]
        better = ours[0] > theirs[0]
        tie = ours[0] == theirs[0]
        for a, b in zip(ours[1:], theirs[1:]):
            better |= tie & (a < b)
            tie &= a == b
        for n, mine in zip(("n_cp", "no_id", "keep_id", "keep_row"), ours):
            held[n][at[better]] = mine[better]
        held["group_size"][at] += found["group_size"][member]
        digests = np.concatenate([stored, digests[~member]])
        found = {n: np.concatenate([held[n], found[n][~member]]) for n, _ in _LOCATOR}
    blob = digests.tobytes()
    return pa.table({"digest": pa.array([blob[i : i + 32] for i in range(0, len(blob), 32)], pa.binary()), **{n: pa.array(found[n].astype(bool) if n == "no_id" else found[n]) for n, _ in _LOCATOR}})


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The sharded minimal perfect hash over the distinct digests of ``history``.

    ``history`` has columns digest, n_cp, doc_id, row. The result can be stored and used
    for later batches through :func:`group_rows`'s parts.
    """
    return _distinct(history, shards).groupBy("shard").applyInArrow(_build_shard, INDEX)


def group_rows(rows: DataFrame) -> DataFrame:
    """All groups of equal digests of ``rows`` (digest, n_cp, doc_id, row, historical)."""
    shards = rows.count() // SHARD_KEYS + 1
    index = build_index(rows.filter("historical"), shards)
    new = _distinct(rows.filter("NOT historical"), shards)
    return index.groupBy("shard").cogroup(new.groupBy("shard")).applyInArrow(_look_up, GROUPS)


def _narrow(docs: DataFrame, id_column: str, text_column: str, history: Column | None) -> DataFrame:
    ident, text = F.col(id_column), F.col(text_column)
    return stage(docs.select(
        ident.cast("long").alias("doc_id"), digest_of(text).alias("digest"), F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("n_cp"),
        F.monotonically_increasing_id().alias("row"), (default_history(ident) if history is None else F.coalesce(history, F.lit(False))).alias("historical")), "digests")


def find_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", history: Column | None = None) -> DataFrame:
    """A row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``history`` marks the rows whose digests go into the perfect hash.
    """
    rows = _narrow(docs, id_column, text_column, history)
    groups = group_rows(rows).select("digest", F.when(~F.col("no_id"), F.col("keep_id")).alias("keep_id"), "keep_row", "group_size")
    return rows.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", history: Column | None = None) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    Texts stay where they are: the rows that go (id, digest, size) are found first, and
    taken out by a broadcast while they are few, else by a join on all three.
    """
    rows = _narrow(docs, id_column, text_column, history)
    digest, size, at, keep, many = free(docs, "digest_", "n_cp_", "at_", "keep_", "many_")
    best = group_rows(rows).select("digest", F.when(~F.col("no_id"), F.col("keep_id")).alias("best_id"), F.col("n_cp").alias("best_n"))
    marked = rows.join(best, "digest").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("n_cp") == F.col("best_n")))
    # rows that are equal in all three are one here; a winner that is stored in several such rows passes once
    marked = stage(marked.groupBy("digest", "doc_id", "n_cp", "stays").agg(F.count("*").alias("many")).filter("NOT stays OR many > 1"), "marked")
    marked = marked.select(F.col("digest").alias(at), F.col("doc_id").alias(keep), F.col("n_cp").alias(size), "stays", F.col("many").alias(many))
    few = marked.count() <= MOST_BROADCAST
    read = docs.withColumns({digest: digest_of(F.col(text_column)), f"{many}n": F.coalesce(F.char_length(text_column), F.lit(0)).cast("long")})
    same = (F.col(digest) == F.col(at)) & F.col(id_column).cast("long").eqNullSafe(F.col(keep)) & (F.col(f"{many}n") == F.col(size))

    def meets(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        right = right.select(at, keep, size)
        return left.join(F.broadcast(right) if few else right, same, how)

    again = marked.filter("stays")
    kept = meets(read, marked.filter("NOT stays"), "left_anti")
    if not again.isEmpty():
        kept = meets(kept, again, "left_anti").unionByName(meets(kept, again, "left_semi").withColumn(keep, F.col(id_column).cast("long")).dropDuplicates([digest, keep]).drop(keep))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
