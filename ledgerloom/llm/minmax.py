"""Near-duplicate detection with min-max hashing.

A document's set holds its distinct word shingles, as 64-bit hashes. Under each of 64
permutations both the smallest and the largest value are kept: 128 signature values
for 64 hash evaluations a shingle. Bands of these values make candidates; every link
is confirmed on the full sets.

Work and shuffles stay in proportion to the rows:

1. Documents with equal sets form a class; only its representative goes on.
2. In each bucket (equal band) the smallest representative leads, and every member is
   compared with it alone. Confirmed links give components.
3. Buckets whose members are still in several components are taken up again: their
   members' sets are compared inside a task, block against block, by counting through
   an index of the block's shingles. Links that join two components leave the task;
   pairs that don't, and links within what is joined already, stay in it.

With threshold 0.85 (bands of 5 values, 25 of them) a link is missed by all bands with
probability 4e-7; with 0.8 (bands of 4, 32 of them) 5e-8.

Defined results: null and empty texts have an empty set and are linked with nothing;
rows that share an id are one node; rows with a null id are linked with nothing and
kept, with a null component; an empty table gives an empty result; other columns pass
through :func:`drop_near_copies` untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import free, stage
from ledgerloom.llm.components import connected_components
from ledgerloom.llm.textscan import FOLDED, chunks, mix, window_hashes, window_starts, words

PERMUTATIONS = 64
#: Ids of documents with candidates are broadcast up to this many; beyond, joined by a shuffle.
MOST_BROADCAST = 2_000_000
#: Members of a bucket, and shingles of theirs (32 MB), that one task compares with as many others.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 22
#: Buckets with very many members meet their leader in a broadcast; there are at most so many.
HOT_KEYS = 2000
SIGNATURES = "doc_id long, n long, h1 long, h2 long, bands array<long>"

_multiply = np.random.default_rng(7).integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def banding(percent: int) -> tuple[int, int]:
    """Values in a band, and bands, for a threshold in hundredths."""
    return (5, 25) if percent >= 84 else (4, 32) if percent >= 79 else (3, 42)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sets of shingle hashes, sorted within each text, and where each begins."""
    w = words(texts, FOLDED)
    n = w.counts
    starts = window_starts(w.first, size)
    hashes = window_hashes(w.hash, size)[starts] if len(starts) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(n)), np.maximum(n - size + 1, 0))
    for k in range(1, size):
        short = np.flatnonzero(n == k)
        if len(short):
            hashes = np.concatenate([hashes, window_hashes(w.hash, k, salt=k)[w.first[short]]])
            doc = np.concatenate([doc, short])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(n) + 1))


def _signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    rows, bands = banding(percent)

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                hashes, first = shingle_sets(part["text"], size)
                n = np.diff(first)
                some = np.flatnonzero(n)
                at = first[some]
                values = np.zeros((len(some), 2 * PERMUTATIONS), np.uint64)
                if len(some):
                    for p in range(PERMUTATIONS):
                        moved = hashes * _multiply[p]
                        values[:, 2 * p] = np.minimum.reduceat(moved, at)
                        values[:, 2 * p + 1] = np.maximum.reduceat(moved, at)
                values = mix(values)
                h1, h2 = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                keys = np.zeros((len(some), bands), np.uint64)
                if len(some):
                    h1[some] = np.add.reduceat(mix(hashes), at).view(np.int64)
                    h2[some] = np.add.reduceat(mix(hashes ^ np.uint64(0x5DEECE66D)), at).view(np.int64)
                    for b in range(bands):
                        key = np.full(len(some), b + 1, np.uint64)
                        for r in range(rows):
                            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, b * rows + r])
                        keys[:, b] = key
                count = np.zeros(len(n) + 1, np.int32)
                count[1 + some] = bands
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(count, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n, pa.int64()), pa.array(h1), pa.array(h2), lists], ["doc_id", "n", "h1", "h2", "bands"])

    return docs.mapInArrow(run, SIGNATURES)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                hashes, first = shingle_sets(part["text"], size)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes.view(np.int64)))], ["doc_id", "items"])

    return docs.mapInArrow(run, "doc_id long, items array<long>")


def _sets_of(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """The sets (doc_id, items) of the documents in ``ids``."""
    ids = stage(ids, "ids")
    return stage(_sets(docs.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids, "doc_id", "left_semi"), size), "sets")


def _confirm(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    sets = _sets_of(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct(), size)
    a = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("items_a"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("items_b"))
    both = F.size(F.array_intersect("items_a", "items_b"))
    linked = both * 100 >= (F.size("items_a") + F.size("items_b") - both) * percent
    return stage(pairs.join(a, "a").join(b, "b").filter(linked).select("a", "b").distinct(), "links")


def _links_between(percent: int):
    """Links between members of two blocks of a bucket that join different components: at most one fewer than components."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rep, block = table["rep"].to_numpy(), table["block"].to_numpy()
        label = np.unique(table["comp"].to_numpy(), return_inverse=True)[1]
        items = table["items"].combine_chunks()
        n = items.value_lengths().to_numpy()
        first, flat = np.concatenate([[0], np.cumsum(n)]), items.flatten().to_numpy()
        one, two = np.flatnonzero(block == key[1].as_py()), block == key[2].as_py()
        mine = np.repeat(two, n)
        order = np.argsort(flat[mine], kind="stable")
        shingle, owner = flat[mine][order], np.repeat(np.arange(len(n)), n)[mine][order]
        out_a, out_b = [], []
        for i in one:
            if (label[two] == label[i]).all():
                continue
            own = flat[first[i] : first[i + 1]]
            low, high = np.searchsorted(shingle, own, "left"), np.searchsorted(shingle, own, "right")
            size = high - low
            at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
            both = np.bincount(owner[at], minlength=len(n))
            for j in np.flatnonzero((both > 0) & (100 * both >= percent * (n + n[i] - both))):
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    out_a.append(min(rep[i], rep[j]))
                    out_b.append(max(rep[i], rep[j]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def find_components(docs: DataFrame, size: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked when their sets of ``size``-word shingles have a Jaccard
    similarity of ``percent`` hundredths or more.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    signed = stage(_signatures(docs, size, percent), "signatures")
    some = signed.filter("n > 0 AND doc_id IS NOT NULL")
    classes = stage(some.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    keyed = classes.select(F.explode("bands").alias("key"), "rep", "n")
    leaders = keyed.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("lead"), F.count("*").alias("members")).filter("members > 1")
    leaders = stage(leaders.select("key", F.col("lead.rep").alias("lead"), F.col("lead.n").alias("lead_n"), "members"), "leaders")
    # no more than HOT_KEYS buckets hold more than that part of all rows
    hot = F.col("members") > F.lit(classes.count() * banding(percent)[1] // HOT_KEYS)
    often = F.broadcast(leaders.filter(hot))
    keyed = keyed.join(often, "key").unionByName(keyed.join(often.select("key"), "key", "left_anti").join(leaders.filter(~hot), "key"))
    keyed = stage(keyed, "buckets")
    close = F.least("n", "lead_n") * 100 >= F.greatest("n", "lead_n") * percent
    pairs = stage(keyed.filter((F.col("lead") != F.col("rep")) & close).select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    comp = connected_components(_confirm(docs, pairs, size, percent))
    open_ = keyed.filter("members > 2").select("key", "rep", "n", "lead").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("comp", "rep").alias("comp"))
    mixed = open_.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("members"), F.sum("n").alias("shingles"))
    mixed = mixed.filter("low <> high").select("key", F.ceil(F.greatest(F.col("members") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    open_ = stage(open_.join(mixed, "key"), "open")
    if not open_.isEmpty():
        own = F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int")
        dealt = open_.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        sets = _sets_of(docs, open_.select(F.col("rep").alias("doc_id")).distinct(), size).withColumnRenamed("doc_id", "rep")
        dealt = dealt.join(sets, "rep").select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "rep", "comp", "block", "items")
        more = stage(dealt.groupBy("key", "low", "high").applyInArrow(_links_between(percent), "a long, b long").distinct(), "links")
        of = comp.withColumnRenamed("comp", "c")
        joined = more.join(of.withColumnRenamed("node", "a").withColumnRenamed("c", "ca"), "a", "left").join(of.withColumnRenamed("node", "b").withColumnRenamed("c", "cb"), "b", "left")
        joined = joined.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        over = connected_components(joined).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        nodes = comp.join(over, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
        alone = over.join(comp, over.comp == comp.node, "left_anti").select(F.col("comp").alias("node"), F.col("top").alias("comp"))
        comp = stage(nodes.union(alone), "labels")
    tops = classes.select("h1", "h2", "n", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", "n", F.coalesce("comp", "rep").alias("comp"))
    with_class = some.select("doc_id", "h1", "h2", "n").join(tops, ["h1", "h2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))
    rest = signed.filter("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return with_class.union(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one document of each component, all columns as they were."""
    found = stage(find_components(docs, size, percent, id_column, text_column).filter("NOT kept").select("doc_id").distinct(), "near")
    gone, = free(docs, "gone_")
    gone_ids = found.select(F.col("doc_id").alias(gone))
    gone_ids = F.broadcast(gone_ids) if found.count() <= MOST_BROADCAST else gone_ids
    return docs.join(gone_ids, F.col(id_column).cast("long") == F.col(gone), "left_anti")
