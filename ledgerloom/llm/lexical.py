"""Ranked lexical search over a length-stratified index.

A document of n terms has the normaliser ``m = 75 + (25 n N) div L``, and all of a
term's weight in a document follows from tf and m. So documents of equal m form a
*stratum*; within it a term's postings are runs of documents of one tf, highest first,
and a run's impact ``(10**9 tf) div (1000 tf + 12 m)`` is worked out once. A stratum's
bound for a query is the sum of its terms' first runs; strata are visited by falling
bound, until the bound lies below the score of the last place.

One pass over the texts counts lengths, which gives N, L and all normalisers; a second
one hashes terms and sends each document's distinct ones, with their tf, to a block of
the index. Blocks cover ranges of m of about ``BLOCK_TERMS`` terms; a stratum that is
larger, as that of many equal texts, is dealt over several blocks. Each stratum of a
block is a row of the index: packed arrays, sorted by term. The index holds every term
of every document; searches read what they need of it.

Queries go to all rows of the index in blocks of ``QUERY_BYTES``; each task keeps its best
documents for each query, and these meet in two steps.

Terms are told apart by 64 bits of hash, equal up to the case of A-Z. Defined results:
null and empty texts have no terms, are not counted in N and never found; a query
without terms, or with none that a document holds, has no rows; repeated query rows are
answered one by one; null ids come after others of the same score; an empty table on either side gives
an empty result; only the id and text columns are read, so that others may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import stage
from ledgerloom.llm.textscan import FOLDED, NO_TERM, chunks, words

#: Terms of a block of the index, about; bytes of a block of queries, about.
BLOCK_TERMS, QUERY_BYTES = 400_000, 8 << 20
#: Groups in which the tasks' best documents meet first.
_GROUPS = 64
INDEX = "block long, m long, n_docs long, doc_ids binary, no_id binary, terms binary, first_run binary, run_tf binary, run_end binary, members binary"
_EXACT = 1 << 53


@dataclass
class Corpus:
    """Documents with a term, all their terms, and which block each normaliser's documents go to."""

    n_docs: int
    n_terms: int
    normalisers: np.ndarray
    first_block: np.ndarray
    blocks: np.ndarray

    def normaliser(self, lengths: np.ndarray) -> np.ndarray:
        return 75 + 25 * lengths * self.n_docs // self.n_terms


def measure(docs: DataFrame, text_column: str = "text", block_terms: int = BLOCK_TERMS) -> Corpus:
    """Count the lengths of all texts. Distinct lengths (of k terms in all, at most the root of 2k) pass through the driver."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                n, many = np.unique(words(part["text"], None, NO_TERM).counts, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(many, pa.int64())], ["n", "many"])

    rows = docs.select(F.col(text_column).alias("text")).mapInArrow(run, "n long, many long").filter("n > 0").groupBy("n").agg(F.sum("many").alias("many")).collect()
    n, many = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
    corpus = Corpus(int(many.sum()), int((n * many).sum()), *(np.zeros(0, np.int64),) * 3)
    if len(n):
        m, at = np.unique(corpus.normaliser(n), return_inverse=True)
        size = np.bincount(at, weights=n * many).astype(np.int64)
        before = np.cumsum(size) - size
        corpus.normalisers, corpus.first_block = m, before // block_terms
        corpus.blocks = np.maximum(1, -(-size // block_terms))
    return corpus


def _vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the texts; their distinct terms one text after the other, each with its tf; where each text's begin."""
    found = words(texts, FOLDED, NO_TERM)
    doc = found.doc
    order = np.lexsort((found.hash, doc))
    term, doc = found.hash[order], doc[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return found.counts, term[at], np.diff(np.append(at, len(term))).astype(np.uint32), np.searchsorted(doc[at], np.arange(len(texts) + 1))


def _packed(values: np.ndarray, first: np.ndarray) -> list[bytes]:
    blob, size = values.tobytes(), values.itemsize
    cut = (first * size).tolist()
    return [blob[a:b] for a, b in zip(cut, cut[1:])]


def build_index(docs: DataFrame, corpus: Corpus, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The index, a row for each stratum of each block, by the columns of ``INDEX``."""

    def run(batches):
        turn = TaskContext.get().partitionId()  # deals a large stratum's documents over its blocks
        for batch in batches:
            for part in chunks(batch):
                n, terms, tf, first = _vectors(part["text"])
                m = corpus.normaliser(n)
                at = np.minimum(np.searchsorted(corpus.normalisers, m), len(corpus.normalisers) - 1)
                block = corpus.first_block[at] + (turn + np.arange(len(n))) % corpus.blocks[at]
                turn += len(n)
                rows = pa.RecordBatch.from_arrays(
                    [pa.array(block, pa.int64()), pa.array(m, pa.int64()), part["doc_id"], pa.array(_packed(terms, first), pa.binary()), pa.array(_packed(tf, first), pa.binary())],
                    ["block", "m", "doc_id", "terms", "tf"])
                yield rows.filter(pa.array(n > 0))

    if not corpus.n_docs:
        return docs.sparkSession.createDataFrame([], INDEX)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, "block long, m long, doc_id long, terms binary, tf binary").groupBy("block").applyInArrow(_stratify, INDEX)


def _stratify(key: tuple, table: pa.Table) -> pa.Table:
    """A block's strata."""
    m, no_id = table["m"].to_numpy(), table["doc_id"].is_null().to_numpy()
    ids = table["doc_id"].fill_null(0).to_numpy()
    order = np.lexsort((ids, no_id, m))
    m, no_id, ids = m[order], no_id[order], ids[order]
    held = table.select(["terms", "tf"]).take(pa.array(order))
    terms, tf = (np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in held[c]]) for c, kind in (("terms", np.uint64), ("tf", np.uint32)))
    doc = np.repeat(np.arange(len(m), dtype=np.int32), pc.binary_length(held["terms"]).to_numpy() // 8)
    edge = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
    stratum = np.repeat(np.arange(len(edge), dtype=np.int32), np.diff(np.append(edge, len(m))))[doc]
    by = np.lexsort((~tf, terms, stratum))  # stable: equal tf leaves documents in order
    terms, tf, doc, stratum = terms[by], tf[by], doc[by], stratum[by]
    new_term = np.append(True, (terms[1:] != terms[:-1]) | (stratum[1:] != stratum[:-1]))
    new_run = new_term | np.append(True, tf[1:] != tf[:-1])
    run_at, term_at = np.flatnonzero(new_run), np.flatnonzero(new_term)
    run_end = np.append(run_at[1:], len(terms))
    term_run = np.searchsorted(run_at, term_at)
    out = []
    for s, a in enumerate(edge.tolist()):
        b = int(edge[s + 1]) if s + 1 < len(edge) else len(m)
        p, q = np.searchsorted(stratum, (s, s + 1))
        t, u = np.searchsorted(term_at, (p, q))
        r, e = np.searchsorted(run_at, (p, q))
        out.append((
            key[0].as_py(), int(m[a]), b - a, ids[a:b].astype(np.int64).tobytes(), no_id[a:b].tobytes(), terms[term_at[t:u]].tobytes(),
            np.append(term_run[t:u] - r, e - r).astype(np.uint32).tobytes(), tf[run_at[r:e]].tobytes(), (run_end[r:e] - p).astype(np.uint32).tobytes(), (doc[p:q] - a).astype(np.uint32).tobytes()))
    kinds = [pa.int64()] * 3 + [pa.binary()] * 7
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[c.split()[0] for c in INDEX.split(", ")])


@dataclass
class Queries:
    """A block of queries: for each its terms (as places among all distinct ones), occurrences, and the terms' weights."""

    ids: list
    first: np.ndarray
    at: np.ndarray
    times: np.ndarray
    terms: np.ndarray
    weight: np.ndarray

    def bounds(self, worth: np.ndarray) -> np.ndarray:
        """Each query's sum of its terms' ``worth``."""
        total = np.concatenate([[0], np.cumsum(self.times * worth[self.at])])
        return total[self.first[1:]] - total[self.first[:-1]]


def _column(batch: pa.RecordBatch, row: int, name: str, kind) -> np.ndarray:
    return np.frombuffer(batch.column(name)[row].as_buffer(), kind)


class _Stratum:
    """One row of the index, cut down to the terms of a block of queries."""

    def __init__(self, batch: pa.RecordBatch, row: int, queries: Queries):
        self.batch, self.row = batch, row
        m, self.n_docs = batch["m"][row].as_py(), batch["n_docs"][row].as_py()
        terms, first, tf, end = (_column(batch, row, n, k) for n, k in (("terms", np.uint64), ("first_run", np.uint32), ("run_tf", np.uint32), ("run_end", np.uint32)))
        place = np.minimum(np.searchsorted(terms, queries.terms), len(terms) - 1)
        self.held = np.flatnonzero(terms[place] == queries.terms)
        begin, stop = first[place[self.held]].astype(np.int64), first[place[self.held] + 1].astype(np.int64)
        values = np.unique(tf)
        impact = (10**9 * values.astype(np.int64) // (1000 * values.astype(np.int64) + 12 * m))  # one for each tf
        self.tf, self.values, self.impact, self.end, self.begin, self.stop = tf, values, impact, end, begin, stop
        worth = np.zeros(len(queries.terms), np.int64)
        worth[self.held] = queries.weight[self.held] * impact[np.searchsorted(values, tf[begin])]
        self.bound = queries.bounds(worth)
        self.scored = None

    def _open(self, queries: Queries) -> None:
        """Each held term's documents and what the term adds to them."""
        members = _column(self.batch, self.row, "members", np.uint32)
        runs = np.arange((self.stop - self.begin).sum()) + np.repeat(self.begin - np.cumsum(self.stop - self.begin) + (self.stop - self.begin), self.stop - self.begin)
        start = np.where(runs > 0, self.end[runs - 1], 0).astype(np.int64)
        size = self.end[runs] - start
        docs = members[np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)].astype(np.int64)
        adds = np.repeat(self.impact[np.searchsorted(self.values, self.tf[runs])], size)
        of_term = np.bincount(np.repeat(np.arange(len(self.held)), self.stop - self.begin), weights=size, minlength=len(self.held)).astype(np.int64)
        edge = np.zeros(len(queries.terms) + 1, np.int64)
        edge[self.held + 1] = of_term
        self.scored = np.cumsum(edge), docs, adds * np.repeat(queries.weight[self.held], of_term)

    def scores(self, queries: Queries, q: int) -> np.ndarray:
        """All documents' scores for one query."""
        if self.scored is None:
            self._open(queries)
        edge, docs, adds = self.scored
        own = slice(queries.first[q], queries.first[q + 1])
        parts = [(int(edge[t]), int(edge[t + 1]), n) for t, n in zip(queries.at[own].tolist(), queries.times[own].tolist())]
        which = np.concatenate([docs[a:b] for a, b, _ in parts])
        what = np.concatenate([adds[a:b] if n == 1 else adds[a:b] * n for a, b, n in parts])
        if self.bound[q] < _EXACT:
            return np.bincount(which, weights=what, minlength=self.n_docs).astype(np.int64)
        out = np.zeros(self.n_docs, np.int64)
        np.add.at(out, which, what)
        return out

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        return _column(self.batch, self.row, "doc_ids", np.int64), _column(self.batch, self.row, "no_id", np.bool_)


def best_of(strata: list[_Stratum], queries: Queries, best: list[list[tuple]], places: int) -> int:
    """Visit strata by falling bound for each query and keep its best (negative score, no id, id); gives the number of visits."""
    visits = 0
    bounds = np.stack([s.bound for s in strata])
    for q in range(len(queries.ids)):
        for s in np.argsort(-bounds[:, q], kind="stable").tolist():
            bound, top = bounds[s, q], best[q]
            least = -top[-1][0] if len(top) == places else 1
            if bound < least:
                break
            visits += 1
            score = strata[s].scores(queries, q)
            hit = np.flatnonzero(score >= least)
            if len(hit) > places:
                edge = np.partition(score[hit], len(hit) - places)[len(hit) - places]
                hit = hit[score[hit] >= edge]
            ids, none = strata[s].ids()
            # a tie at the edge may be of any size: its smallest ids come first in a stratum
            order = np.lexsort((ids[hit], none[hit], -score[hit]))[:places]
            best[q] = sorted(top + [(-int(score[k]), bool(none[k]), int(ids[k])) for k in hit[order]])[:places]
    return visits


def _query_blocks(queries: DataFrame, id_column: str, text_column: str) -> Iterator[tuple[list, list, list]]:
    """Blocks of queries: their ids, distinct terms and occurrences."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                _, terms, tf, first = _vectors(part["text"])
                yield pa.RecordBatch.from_arrays([part["id"], part["row"], pa.array(_packed(terms, first), pa.binary()), pa.array(_packed(tf, first), pa.binary())], ["id", "row", "terms", "tf"])

    kind = queries.schema[id_column].dataType.simpleString()
    rows = queries.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).withColumn("row", F.monotonically_increasing_id())
    packed = stage(rows.mapInArrow(run, f"id {kind}, row long, terms binary, tf binary").filter("length(terms) > 0"), "queries")
    size = packed.agg(F.sum(F.length("terms") + F.length("tf"))).head()[0] or 0
    blocks = size // QUERY_BYTES + 1
    for k in range(blocks if size else 0):
        own = packed.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == k).collect()
        if own:
            yield [(r.row, r.id) for r in own], [np.frombuffer(r.terms, np.uint64) for r in own], [np.frombuffer(r.tf, np.uint32).astype(np.int64) for r in own]


def _holders(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How many documents hold each of these terms (sorted), which are those of one block of queries."""

    def run(batches):
        many = np.zeros(len(terms), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                held, first, end = (_column(batch, row, n, k) for n, k in (("terms", np.uint64), ("first_run", np.uint32), ("run_end", np.uint32)))
                place = np.minimum(np.searchsorted(held, terms), len(held) - 1)
                at = np.flatnonzero(held[place] == terms)
                ends = np.append(0, end).astype(np.int64)
                many[at] += ends[first[place[at] + 1]] - ends[first[place[at]]]
        at = np.flatnonzero(many)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(many[at], pa.int64())], ["at", "many"])

    found = index.select("terms", "first_run", "run_end").mapInArrow(run, "at long, many long").groupBy("at").agg(F.sum("many").alias("many")).collect()
    df = np.zeros(len(terms), np.int64)
    for r in found:
        df[r.at] = r.many
    return df


def search(index: DataFrame, corpus: Corpus, queries: DataFrame, places: int = 20, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """The best documents of each query: item_id, rank (from 1), doc_id, score. ``index`` should be a stored table."""
    spark = index.sparkSession
    kind = queries.schema[id_column].dataType.simpleString()
    found = None
    for ids, terms, times in _query_blocks(queries, id_column, text_column):
        every, at = np.unique(np.concatenate(terms), return_inverse=True)
        df = _holders(index, every).tolist()
        weight = np.array([math.floor(1000 * math.log((2 * corpus.n_docs + 2) / (2 * n + 1))) for n in df], np.int64)
        first = np.concatenate([[0], np.cumsum([len(t) for t in terms])])
        shared = spark.sparkContext.broadcast(Queries([row for row, _ in ids], first, at, np.concatenate(times), every, weight))
        name = {"row": [row for row, _ in ids], "id": [i for _, i in ids]}

        def run(batches, shared=shared):
            block = shared.value
            best: list[list[tuple]] = [[] for _ in block.ids]
            for batch in batches:
                for a in range(0, batch.num_rows, 256):
                    part = batch.slice(a, 256)
                    best_of([_Stratum(part, row, block) for row in range(part.num_rows)], block, best, places)
            rows = [(row, None if none else i, -s) for row, own in zip(block.ids, best) for s, none, i in own]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["row", "doc_id", "score"])

        own = index.mapInArrow(run, "row long, doc_id long, score long").withColumn("task", F.spark_partition_id() % _GROUPS)
        for keys in (("row", "task"), ("row",)):
            rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
            own = own.withColumn("rank", rank).filter(F.col("rank") <= places)
        names = spark.createDataFrame(list(zip(name["row"], name["id"])), f"row long, item_id {kind}")
        own = own.join(F.broadcast(names), "row").select("item_id", "rank", "doc_id", "score")  # as many rows as the block has queries
        found = own if found is None else found.unionByName(own)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if found is None else found
