import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOW) for t in TERM.findall(text or "")]


def brute(docs, queries, places=20):
    """(item, rank, doc, score) of the best documents, all scored."""
    held = [(i, Counter(t), len(t)) for i, t in ((i, terms(x)) for i, x in docs) if t]
    big_n, big_l = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    w = {t: math.floor(1000 * math.log((2 * big_n + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in queries:
        own = []
        for i, c, n in held:
            m = 75 + 25 * n * big_n // big_l
            score = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                own.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(own)[:places])]
    return sorted(out, key=repr)


def told(docs, queries, places=20, block_terms=lexical.BLOCK_TERMS):
    corpus = lexical.measure(docs, block_terms=block_terms)
    index = lexical.stage(lexical.build_index(docs, corpus), "index")
    return index, sorted(map(tuple, lexical.search(index, corpus, queries, places).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def many(seed=5):
    """Documents of all lengths over words of falling frequency, with repeated terms, copies and other scripts."""
    rng = random.Random(seed)
    names = [f"W{k}" if k % 3 else f"é{k}漢" for k in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    docs = [(i, rng.choice([" ", "-", "\x00", "’ "]).join(rng.choices(names, weights, k=rng.choice([1, 2, 5, 30, 30, 200])))) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(60)] + [(2000, None), (2001, ""), (2002, " ,;"), (-4, "w1 W1 w1"), (None, docs[3][1]), (None, "w2")]
    queries = [(k, " ".join(rng.choices(names, weights, k=rng.choice([1, 3, 40])))) for k in range(30)] + [(100, None), (101, ""), (102, "unknown words"), (103, "w1"), (103, "w1"), (104, docs[3][1]), (None, "w5 w5 w5")]
    return docs, queries


@pytest.fixture(scope="module")
def tables(spark):
    docs, queries = many()
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(queries, "item_id long, text string").repartition(2), docs, queries


@pytest.mark.parametrize("block_terms", [200, lexical.BLOCK_TERMS])
def test_search_equals_brute_force(tables, block_terms):
    """Blocks of 200 terms: the stratum of sixty copies, of which all tie, lies in several blocks."""
    docs, queries, rows, asked = tables
    index, got = told(docs, queries, block_terms=block_terms)
    assert got == brute(rows, asked)
    if block_terms == 200:
        assert index.groupBy("m").count().filter("count > 1").count() > 0


def test_blocks_of_queries(tables, monkeypatch):
    docs, queries, rows, asked = tables
    monkeypatch.setattr(lexical, "QUERY_BYTES", 300)
    assert told(docs, queries, places=3)[1] == brute(rows, asked, 3)


def test_index_holds_every_term(tables):
    docs, _, rows, _ = tables
    corpus = lexical.measure(docs, block_terms=300)
    index = lexical.build_index(docs, corpus).collect()
    lengths = [len(terms(x)) for _, x in rows]
    assert (corpus.n_docs, corpus.n_terms) == (sum(n > 0 for n in lengths), sum(lengths))
    found = Counter()
    for row in index:
        first, tf, end, members = (np.frombuffer(row[c], np.uint32) for c in ("first_run", "run_tf", "run_end", "members"))
        names, ids = np.frombuffer(row.terms, np.uint64), np.frombuffer(row.doc_ids, np.int64)
        assert (np.diff(names.astype(object)) > 0).all() and len(ids) == row.n_docs
        for t in range(len(names)):
            runs = range(first[t], first[t + 1])
            assert all(tf[a] > tf[b] for a, b in zip(runs, runs[1:]))
            for r in runs:
                for d in members[(end[r - 1] if r else 0) : end[r]]:
                    found[int(ids[d]), int(tf[r])] += 1
    want = Counter((i or 0, n) for i, x in rows for n in Counter(terms(x)).values())
    assert found == want


def test_bounds_skip_strata(tables):
    """A stratum whose bound lies below the last place is not visited."""
    docs, queries, rows, asked = tables
    corpus = lexical.measure(docs)
    index = lexical.build_index(docs, corpus).toArrow().combine_chunks().to_batches()[0]
    ids, words, times = next(lexical._query_blocks(queries, "item_id", "text"))
    every, at = np.unique(np.concatenate(words), return_inverse=True)
    block = lexical.Queries([r for r, _ in ids], np.concatenate([[0], np.cumsum([len(t) for t in words])]), at, np.concatenate(times), every, np.full(len(every), 1000))
    strata = [lexical._Stratum(index, row, block) for row in range(index.num_rows)]
    best = [[] for _ in ids]
    visits = lexical.best_of(strata, block, best, 3)
    assert 0 < visits < sum((s.bound > 0).sum() for s in strata)
    for q in range(len(ids)):
        every_score = sorted((s for x in strata for s in x.scores(block, q).tolist() if x.bound[q] and s), reverse=True)
        assert [-b[0] for b in best[q]] == every_score[:3]
        assert all(x.scores(block, q).max() <= x.bound[q] for x in strata if x.bound[q])


def test_large_scores_stay_whole():
    stratum = lexical._Stratum.__new__(lexical._Stratum)
    block = lexical.Queries([0], np.array([0, 2]), np.array([0, 1]), np.array([1, 3]), np.array([5, 9], np.uint64), np.array([1, 1]))
    stratum.n_docs, stratum.bound = 2, np.array([1 << 60])
    stratum.scored = np.array([0, 2, 3]), np.array([0, 1, 1]), np.array([(1 << 58) + 1, 7, (1 << 57) + 1])
    assert stratum.scores(block, 0).tolist() == [(1 << 58) + 1, 7 + 3 * ((1 << 57) + 1)]


def test_odd_rows(spark, odd, none):
    asked = [(1, "lorem q"), (2, "a b"), (3, "z")]
    queries = spark.createDataFrame(asked, "item_id long, text string").withColumn("row", F.lit(1)).withColumn("terms", F.lit("x"))
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = told(odd, queries)[1]
    assert got == brute(rows, asked)
    assert told(none, queries)[1] == []
    assert told(odd, queries.limit(0))[1] == []
