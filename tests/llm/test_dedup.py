import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from ledgerloom.llm import components, exact_dedup, minmax, substring

SPACE = re.compile("[\x20\x09-\x0d]+")


def words(text, fold=False):
    text = text or ""
    if fold:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return [w for w in SPACE.split(text) if w]


def test_exact_dedup_equals_brute_force(docs, rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[SPACE.sub("", text or "")].append((-len(text or ""), i))
    got = {r.doc_id: r for r in exact_dedup.find_repeats(docs).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        key = SPACE.sub("", text or "")
        keep = min(groups[key])[1]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (keep, len(groups[key]), keep == i, hashlib.sha256(key.encode()).hexdigest())


def test_exact_dedup_against_stored_history(spark):
    from pyspark.sql import functions as F

    rows = [(i, f"text {i % 7}" + " " * (i % 5)) for i in range(40)]
    got = exact_dedup.find_repeats(spark.createDataFrame(rows, "doc_id long, text string"), history=F.col("doc_id") < 20).collect()
    best = {k: min((-len(t), i) for i, t in rows if i % 7 == k)[1] for k in range(7)}
    assert all(r.keep_id == best[r.doc_id % 7] for r in got)


def test_perfect_hash_is_minimal_and_checked():
    keys = np.random.default_rng(0).integers(0, 256, (5000, 32), dtype=np.uint8)
    sizes, bits, slot = exact_dedup.build_levels(keys[:4000])
    assert sorted(slot) == list(range(4000))
    assert (exact_dedup.find_slots(keys[:4000], sizes, bits) == slot).all()
    found = exact_dedup.find_slots(keys[4000:], sizes, bits)
    assert found.max() < 4000  # other keys may hit a slot; its bytes decide


def test_exact_dedup_odd_rows(odd, none):
    assert exact_dedup.find_repeats(none).count() == 0
    assert exact_dedup.drop_repeats(none).columns == none.columns
    kept = exact_dedup.drop_repeats(odd)
    assert kept.columns == odd.columns
    assert sorted(((r.doc_id is None, r.doc_id or 0) for r in kept.collect())) == [(False, 1), (False, 2), (False, 3), (False, 5), (True, 0)]
    assert sum(r.kept for r in exact_dedup.find_repeats(odd).collect()) == 5


def sets(rows, size):
    out = {}
    for i, text in rows:
        w = words(text, fold=True)
        out[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    return out


def brute_components(rows, size, percent):
    shingles = sets(rows, size)
    parent = {i: i for i in shingles}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(shingles)
    for a in ids:
        for b in ids:
            both = len(shingles[a] & shingles[b])
            if a < b and both and 100 * both >= percent * len(shingles[a] | shingles[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(shingles[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_copies_equal_brute_force(docs, rows, size, percent):
    want = brute_components(rows, size, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minmax.find_components(docs, size, percent).collect()}
    assert got == want


def test_near_copies_in_large_open_buckets(spark, monkeypatch):
    """A group whose members are linked along chains and not with its smallest id, dealt over several blocks."""
    monkeypatch.setattr(minmax, "BLOCK", 8)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows, text = [], list(base)
    for i in range(60):
        text = list(text)
        text[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(text)))
    rng.shuffle(rows)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    want = brute_components(rows, 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minmax.find_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == want


def test_near_copies_odd_rows(odd, none):
    assert minmax.find_components(none).count() == 0
    got = minmax.find_components(odd).collect()
    assert len(got) == 8
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert {r.n_shingles for r in got if r.doc_id in (3, 4)} == {0}
    kept = minmax.drop_near_copies(odd, size=1, percent=70)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 1, 2, 3, 4]


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.comp for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(51)}, **{k: 100 for k in range(100, 140)}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_passages(rows, size=50):
    held = {}
    seqs = {i: words(t) for i, t in rows}
    for i, w in seqs.items():
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            held[key] = min(held.get(key, i), i)
    out = {}
    for i, w in seqs.items():
        gone = set()
        for k in range(len(w) - size + 1):
            if held[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_passages_equal_brute_force(docs, rows):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_passages(docs).collect()}
    want = brute_passages(rows)
    assert got == want
    assert sum(n for _, n, _ in want.values()) > 500


def test_difference_cover_holds_every_shift():
    shifts = {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER}
    assert shifts == set(range(substring.PERIOD))


def test_passages_odd_rows(odd, none, spark):
    assert substring.remove_passages(none).count() == 0
    got = substring.remove_passages(odd).collect()
    assert len(got) == 8 and sum(r.n_removed for r in got) == 0
    a, b = [" ".join(f"{p}{k}" for k in range(70)) for p in "ab"]
    rows = [(1, a), (1, b), (2, f"start {a} end"), (2, b), (None, a)]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 70, 0), (1, 70, 0), (1, 70, 0), (2, 70, 70), (2, 72, 70)]


def test_open_buckets_in_blocks_of_few_shingles(spark, monkeypatch):
    """Blocks cut by their shingles, each of a few sets, give the same components."""
    words = [f"w{n}" for n in range(60)]
    rows = [(k, " ".join([*words[:k], f"x{k}", *words[k + 1 :]])) for k in range(40)] + [(100 + k, " ".join(f"y{k}z{n}" for n in range(50))) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {tuple(r) for r in minmax.find_components(docs, 3, 85).collect()}
    monkeypatch.setattr(minmax, "BLOCK_SHINGLES", 150)
    assert {tuple(r) for r in minmax.find_components(docs, 3, 85).collect()} == whole
