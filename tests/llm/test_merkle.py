import random
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import merkle
from ledgerloom.llm.queries import _fold_case

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
H = lambda text: sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def leaf_of(row):
    return H(b"".join(b"-" if v is None else str(len(str(v).encode())).encode() + b":" + str(v).encode() for v in row))


def brute(rows, change=None):
    """(id, leaf, subroot, root, folded, proof) of each row, from whole trees."""
    trees = defaultdict(list)
    for row in rows:
        seen = change(row) if change else row
        trees[row[2]].append((row[0] is None, row[0] or 0, leaf_of(row), leaf_of(seen)))

    def tree(nodes):
        """The root, and each node's steps."""
        steps, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[k : k + 8] for k in range(0, len(nodes), 8)]
            for k, place in enumerate(at):
                run = runs[place // 8]
                steps[k].append(("".join(run[: place % 8]), "".join(run[place % 8 + 1 :])))
                at[k] = place // 8
            nodes = [H("".join(run)) for run in runs]
        return nodes[0], steps

    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    held = {g: (sorted(trees[g]), *tree([x[2] for x in sorted(trees[g])])) for g in order}
    root, tops = tree([held[g][1] for g in order]) if order else (None, [])
    out = []
    for g, top in zip(order, tops):
        for (null, number, leaf, seen), steps in zip(held[g][0], held[g][2]):
            path = steps + top
            folded = seen
            for before, after in path:
                folded = H(before + folded + after)
            out.append((None if null else number, leaf, held[g][1], root, folded, tuple(path)))
    return sorted(out, key=repr)


def told(docs, **more):
    rows = merkle.build_manifest(docs, COLUMNS, **more).withColumn("item", F.col("item").cast("long")).collect()
    return sorted(((r.item, r.leaf, r.subroot, r.root, r.folded, tuple((s.before, s.after) for s in r.proof)) for r in rows), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)


@pytest.mark.parametrize("sizes", [[1], [8, 1], [9, 64, 65], [200, 3, 513, 17, 1, 7, 8, 9, 64, 2]])
def test_parts_climb_to_the_whole_trees_root(spark, sizes):
    """Parts of eight leaves: up to three rounds, with last subtrees of every raggedness, and more than eight trees."""
    rng = random.Random(sum(sizes))
    ids = rng.sample(range(-5000, 5000), sum(sizes))
    rows = []
    for k, size in enumerate(sizes):
        rows += [(ids.pop(), f"s{k}", None if k == 1 else f"é{k}", rng.choice([None, 7]), rng.choice(["Ab", "ÄBC", "", None])) for _ in range(size)]
    assert told(frame(spark, rows), height=1) == brute(rows)


def test_tampered_rows_fold_to_another_root(spark):
    rows = [(k, "s", "en" if k % 3 else "de", 5, "Upper ÄÖ" if k % 2 else "lower ÄÖ") for k in range(90)]
    import zlib

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    change = lambda r: r if zlib.crc32(str(r[0]).encode()) % 3 else (*r[:4], r[4].translate(low))
    got = told(frame(spark, rows), change=_fold_case, height=1)
    assert got == brute(rows, change)
    bad = {r[0] for r in got if r[4] != r[3]}
    assert bad == {r[0] for r in rows if r[0] % 2 and change(r) != r} and bad


def test_one_hot_tree_and_repeated_rows(spark):
    rows = [(1, "s", "en", 1, "same")] * 300 + [(k, None, "en", None, "x") for k in range(300, 330)] + [(None, "s", None, 1, "n"), (None, None, None, None, None)]
    assert told(frame(spark, rows), height=1) == brute(rows)
    assert told(frame(spark, rows)) == brute(rows)


def test_odd_rows(spark, odd, none):
    docs = odd.selectExpr("*", "'q' AS source", "'de' AS lang", "'t' AS tree", "'i' AS item", "'l' AS leaf")
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    assert told(docs) == brute(rows)
    assert told(none) == []


def test_fold():
    assert merkle.fold("a", []) == "a"
    assert merkle.fold("a", [("x", "y"), ("", "")]) == H(H("xay"))
