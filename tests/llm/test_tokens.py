import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import bpe, importance, jpeg, lm, packing, queries
from test_dedup import words

ODD_TEXTS = ["<|endoftext|>a<|endoftext|>", " \n\n x  y\t\t", "don't I'll x²³ ٣٤ 漢字 🤦🏼‍♂️\x1c\x1d a\x85b\xa0c ", "a" * 5000, "=-" * 500, "_a_b__ 12_3 'S's ''s", "İstanbul ŉ ſ Ÿ Ɓ é ÀÉ"]


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def texts(spark, rows):
    return rows + [(1000 + k, t) for k, t in enumerate(ODD_TEXTS)]


def test_bpe_equals_the_library(spark, texts):
    tokenizer = library("byte_bpe_50k.json")
    got = {r.doc_id: r for r in bpe.round_trip(spark.createDataFrame(texts, "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json")).collect()}
    for i, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(got[i].ids), np.uint32).tolist() == ids, text
        assert bytes(got[i].decoded).decode() == tokenizer.decode(ids, skip_special_tokens=False) == (text or "")


def test_bpe_odd_rows(odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert bpe.round_trip(none, path).count() == 0
    got = bpe.round_trip(odd, path).collect()
    assert len(got) == 8 and {r.n_tokens for r in got if r.doc_id in (3, 4)} == {0}


def test_packing_pieces_and_sequences(spark, texts):
    tokenizer = library("word_bpe_49k.json")
    done = packing.pack_documents(spark.createDataFrame(texts, "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"), capacity=256).collect()
    by_doc, by_bin = {}, {}
    for r in done:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = 0
    for i, text in texts:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], np.uint32)
        total += len(ids)
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in pieces] == [(k, a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes())) for k, a in enumerate(range(0, len(ids), 256))]
    for own in by_bin.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert -(-total // 256) <= len(by_bin) <= len(packing.best_fit([r.length for r in done], 256))


def test_packing_over_several_groups(spark, monkeypatch):
    """Several groups and rounds use fewer sequences than best fit over all pieces at once."""
    monkeypatch.setattr(packing, "GROUP", 150)
    rng = random.Random(3)
    rows = [(k, 0, 0, rng.randint(25, 50), 0) for k in range(600)]
    done = packing.pack(spark.createDataFrame(rows, packing.PIECES), 128).collect()
    assert sorted((r.doc_id, r.length) for r in done) == sorted((r[0], r[3]) for r in rows)
    fill = Counter()
    for r in sorted(done, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 128
    assert len(fill) < len(packing.best_fit([r[3] for r in rows], 128))


def test_local_search_empties_a_bin():
    lengths = [6, 3, 5, 4, 1, 1]
    bins = packing.local_search([[0, 1], [2, 3], [4, 5]], lengths, 10)
    assert len(bins) == 2 and sorted(sum(bins, [])) == list(range(6))


@pytest.mark.parametrize(("low", "high"), [(1000, 2000), (700, 1500), (600, 1100)])
def test_local_search_beats_best_fit(low, high, monkeypatch):
    lengths = np.random.default_rng(low).integers(low, high, 1500).tolist()
    first = packing.best_fit(lengths, 4096)
    squares = []
    apply = packing._OpenBins.apply

    def noted(self, k, step):
        before = int((self.fill**2).sum())
        apply(self, k, step)
        squares.append((before, int((self.fill**2).sum())))
        assert self.fill.tolist() == [sum(lengths[i] for i in b) for b in self.items]

    monkeypatch.setattr(packing._OpenBins, "apply", noted)
    bins = packing.local_search(first, lengths, 4096)
    assert sorted(sum(bins, [])) == list(range(1500)) and max(sum(lengths[i] for i in b) for b in bins) <= 4096
    assert len(bins) < len(first)
    assert squares and all(a < b for a, b in squares)


def test_local_search_leaves_no_step():
    """No move, one-for-one or two-for-one exchange between two bins raises the sum of squared fills any more."""
    lengths = np.random.default_rng(8).integers(3, 40, 60).tolist()
    bins = packing.local_search(packing.best_fit(lengths, 100), lengths, 100)
    fill = [sum(lengths[i] for i in b) for b in bins]
    of = lambda b: {0: [0], 1: [lengths[i] for i in b], 2: [lengths[b[i]] + lengths[b[j]] for i in range(len(b)) for j in range(i)]}
    sums = [of(b) for b in bins]
    for a in range(len(bins)):
        for b in range(len(bins)):
            for give, back in ((1, 0), (1, 1), (2, 1), (1, 2)):
                for d in {x - y for x in sums[b][give] for y in sums[a][back]} if a != b and fill[a] < 100 and fill[b] < 100 else ():
                    assert not 0 < d <= 100 - fill[a] or fill[a] + d <= fill[b]


def test_packing_odd_rows(odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.pack_documents(none, path).count() == 0
    assert packing.pack_documents(odd, path).filter("piece = 0").count() == 8


def crc(i):
    return zlib.crc32(str(i).encode())


def brute_lm(rows, strength):
    """By id: held out, tokens, known tokens, base score and score, from dictionaries of counts and a recursion over histories."""
    texts = {i: words(t, fold=True) + [None] for i, t in rows}
    count, history = Counter(), Counter()
    for i, own in texts.items():
        if crc(i) % 7 != 2:
            said = ["<start>", *own]
            for k in range(1, len(said)):
                for n in range(min(k, 2) + 1):
                    count[tuple(said[k - n : k + 1])] += 1
                    history[tuple(said[k - n : k])] += 1
    size, types = history[()], len([g for g in count if len(g) == 1])

    def weight(past, word):
        if not past:
            return (count[word,] + 1) / (size + types + 1)
        lower = weight(past[1:], word)
        s = strength[len(past) - 1]
        return (count[(*past, word)] + s * lower) / (history[past] + s) if history[past] else lower

    out = {}
    for i, own in texts.items():
        said = ["<start>", *own]
        steps = [(tuple(said[max(0, k - 2) : k]), said[k]) for k in range(1, len(said))]
        out[i] = crc(i) % 7 == 2, len(own), sum(count[w,] > 0 for w in own), sum(math.log10(weight((), w)) for w in own), sum(math.log10(weight(*s)) for s in steps)
    known = {w for (w,) in (g for g in count if len(g) == 1)}
    for past in random.Random(1).sample(sorted((h for h in history if h), key=str), 20):
        if None not in past:
            assert sum(weight(past, w) for w in known) + weight(past, "never seen") == pytest.approx(1)
    return size, out


@pytest.mark.parametrize("block", [4 << 20, 2000])
def test_lm_equals_brute_force(docs, rows, monkeypatch, block):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block)
    monkeypatch.setattr(lm, "BUCKET_BYTES", block)
    for strength in ((3.0, 0.5), lm.STRENGTH):
        size, want = brute_lm(rows, strength)
        got = {r.doc_id: r for r in lm.score_texts(docs, strength=strength).collect()}
        assert len(got) == len(rows)
        for i, (held, n, known, base, score) in want.items():
            r = got[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, size)
            assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_follows_failure_arcs_one_by_one():
    """A trigram state without the arc fails to its bigram state, and that to the empty history."""
    counts = [np.array([5, 4, 0]), np.array([2, 0, 0]), np.array([0, 0, 0])]
    base, score = lm.walk(counts, np.array([0, 3]), 100, 10, 6, (2.0, 1.0))
    uni = [6 / 111, 5 / 111, 1 / 111]
    assert 10**base == pytest.approx(uni)
    first = (2 + 2 * uni[0]) / (6 + 2)
    second = 1 / (2 + 1) * 2 / (5 + 2) * uni[1]  # both states known, no arc
    third = 2 / (4 + 2) * uni[2]  # the pair before was never seen: no trigram state
    assert 10**score == pytest.approx([first, second, third])


def test_lm_odd_rows(odd, none):
    assert lm.score_texts(none).count() == 0
    got = lm.score_texts(odd).collect()
    assert len(got) == 8 and all(not r.held_out for r in got if r.doc_id is None) and all(math.isfinite(r.score) for r in got)


def test_importance_keeps_the_largest_keys(docs, labels, rows):
    got = importance.select_texts(docs, labels, keep=40).collect()
    assert len(got) == len(rows)
    order = sorted(got, key=lambda r: -r.sample_key)
    assert {r.doc_id for r in order[:40]} == {r.doc_id for r in got if r.kept}
    assert {r.log_weight for r in got if not words(dict(rows)[r.doc_id])} == {0.0}


def test_importance_equals_brute_force(spark, docs, labels, rows):
    """Weights from n-grams counted in plain Python; keys from the noise's stated formula; the k largest by sorting."""
    from pyspark.sql import functions as F

    grams = {}
    for i, text in rows:
        own = words(text, fold=True)
        grams[i] = [(w,) for w in own] + list(zip(own, own[1:]))
    bucket = {}
    for gram in {g for own in grams.values() for g in own}:
        at, _ = importance._ngrams(pa.array([" ".join(gram)]))
        bucket[gram] = int(at[-1])  # the text's only bigram stands last
    raw, target = Counter(), Counter()
    for i, own in grams.items():
        raw.update(bucket[g] for g in own)
        if i % 3:
            target.update(bucket[g] for g in own)
    n, m = sum(raw.values()), sum(target.values())

    def weight(g):
        share = (raw[bucket[g]] + 1) / (n + importance.BUCKETS)
        return math.log((target[bucket[g]] + 200 * share) / (m + 200)) - math.log(share)

    hashed = {r.i: r.h for r in spark.createDataFrame([(i,) for i in grams], "i long").select("i", F.xxhash64("i", F.lit(61)).alias("h")).collect()}
    want = {}
    for i, own in grams.items():
        total = sum(weight(g) for g in own)
        want[i] = total, total - math.log(-math.log((hashed[i] % (1 << 40) + 0.5) / (1 << 40)))
    got = {r.doc_id: r for r in importance.select_texts(docs, labels, keep=40).collect()}
    assert got.keys() == want.keys()
    for i, (total, key) in want.items():
        assert got[i].log_weight == pytest.approx(total, abs=1e-6) and got[i].sample_key == pytest.approx(key, abs=1e-6)
    assert {i for i, r in got.items() if r.kept} == set(sorted(want, key=lambda i: -want[i][1])[:40])


def test_importance_tells_target_from_raw(spark):
    rng = random.Random(4)
    good, bad = [[f"{p}{k}" for k in range(40)] for p in "gb"]
    rows = [(i, " ".join(rng.choices(good if i % 4 else bad, k=40))) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 200, 2)], "doc_id long, quality int")
    got = importance.select_texts(spark.createDataFrame(rows, "doc_id long, text string"), labels, keep=150).collect()
    assert all(r.kept == (r.doc_id % 4 > 0) for r in got)


def test_importance_odd_rows(odd, none, labels):
    assert importance.select_texts(none, labels).count() == 0
    got = importance.select_texts(odd, labels.limit(0), keep=3).collect()
    assert len(got) == 8 and sum(r.kept for r in got) == 3 and {r.log_weight for r in got} == {0.0}


def test_jpeg_round_trip(spark, texts):
    got = {r.doc_id: r for r in jpeg.media_columns(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, text in texts:
        raw = (text or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert bytes(got[i].payload) == payload and got[i].n_bytes == len(raw)
        media = bytes(got[i].media)
        assert media[:2] == b"\xff\xd8" and media[-2:] == b"\xff\xd9" and hashlib.sha256(media)
        assert (got[i].width, got[i].height) == (8 * 192, 8 * len(payload) // 192)
    assert len({r.feature for r in got.values()}) > 50


def test_jpeg_reads_other_codes_and_several_frames():
    samples = np.random.default_rng(1).integers(0, 256, 192 * 8200, dtype=np.uint8)
    media = jpeg.write_media(samples, [8200])
    frames, back = jpeg.decode_dc(media)[0]
    assert len(frames) == 2 and (back == samples).all()
    # one block: DC difference 5 (category 3), then AC: run 2 size 1, then the end of block, without restart markers
    lengths, symbols = [0, 2, *[0] * 14], [0x21, 0x00]
    bits = "100" + "101" + "00" + "1" + "01"
    scan = int(bits + "1" * (-len(bits) % 8), 2).to_bytes(-(-len(bits) // 8), "big")
    head = b"\xff\xd8" + jpeg._segment(0xDB, bytes([0, *[16] * 64])) + jpeg._segment(0xC0, b"\x08\x00\x08\x00\x08\x01\x01\x11\x00") + jpeg._segment(0xC4, bytes([0, *jpeg.DC_LENGTHS, *jpeg.DC_SYMBOLS])) + jpeg._segment(0xC4, bytes([0x10, *lengths, *symbols]))
    media = head + jpeg._segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    assert jpeg.decode_dc([media])[0][1].tolist() == [128 + 10]
    with pytest.raises(ValueError):
        jpeg.parse(b"no image")


def test_jpeg_odd_rows(odd, none):
    assert jpeg.media_columns(none).count() == 0
    assert jpeg.media_columns(odd).count() == 8


def test_jpeg_query_takes_the_tail_as_bytes(spark, tmp_path):
    texts = ["é" * 96, "a" * 191 + "漢" + "b" * 182 + "漢字", "漢" * 64, "x" * 189 + "🤦", None, "", "plain"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op10_jpeg(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert got[i].tail_crc32 == zlib.crc32(payload[-16:]), text
