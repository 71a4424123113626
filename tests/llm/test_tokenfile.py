import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import rangecoder, tokenfile

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(VOCABULARY)
ENCODER = tokenfile.Encoder(open(VOCABULARY, "rb").read())


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 511, 3000])
@pytest.mark.parametrize("vocabulary", [1, 2, 300, 50257, 65536, 200_000])
def test_blocks_come_back(n, vocabulary):
    rng = np.random.default_rng(n + vocabulary)
    for ids in (rng.integers(0, vocabulary, n), np.minimum(rng.geometric(0.05, n), vocabulary - 1), np.full(n, vocabulary - 1), np.arange(n) % 7 % vocabulary):
        ids = ids.astype(np.uint32)
        assert (rangecoder.decode_block(rangecoder.encode_block(ids, vocabulary), n, vocabulary) == ids).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=900), st.integers(10, 70_000))
def test_any_block_comes_back(ids, vocabulary):
    ids = np.array(ids, np.uint32)
    assert (rangecoder.decode_block(rangecoder.encode_block(ids, vocabulary), len(ids), vocabulary) == ids).all()


def test_each_order_helps():
    """Independent ids cost about their entropy; ids that follow from the last one or two cost far less."""
    rng = np.random.default_rng(3)
    n = 200_000
    bits = lambda ids: 8 * len(rangecoder.encode_block(ids.astype(np.uint32), 4096)) / n
    weights = 1 / np.arange(1, 501)
    weights /= weights.sum()
    alone = rng.choice(500, n, p=weights)
    assert bits(alone) < -(weights * np.log2(weights)).sum() + 0.7
    follow, pair = rng.integers(0, 500, 500), rng.integers(0, 500, (500, 500))
    one, two = alone.copy(), alone.copy()
    keep = rng.random(n) < 0.9
    for k in range(2, n):
        if keep[k]:
            one[k] = follow[one[k - 1]]
            two[k] = pair[two[k - 2] % 20, two[k - 1] % 20] % 20
    assert bits(one) < 0.35 * bits(alone)
    assert bits(two) < 0.6 * bits(alone)


def write(tmp_path, documents, block=None):
    path = str(tmp_path / "x.tok")
    files, name = tokenfile._open(path)
    writer = tokenfile.FileWriter(files.open_output_stream(name), 50257, 2)
    for i, ids in documents:
        writer.add([i], np.array(ids, np.uint32), np.array([len(ids)]))
    assert writer.close() == (len(documents), sum(len(ids) for _, ids in documents), len(open(path, "rb").read()))
    return path


def read(path):
    with pa.OSFile(path) as source:
        return [(i, ids.tolist()) for i, ids in tokenfile.read_file(source)]


def test_documents_cross_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(rangecoder, "BLOCK", 100)
    rng = np.random.default_rng(1)
    documents = [(i if i % 5 else None, rng.integers(0, 50257, size).tolist()) for i, size in enumerate([3, 0, 250, 97, 1, 100, 100, 640, 2])]
    assert read(write(tmp_path, documents)) == documents
    assert read(write(tmp_path, [])) == []


def test_damage_is_found(tmp_path):
    path = write(tmp_path, [(1, list(range(3000))), (2, [5, 6])])
    whole = open(path, "rb").read()
    for at in (20, 40, 2000, len(whole) - 60, len(whole) - 3):
        with open(path, "wb") as file:
            file.write(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :])
        with pytest.raises(ValueError):
            read(path)


def brute(rows):
    """Per document in rising order of ids, from the library itself."""
    start, out = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def told(spark, docs):
    found = tokenfile.read_tokens(spark, tokenfile.write_tokens(docs, VOCABULARY)).collect()
    return sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in found), key=lambda r: r[1])


ALPHABET = st.sampled_from(["a", "B", "é", "漢", "1", "'s", "'", ".", "  ", " ", "\n", "\t", "\x1c", "\u00a0", "\u2003", "“", "e\u0301", "<|endoftext|>", "\u3000", "🎉", "\r\n", "don't", "x" * 70])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(ALPHABET, max_size=14).map("".join), st.text(max_size=20)), max_size=6))
def test_pieces_give_the_librarys_ids(texts):
    ids, counts = ENCODER(pa.array(texts, pa.string()))
    want = [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_encoder_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(tokenfile, "REMEMBERED", 50)
    monkeypatch.setattr(tokenfile.Encoder, "PROBES", 1)
    encoder = tokenfile.Encoder(open(VOCABULARY, "rb").read())
    for k in range(8):
        texts = [" ".join(f"w{k * 20 + j}q{j}" for j in range(30)) for _ in range(3)]
        assert encoder(pa.array(texts))[0].tolist() == [i for t in texts for i in LIBRARY.encode(t, add_special_tokens=False).ids]


def test_files_hold_the_librarys_ids(spark, rows, monkeypatch):
    more = [(1000, "it's <|endoftext|> don't"), (1001, "a b    c\x1c d\u0085\n\n e"), (1002, "ỗ 漢字 🎉🎉 <|endoftext|>"), (-7, "minus seven"), (1 << 40, "far")]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string").repartition(4)
    assert told(spark, docs) == brute(rows + more)


def test_odd_rows(spark, odd, none):
    got = told(spark, odd)
    assert got == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert told(spark, none) == []
