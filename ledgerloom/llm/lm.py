"""Language-model scores from a weighted backoff automaton over all trigrams, bigrams and words.

States are histories: two words, one word (or the start of a text), and the empty one. A
state has an arc for every n-gram of the training texts that begins with it, and one
failure arc to the history without its first word. With c the training count, h the
history's count, and p' the weight that the next shorter history gives the word, an arc
weighs (c + s p') / (h + s) and the failure arc s / (h + s), so each state's
probabilities sum to one; ``STRENGTH`` holds s. The empty history's arcs are add-one
unigrams, with one part for unknown words. One pass from left to right carries the
state; where it has no arc, failure arcs are followed one by one.

All n-grams are counted, none is pruned, and the counts are never gathered in one place:
texts are cut into blocks, each block hands in its distinct n-grams once, with its own
training counts, and gets back by how much the totals differ from these. N-grams are
dealt into buckets by ranges of their hashes; what a block has for a bucket is one row of
packed numbers, and a bucket holds about as much as a few blocks, whatever the corpus'
size. A key has at most one entry a block, so the commonest n-gram is small beside the
texts it stands for. A block meets its answers in one task and needs no other part of
the model. Numbers of tokens, distinct words and training texts are all that reaches the
driver.

N-grams are told apart by 56 bits of hash and their order; with 1e9 of them the chance
that a given one shares its hash is 1e-8.

Defined results: null and empty texts hold the end token alone; rows with a null id
are learned from and not held out; repeated rows are counted and scored each; with no
training text every probability is that of an unknown word; an empty table gives an
empty result; only the id and text columns are read. ``docs`` is read twice and must
give the same rows in the same partitions; a block that differs raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stage
from ledgerloom.llm.textscan import FOLDED, chunks, crc_held_out, mix, words

#: Pseudo-counts given to the next shorter history, of bigrams and of trigrams.
STRENGTH = (800.0, 5.0)
#: Bytes of text in a block, at least and at most, and blocks in between; a longer text is a block of its own.
BLOCK_BYTES, MOST_BLOCK_BYTES, BLOCKS = 3 << 20, 32 << 20, 20_000
#: Bytes of text whose n-grams a bucket holds, about.
BUCKET_BYTES = 4 << 20
#: Hash of the end token, which no word has but by chance, and of the start state.
END, START = np.uint64(0x81AC_FFFF_FFFF_FFFF), np.uint64(0x5EED_0F0A_11E7_E875)
#: Bits of a key: a hash, and in the last two the n-gram's order.
KEY_BITS = 58
_ASKED = "bucket long, block long, checksum long, n long, keys binary, counts binary"
_ANSWERS = "block long, bucket long, checksum long, n long, more binary, tokens long, types long, texts long"


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, ends included, and where each text begins."""
    w = words(texts, FOLDED)
    n = w.counts
    out = np.full(len(w.hash) + len(n), END, np.uint64)
    out[np.arange(len(w.hash)) + np.repeat(np.arange(len(n)), n)] = w.hash
    return out, w.first + np.arange(len(w.first))


def ngram_keys(tokens: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Keys of the word, bigram and trigram that end at each token; 0 for the trigram of a text's first token."""
    one = np.append(START, tokens[:-1])[: len(tokens)]
    one[first[:-1]] = START
    two = np.append(START, one[:-1])[: len(tokens)]
    pair = mix(one * np.uint64(0x9E3779B97F4A7C15) + tokens)
    keys = [mix(tokens), pair, mix(mix(two + np.uint64(0x5851F42D)) * np.uint64(0x9E3779B97F4A7C15) + pair)]
    keys = [(k >> np.uint64(64 - KEY_BITS)) & ~np.uint64(3) | np.uint64(n + 1) for n, k in enumerate(keys)]
    keys[2][first[:-1]] = 0
    return keys


def _distinct(keys: list[np.ndarray], train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, in order, and how often each stands in training texts."""
    flat, learned = np.concatenate(keys), np.tile(train, len(keys))
    flat, learned = flat[flat != 0], learned[flat != 0]
    found, at = np.unique(flat, return_inverse=True)
    return found, np.bincount(at[learned], minlength=len(found))


def _checksum(keys: list[np.ndarray]) -> int:
    return int(np.sum(mix(keys[1])).view(np.int64))


def _pack(numbers: np.ndarray) -> bytes:
    """Whole numbers byte by byte, first all lowest bytes, without the bytes that all have zero; what is alike lies together for compression."""
    wide = max(1, -(-int(numbers.max()).bit_length() // 8))
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes()


def _unpack(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(-1, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel()


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.Table]]:
    """A task's rows in blocks of about ``most`` bytes, with their numbers."""
    number = TaskContext.get().partitionId() << 24
    held, size = [], 0
    for batch in batches:
        for part in chunks(batch):
            if held and size + part.nbytes > most:
                yield number, pa.Table.from_batches(held)
                number, held, size = number + 1, [], 0
            held.append(part)
            size += part.nbytes
    if held:
        yield number, pa.Table.from_batches(held)


def _asked(docs: DataFrame, most: int, bits: int, modulus: int, remainder: int) -> DataFrame:
    """What each block has for each of ``2 ** bits`` buckets: differences of its sorted keys, and their training counts."""

    def run(batches):
        for number, table in _blocks(batches, most):
            tokens, first = tokens_of(table["text"].combine_chunks())
            keys = ngram_keys(tokens, first)
            train = np.repeat(~crc_held_out(table["doc_id"].to_pylist(), modulus, remainder), np.diff(first))
            found, c = _distinct(keys, train)
            bucket = (found >> np.uint64(KEY_BITS - bits)).astype(np.int64)
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            rows = [(_pack(np.diff(found[a:b], prepend=np.uint64(0))), _pack(c[a:b]), b - a) for a, b in zip(cut, [*cut[1:], len(found)])]
            n = len(rows)
            yield pa.RecordBatch.from_arrays([
                pa.array(bucket[cut]), pa.array(np.full(n, number)), pa.array(np.full(n, _checksum(keys))), pa.array([r[2] for r in rows], pa.int64()),
                pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], [f.split()[0] for f in _ASKED.split(", ")])

    return docs.mapInArrow(run, _ASKED)


def _add_up(end: int):
    """For each block of a bucket, by how much its keys' totals differ from its counts; the bucket's numbers of words with its first row."""

    def run(table: pa.Table) -> pa.Table:
        sizes = table["n"].to_pylist()
        keys = [np.cumsum(_unpack(k, n)) for k, n in zip(table["keys"].to_pylist(), sizes)]
        counts = np.concatenate([_unpack(c, n) for c, n in zip(table["counts"].to_pylist(), sizes)]).astype(np.int64)
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, counts, len(found)).astype(np.int64)
        more = np.split(total[at] - counts, np.cumsum(sizes)[:-1])
        word = (found & np.uint64(3) == 1) & (total > 0)
        sums = [int(total[word].sum()), int(word.sum()), int(total[found == end].sum())]
        columns = [table["block"], table["bucket"], table["checksum"], table["n"], pa.array([_pack(m) for m in more], pa.binary())]
        columns += [pa.array([x] + [0] * (len(table) - 1), pa.int64()) for x in sums]
        return pa.table(dict(zip([f.split()[0] for f in _ANSWERS.split(", ")], columns)))

    return run


def _dealt(docs: DataFrame, most: int) -> DataFrame:
    """The rows of ``docs`` with their blocks' numbers."""

    def run(batches):
        for number, table in _blocks(batches, most):
            yield from table.append_column("block", pa.array(np.full(len(table), number))).to_batches()

    return docs.mapInArrow(run, "doc_id long, text string, block long")


def walk(counts: list[np.ndarray], first: np.ndarray, tokens: int, types: int, texts: int, strength: tuple[float, float] = STRENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Log10 weights of each step, by unigrams alone and through the automaton.

    ``counts`` holds for each token the training counts of the word, bigram and trigram that end at it.
    """
    before = [np.append(0, c[:-1])[: len(c)] for c in counts]
    before[0][first[:-1]] = texts
    arc = (counts[0] + 1.0) / (tokens + types + 1)
    base = np.log10(arc)
    arcs, fails, states = [arc], [np.ones(len(arc))], [np.ones(len(arc), bool)]
    for c, h, s in zip(counts[1:], before, strength):
        known = h > 0
        if len(arcs) == 2:
            known[first[:-1]] = False  # a text's first token has the start state before it, and no longer one
        arcs.append((c + s * arcs[-1]) / (h + s))
        fails.append(s / (h + s))
        states.append(known)
    score, left = np.zeros(len(arc)), np.ones(len(arc), bool)
    for order in (2, 1, 0):
        here = left & states[order]
        taken = here & (counts[order] > 0) if order else here
        score[taken] += np.log10(arcs[order][taken])
        failed = here & ~taken
        score[failed] += np.log10(fails[order][failed])
        left &= ~taken
    return base, score


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score_block(size: tuple[int, int, int], modulus: int, remainder: int, strength: tuple[float, float]):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        tokens, first = tokens_of(texts["text"].combine_chunks())
        keys = ngram_keys(tokens, first)
        ids = texts["doc_id"]
        held_out = crc_held_out(ids.to_pylist(), modulus, remainder)
        found, total = _distinct(keys, np.repeat(~held_out, np.diff(first)))
        answers = answers.sort_by("bucket")
        more = np.concatenate([_unpack(m, n) for m, n in zip(answers["more"].to_pylist(), answers["n"].to_pylist())]).astype(np.int64)
        if set(answers["checksum"].to_pylist()) != {_checksum(keys)} or len(more) != len(found):
            raise ValueError("the rows of docs changed between two reads")
        total = total + more
        counts = [np.where(k == 0, 0, total[np.minimum(np.searchsorted(found, k), len(found) - 1)]) for k in keys]
        base, score = walk(counts, first, *size, strength)
        add = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  no text is without tokens
        columns = [ids.combine_chunks(), held_out, np.diff(first), add((counts[0] > 0).astype(np.int64)), np.full(len(ids), size[0]), add(base), add(score)]
        return pa.table({f.split()[0]: c for f, c in zip(RESULT.split(", "), columns)})

    return run


def score_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", modulus: int = 7, remainder: int = 2, strength: tuple[float, float] = STRENGTH) -> DataFrame:
    """A row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Rows whose crc32 of the id as text gives ``remainder`` modulo ``modulus`` are held out.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).head()[0]
    most = min(max(BLOCK_BYTES, size // BLOCKS), MOST_BLOCK_BYTES)
    end = int(ngram_keys(np.array([END]), np.array([0, 1]))[0][0])
    asked = _asked(docs, most, (size // BUCKET_BYTES).bit_length(), modulus, remainder)
    answers = stage(asked.groupBy("bucket").applyInArrow(_add_up(end), _ANSWERS), "answers")
    known = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "types", "texts"))).head()
    own = answers.select("block", "bucket", "checksum", "n", "more").groupBy("block")
    return _dealt(docs, most).groupBy("block").cogroup(own).applyInArrow(_score_block(tuple(known), modulus, remainder, strength), RESULT)
