"""Token ids of documents in files of coded blocks, in order of the documents' ids.

Texts are dealt by ranges of ids and sorted inside each range; a task encodes its texts
with the tokenizers library, appends the end id to each, and writes one file as it
goes, holding no more than a block and the places of its documents. A file has a head,
blocks of up to ``rangecoder.BLOCK`` ids, an index of documents and a foot::

    head    magic, vocabulary size, end id
    block   number of ids, payload bytes, crc32 of the ids, crc32 of the payload; payload
    index   ids (int64), null marks (one byte each), numbers of ids (int64)
    foot    place of the index, documents, ids, crc32 of the index, magic

All numbers are little endian. Blocks are coded by ``rangecoder``; each starts from an
empty model and can be checked and decoded without the others. A task that is run
again writes a file under a new name, and only files that the manifest names are read.
The manifest has one row for each file.

Defined results: null and empty texts are a single end id; null document ids come
first; rows with one id are ordered by their text; an empty table gives no file and an
empty result; only the id and text columns are read, so that others may have any name.
A damaged file raises ``ValueError``.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import rangecoder
from ledgerloom.llm.common import read_path, scratch, stage, wide
from ledgerloom.llm.textscan import EXACT, SPACE, _byte_powers, chunks, mix, text_bytes

MAGIC = b"TOKBLK01"
_HEAD, _BLOCK, _FOOT = struct.Struct("<8sII"), struct.Struct("<IIII"), struct.Struct("<QQQI8s")
#: Pieces that a worker remembers.
REMEMBERED = 1_500_000
MANIFEST = "part int, path string, n_docs long, n_tokens long, n_bytes long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path in the shared folder, and the path there."""
    uri = re.sub("^file:/(?=[^/])", "file:///", uri)
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


#: White space beyond ASCII and what may be taken for it, by their first two bytes in UTF-8; and the third, if it counts.
_GAPS = {(0xC2, 0x85): None, (0xC2, 0xA0): None, (0xE1, 0x9A): {0x80}, (0xE2, 0x80): {*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF}, (0xE2, 0x81): {0x9F}, (0xE3, 0x80): {0x80}}
_FIRST = np.zeros(256, bool)
_FIRST[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_OTHER = np.zeros(256, bool)
_OTHER[[b for b in range(33, 127) if not _LETTER[b]]] = True


class Encoder:
    """The library's ids of texts. Pieces of texts go to the library once; what they gave is kept in a table by their hash.

    A piece is a run without ASCII white space together with one space before it, cut again
    where an ASCII letter is followed by an ASCII character that is none; or it is white space
    that no such run takes. The library cuts at all of these places too, so that pieces can be encoded apart.
    Texts with other white space, control characters taken for it, or added tokens go to the library whole.
    """

    SLOTS, PROBES = 1 << 21, 32

    def __init__(self, blob: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_buffer(blob)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = tuple(a.content.encode() for a in self.library.get_added_tokens_decoder().values())
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self._newline = self._ids(["\n"])[0]
        self.newline = self._newline[0]
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(self.SLOTS, np.uint64)
        self.bytes_of, self.begin, self.count = (np.zeros(self.SLOTS, np.int32) for _ in range(3))
        self.pool, self.used, self.held = np.zeros(1 << 20, np.uint32), 0, 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [done.ids for done in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece_ids(self, pieces: list[str]) -> list[list[int]]:
        """Each piece's ids. Those that aren't white space go as the lines of one text, which costs a call less for each."""
        line = [k for k, piece in enumerate(pieces) if not piece.isspace() and "\n" not in piece]
        joined = np.array(self._ids(["\n".join(pieces[k] for k in line)])[0], np.int64)
        cuts = np.flatnonzero(joined == self.newline)
        if len(self._newline) != 1 or len(cuts) != len(line) - 1:
            return self._ids(pieces)
        whole, out = joined.tolist(), dict(zip(line, zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), len(joined)])))
        rest = [k for k in range(len(pieces)) if k not in out]
        other = dict(zip(rest, self._ids([pieces[k] for k in rest])))
        return [other[k] if k in other else whole[out[k][0] : out[k][1]] for k in range(len(pieces))]

    def _find(self, hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The slot of each piece, -1 for those that the table does not hold."""
        at = (hashes >> np.uint64(43)).astype(np.int64)
        slot = np.full(len(hashes), -1)
        left = np.arange(len(hashes))
        for _ in range(self.PROBES):
            here = at[left]
            same = (self.keys[here] == hashes[left]) & (self.bytes_of[here] == size[left])
            slot[left[same]] = here[same]
            left = left[~same & (self.keys[here] != 0)]
            if not len(left):
                break
            at[left] = (at[left] + 1) & (self.SLOTS - 1)
        return slot

    def _keep(self, hashes: np.ndarray, size: np.ndarray, ids: list[list[int]]) -> None:
        """Put pieces in the table; those in a very full stretch stay out, and go to the library each time."""
        count = np.array([len(x) for x in ids])
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(count.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        begin = self.used + np.cumsum(count) - count
        self.used += len(flat)
        at, left = (hashes >> np.uint64(43)).astype(np.int64), np.arange(len(hashes))
        for _ in range(self.PROBES):
            _, one = np.unique(at[left], return_index=True)
            mine = left[one]
            mine = mine[self.keys[at[mine]] == 0]
            here = at[mine]
            self.keys[here], self.bytes_of[here], self.begin[here], self.count[here] = hashes[mine], size[mine], begin[mine], count[mine]
            self.held += len(mine)
            left = np.setdiff1d(left, mine, assume_unique=True)
            if not len(left):
                break
            at[left] = (at[left] + 1) & (self.SLOTS - 1)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, one text after the other, and how many each has."""
        data, edge = text_bytes(texts)
        odd = self._odd(data, edge)
        if odd.any():
            parts, counts, at = [], np.zeros(len(texts), np.int64), 0
            for k in np.flatnonzero(np.append(True, odd[1:] != odd[:-1])).tolist():
                end = k + 1
                while end < len(odd) and odd[end] == odd[k]:
                    end += 1
                own = texts.slice(k, end - k)
                if odd[k]:
                    ids = self._ids([t or "" for t in own.to_pylist()])
                    counts[k:end] = [len(x) for x in ids]
                    parts += [np.array(x, np.uint32) for x in ids]
                else:
                    ids, counts[k:end] = self._plain(*text_bytes(own))
                    parts.append(ids)
            return np.concatenate(parts), counts
        return self._plain(data, edge)

    def _odd(self, data: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Which texts the library takes whole."""
        hits = []
        maybe = np.flatnonzero(_FIRST[data])
        if len(maybe):
            pad = np.concatenate([data, np.zeros(2, np.uint8)])
            a, b, c = pad[maybe], pad[maybe + 1], pad[maybe + 2]
            bad = a < 0x20
            for (x, y), third in _GAPS.items():
                bad |= (a == x) & (b == y) & (True if third is None else np.isin(c, list(third)))
            hits.append(maybe[bad])
        blob = data.tobytes()
        for token in self.added:
            at = blob.find(token)
            while at >= 0:
                hits.append(np.array([at]))
                at = blob.find(token, at + 1)
        odd = np.zeros(len(edge) - 1, bool)
        if hits:
            odd[np.searchsorted(edge, np.concatenate(hits), "right") - 1] = True
        return odd

    def _plain(self, data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(edge) - 1, np.int64)
        gap = SPACE[data]
        first = np.zeros(n + 1, bool)
        first[edge] = True
        fresh = first[:n].copy()  # a text begins
        fresh[1:] |= gap[1:] != gap[:-1]  # white space begins or ends
        fresh[1:] |= _LETTER[data[:-1]] & _OTHER[data[1:]]
        word = np.flatnonzero(~gap[1:] & gap[:-1] & ~first[1:n]) + 1  # words behind white space of their text
        spaced = word[data[word - 1] == 0x20]
        fresh[spaced] = False  # the space before a word is the word's
        fresh[word - 1] = True  # other last white space stands alone
        start = np.flatnonzero(fresh)
        stop = np.append(start[1:], n)
        up, down = _byte_powers.get(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(EXACT[data] * up[:n], out=total[1:])
        hashes = mix((total[stop] - total[start]) * down[start])
        hashes[hashes == 0] = 1
        size = (stop - start).astype(np.int32)
        slot = self._find(hashes, size)
        lost = np.flatnonzero(slot < 0)
        extra: dict[int, list[int]] = {}
        if len(lost):
            _, one = np.unique(hashes[lost], return_index=True)
            new = lost[one]
            if self.held + len(new) > REMEMBERED or self.used > 1 << 24:
                self.forget()
                _, new = np.unique(hashes, return_index=True)
            blob = data.tobytes()
            ids = self._piece_ids([blob[a:b].decode() for a, b in zip(start[new].tolist(), stop[new].tolist())])
            self._keep(hashes[new], size[new], ids)
            slot = self._find(hashes, size)
            for k in np.flatnonzero(slot < 0).tolist():
                extra[k] = self._ids([blob[start[k] : stop[k]].decode()])[0]
        many = np.where(slot < 0, 0, self.count[slot]).astype(np.int64)
        for k, own in extra.items():
            many[k] = len(own)
        end = np.cumsum(many)
        from_ = np.where(slot < 0, 0, self.begin[slot]) - (end - many)
        ids = self.pool[np.minimum(np.repeat(from_, many) + np.arange(end[-1]), len(self.pool) - 1)]
        for k, own in extra.items():
            ids[end[k] - many[k] : end[k]] = own
        return ids, np.diff(np.append(0, end)[np.searchsorted(start, edge)])


@lru_cache(maxsize=1)
def _encoder(blob: bytes) -> Encoder:
    return Encoder(blob)


class FileWriter:
    """Writes one file; documents are added in order."""

    def __init__(self, out, vocabulary: int, end_id: int):
        self.out, self.vocabulary = out, vocabulary
        self.at = out.write(_HEAD.pack(MAGIC, vocabulary, end_id)) or _HEAD.size
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self.held: list[np.ndarray] = []
        self.waiting = 0

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray) -> None:
        """Documents with their token ids, one after the other."""
        self.ids += doc_ids
        self.counts += counts.tolist()
        self.held.append(ids.astype("<u4", copy=False))
        self.waiting += len(ids)
        if self.waiting >= rangecoder.BLOCK:
            self._flush(rangecoder.BLOCK)

    def _flush(self, least: int) -> None:
        """Write blocks while ``least`` ids wait."""
        ids = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        done = 0
        while self.waiting >= least and self.waiting:
            n = min(self.waiting, rangecoder.BLOCK)
            own = ids[done : done + n]
            coded = rangecoder.encode_block(own, self.vocabulary)
            self._put(_BLOCK.pack(n, len(coded), zlib.crc32(own.tobytes()), zlib.crc32(coded)) + coded)
            done += n
            self.waiting -= n
        self.held = [ids[done:]]

    def close(self) -> tuple[int, int, int]:
        """Write what waits, the index and the foot; gives documents, ids and bytes."""
        self._flush(1)
        place = self.at
        nulls = np.array([i is None for i in self.ids], np.uint8)
        index = np.array([i or 0 for i in self.ids], "<i8").tobytes() + nulls.tobytes() + np.array(self.counts, "<i8").tobytes()
        self._put(index)
        self._put(_FOOT.pack(place, len(self.ids), sum(self.counts), zlib.crc32(index), MAGIC))
        self.out.close()
        return len(self.ids), sum(self.counts), self.at


def read_file(source) -> Iterator[tuple[int | None, np.ndarray]]:
    """Each document's id and token ids, in the file's order. One block is held at a time."""
    source.seek(source.size() - _FOOT.size)
    place, n_docs, n_tokens, check, magic = _FOOT.unpack(source.read(_FOOT.size))
    source.seek(place)
    index = source.read(17 * n_docs)
    if magic != MAGIC or zlib.crc32(index) != check:
        raise ValueError("a token file's index is damaged")
    ids = np.frombuffer(index, "<i8", n_docs).tolist()
    nulls = np.frombuffer(index, np.uint8, n_docs, 8 * n_docs)
    counts = np.frombuffer(index, "<i8", n_docs, 9 * n_docs).tolist()
    source.seek(0)
    magic, vocabulary, _ = _HEAD.unpack(source.read(_HEAD.size))
    if magic != MAGIC or sum(counts) != n_tokens:
        raise ValueError("a token file's head is damaged")
    at, ready, begin = _HEAD.size, np.zeros(0, np.uint32), 0
    for doc_id, null, count in zip(ids, nulls, counts):
        parts = [ready[begin : begin + count]]
        have = len(parts[0])
        begin += have
        while have < count:
            if at >= place:
                raise ValueError("a token file ends early")
            n, size, of_ids, of_payload = _BLOCK.unpack(source.read(_BLOCK.size))
            coded = source.read(size)
            at += _BLOCK.size + size
            if zlib.crc32(coded) != of_payload:
                raise ValueError("a token block's payload is damaged")
            ready = rangecoder.decode_block(coded, n, vocabulary).astype("<u4", copy=False)
            if zlib.crc32(ready.tobytes()) != of_ids:
                raise ValueError("a token block's ids differ from those written")
            begin = min(count - have, n)
            parts.append(ready[:begin])
            have += begin
        yield (None if null else doc_id), parts[0] if len(parts) == 1 else np.concatenate(parts)


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text", folder: str | None = None) -> DataFrame:
    """Write all documents' ids as files below ``folder`` (default: in the shared folder); gives the manifest."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_path(spark, vocabulary))
    folder = folder or scratch(spark, "tokens")

    def run(batches):
        encode, writer = _encoder(shared.value), None
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tok"
        for batch in batches:
            for part in chunks(batch):
                if writer is None:
                    files, path = _open(name)
                    files.create_dir(os.path.dirname(path), recursive=True)
                    writer = FileWriter(files.open_output_stream(path), encode.size, end_id)
                ids, counts = encode(part["text"])
                writer.add(part["doc_id"].to_pylist(), np.insert(ids, np.cumsum(counts), end_id), counts + 1)
        if writer is not None:
            row = TaskContext.get().partitionId(), name, *writer.close()
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "path", "n_docs", "n_tokens", "n_bytes"), row))], pa.schema([("part", pa.int32()), ("path", pa.string()), *((c, pa.int64()) for c in ("n_docs", "n_tokens", "n_bytes"))]))

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return stage(rows.repartitionByRange(wide(spark), "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, MANIFEST), "manifest")


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """A row for each document: doc_id, start, n_tokens, and its ids as little-endian unsigned 32-bit integers.

    The manifest's rows, one a file, pass through the driver, which adds up where each file starts.
    """
    files, start = [], 0
    for row in manifest.select("part", "path", "n_tokens").orderBy("part").collect():
        files.append((len(files), row.path, start))
        start += row.n_tokens
    if not files:
        return spark.createDataFrame([], DOCUMENTS)

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for path, first in zip(batch["path"].to_pylist(), batch["start"].to_pylist()):
                files, name = _open(path)
                held, size = [], 0
                with files.open_input_file(name) as source:
                    for doc_id, ids in read_file(source):
                        held.append((doc_id, first, len(ids), ids.tobytes()))
                        first += len(ids)
                        size += len(ids)
                        if size >= rangecoder.BLOCK:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    rows = spark.createDataFrame(files, "file int, path string, start long")
    return rows.repartitionById(len(files), F.col("file")).mapInArrow(run, DOCUMENTS)
