"""Media columns: byte payloads as baseline JPEGs, read back from their DC coefficients.

Writing: every payload byte is the grey level of one flat 8x8 block. With a DC
quantiser of 8 such a block is exact, so the file holds the payload losslessly as
8-bit samples. A row of blocks is ``ROW`` bytes, and a restart marker ends each row.

Reading: the markers are parsed, the scan's restart intervals are cut apart and their
Huffman codes decoded, and the DC coefficients give a luminance thumbnail with one
sample a block. The intervals of all images of a chunk are decoded side by side in
numpy, a symbol of each at a time. Any baseline grey JPEG can be read; AC codes are
decoded and skipped. Payloads of more than one frame's rows are stored as several
frames, one after another.

Defined results: null text counts as empty; the payload is padded with spaces to a
positive multiple of 192; equal texts give equal values; an empty table gives an empty
result; only the id and text columns are read.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.textscan import chunks, text_bytes

#: Blocks in a row, and rows in a frame (a side has less than 65536 samples).
ROW, MOST_ROWS = 192, 8191
#: The luminance DC code of the JPEG standard, annex K (fixed values): codes of each length, then their symbols.
DC_LENGTHS, DC_SYMBOLS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], [*range(12)]
#: The only AC symbol that flat blocks need: end of block.
AC_LENGTHS, AC_SYMBOLS = [1, *[0] * 15], [0]
SCHEMA = "doc_id long, n_bytes long, payload binary, media binary, width int, height int, feature string"


def code_table(lengths: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol's code and length, in the order of ``symbols``."""
    codes, sizes, code = [], [], 0
    for size, count in enumerate(lengths, 1):
        for _ in range(count):
            codes.append(code)
            sizes.append(size)
            code += 1
        code <<= 1
    return np.array(codes, np.int64), np.array(sizes, np.int64)


def lookup_table(lengths: list[int], symbols: list[int]) -> np.ndarray:
    """For the next 16 bits: 32 x the symbol, plus its code's length; 0 where no code fits."""
    table = np.zeros(1 << 16, np.int32)
    for symbol, code, size in zip(symbols, *code_table(lengths, symbols)):
        table[code << (16 - size) : (code + 1) << (16 - size)] = 32 * symbol + size
    return table


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def header(rows: int) -> bytes:
    """All of a frame before its scan's data."""
    return b"".join([
        b"\xff\xd8", _segment(0xE0, b"JFIF\0" + bytes([1, 1, 0, 0, 1, 0, 1, 0, 0])), _segment(0xDB, bytes([0, *[8] * 64])),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * rows, 8 * ROW, 1, 1, 0x11, 0)),
        _segment(0xC4, bytes([0x00, *DC_LENGTHS, *DC_SYMBOLS])), _segment(0xC4, bytes([0x10, *AC_LENGTHS, *AC_SYMBOLS])),
        _segment(0xDD, struct.pack(">H", ROW)), _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))])


def encode_rows(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of grey levels as stuffed scan data: all bytes, and the number of each row's."""
    level = samples.astype(np.int64) - 128
    diff = np.diff(level, axis=1, prepend=0)
    size = np.zeros(1024, np.int64)
    for k in range(1, 10):
        size[1 << (k - 1) : 1 << k] = k
    size = size[np.abs(diff)]
    codes, widths = code_table(DC_LENGTHS, DC_SYMBOLS)
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    # the code, the difference's bits, and the end of block's single 0 bit
    value = ((codes[size] << size) | extra) << 1
    width = widths[size] + size + 1
    end = np.cumsum(width, axis=1)
    total = (end[:, -1] + 7) // 8
    first = np.cumsum(total) - total
    bit = first[:, None] * 8 + end - width
    value = (value << (24 - width - (bit & 7))).ravel()
    at, n = (bit >> 3).ravel(), int(total.sum()) + 3
    data = sum(np.bincount(at + k, (value >> (16 - 8 * k)) & 255, n) for k in range(3)).astype(np.uint8)[:-3]
    spare = total * 8 - end[:, -1]
    data[first + total - 1] |= ((1 << spare) - 1).astype(np.uint8)
    full = data == 255
    count = total + np.add.reduceat(full.astype(np.int64), first)
    out = np.zeros(len(data) + int(full.sum()), np.uint8)
    out[np.arange(len(data)) + np.cumsum(full) - full] = data
    return out, count


def write_media(payloads: np.ndarray, rows: list[int]) -> list[bytes]:
    """The files of payloads that lie one after another, ``rows`` of ``ROW`` bytes each."""
    data, count = encode_rows(payloads.reshape(-1, ROW))
    blob, cut = data.tobytes(), np.concatenate([[0], np.cumsum(count)]).tolist()
    files, k = [], 0
    for n in rows:
        parts = []
        for f in range(0, n, MOST_ROWS):
            m = min(MOST_ROWS, n - f)
            parts.append(header(m))
            for r in range(m):
                if r:
                    parts.append(bytes([0xFF, 0xD0 + (r - 1) % 8]))
                parts.append(blob[cut[k] : cut[k + 1]])
                k += 1
            parts.append(b"\xff\xd9")
        files.append(b"".join(parts))
    return files


@dataclass
class Frame:
    """A parsed frame: its size in samples and blocks, its tables, and its scan's bytes."""

    width: int
    height: int
    dc_quantiser: int
    dc: bytes
    ac: bytes
    interval: int
    scan: tuple[int, int]

    @property
    def blocks(self) -> tuple[int, int]:
        return (self.height + 7) // 8, (self.width + 7) // 8


def parse(media: bytes) -> list[Frame]:
    """The frames of a file, from their markers."""
    frames, at = [], 0
    while at < len(media):
        if media[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        quantisers, tables, interval, size = {}, {}, 0, None
        while True:
            if media[at] != 0xFF:
                raise ValueError("no marker")
            marker, at = media[at + 1], at + 2
            if marker == 0xD9:
                break
            length = int.from_bytes(media[at : at + 2], "big")
            body = media[at + 2 : at + length]
            at += length
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quantisers[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    tables[body[0]] = body[1:n]
                    body = body[n:]
            elif marker == 0xDD:
                interval = int.from_bytes(body, "big")
            elif marker == 0xC0:
                if body[0] != 8 or body[5] != 1:
                    raise ValueError("only 8-bit grey frames are read")
                size = (*struct.unpack(">HH", body[1:5]), body[8])
            elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                raise ValueError("only baseline frames are read")
            elif marker == 0xDA:
                end = at
                while True:
                    end = media.find(b"\xff", end)
                    if end < 0:
                        raise ValueError("the scan has no end")
                    if media[end + 1] == 0 or 0xD0 <= media[end + 1] <= 0xD7:
                        end += 2
                        continue
                    break
                frames.append(Frame(size[1], size[0], quantisers[size[2]], tables[body[2] >> 4], tables[0x10 | body[2] & 15], interval, (at, end)))
                at = end
    return frames


def _intervals(scan: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A scan's bytes without stuffing and markers, and where each restart interval begins."""
    mark = np.flatnonzero((scan[:-1] == 255) & (scan[1:] >= 0xD0) & (scan[1:] <= 0xD7)) if len(scan) else np.zeros(0, int)
    keep = np.ones(len(scan), bool)
    keep[1:][(scan[:-1] == 255) & (scan[1:] == 0)] = False
    keep[mark] = keep[mark + 1] = False
    place = np.cumsum(keep)
    return scan[keep], np.concatenate([[0], place[mark]])


def decode_dc(media: list[bytes]) -> list[tuple[list[Frame], np.ndarray]]:
    """Each file's frames, and the thumbnails' grey levels in raster order.

    Frames with the same tables are decoded together.
    """
    parsed = [parse(m) for m in media]
    groups: dict[tuple, list] = {}
    for k, frames in enumerate(parsed):
        for j, f in enumerate(frames):
            groups.setdefault((f.dc, f.ac, f.dc_quantiser), []).append((k, j))
    levels: dict[tuple, np.ndarray] = {}
    for (dc, ac, quantiser), members in groups.items():
        data, begin, want, base = [], [], [], 0
        for k, j in members:
            f = parsed[k][j]
            scan, starts = _intervals(np.frombuffer(media[k], np.uint8, f.scan[1] - f.scan[0], f.scan[0]))
            blocks = f.blocks[0] * f.blocks[1]
            step = f.interval or blocks
            want.append(np.minimum(step, blocks - step * np.arange(len(starts))))
            begin.append(base + starts)
            data.append(scan)
            base += len(scan)
        found = _decode_intervals(np.concatenate(data), np.concatenate(begin), np.concatenate(want), lookup_table([*dc[:16]], [*dc[16:]]), lookup_table([*ac[:16]], [*ac[16:]]))
        value = np.clip((found * quantiser + 4) // 8 + 128, 0, 255).astype(np.uint8)
        at = 0
        for k, j in members:
            n = parsed[k][j].blocks[0] * parsed[k][j].blocks[1]
            levels[k, j] = value[at : at + n]
            at += n
    return [(frames, np.concatenate([levels[k, j] for j in range(len(frames))])) for k, frames in enumerate(parsed)]


def _decode_intervals(data: np.ndarray, begin: np.ndarray, want: np.ndarray, dc: np.ndarray, ac: np.ndarray) -> np.ndarray:
    """The DC levels of all intervals, decoded side by side: block b of each at a time."""
    padded = np.concatenate([data, np.full(8, 255, np.uint8)]).astype(np.uint32)
    # four bytes from each place, so that any 16 bits and 9 more are one shift away
    word = (padded[:-3] << np.uint32(24)) | (padded[1:-2] << np.uint32(16)) | (padded[2:-1] << np.uint32(8)) | padded[3:]
    last = len(word) - 1
    order = np.argsort(-want, kind="stable")
    bit, total = begin[order] * 8, np.zeros(len(begin), np.int64)
    first = (np.cumsum(want) - want)[order]
    out, steps = np.zeros(int(want.sum()), np.int64), np.sort(want)
    one_end = ac[0] & 31 if ac[0] >> 5 == 0 and (ac[ac > 0] == ac[0]).all() else 0
    for b in range(int(want.max(initial=0))):
        live = len(want) - np.searchsorted(steps, b, "right")
        at = bit[:live]
        have = word[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)
        code = dc[have >> np.uint32(16)]
        if not code.all():
            raise ValueError("a DC code is damaged")
        size, at = code >> 5, at + (code & 31)
        have = word[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)
        extra = (have >> np.uint32(16)).astype(np.int64) >> (16 - size)
        total[:live] += np.where((extra >> np.maximum(size - 1, 0) == 0) & (size > 0), extra - (1 << size) + 1, extra)
        out[first[:live] + b] = total[:live]
        at = at + size
        bit[:live] = at + one_end if one_end else _skip_ac(word, at, ac, last)
    return out


def _skip_ac(word: np.ndarray, bit: np.ndarray, ac: np.ndarray, last: int) -> np.ndarray:
    """Where each block ends, after its AC codes."""
    bit, k, open_ = bit.copy(), np.ones(len(bit), np.int64), np.arange(len(bit))
    while len(open_):
        at = bit[open_]
        code = ac[(word[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> np.uint32(16)]
        if not code.all():
            raise ValueError("an AC code is damaged")
        symbol = code >> 5
        bit[open_] = at + (code & 31) + (symbol & 15)
        k[open_] = np.where(symbol == 0, 64, k[open_] + (symbol >> 4) + 1)
        open_ = open_[k[open_] < 64]
    return bit


def thumbnail_hash(samples: np.ndarray) -> str:
    """64 bits: which of 65 runs of the thumbnail's samples, in reading order, is brighter on average than the next."""
    cut = np.arange(66) * len(samples) // 65
    mean = np.add.reduceat(samples.astype(np.int64), cut[:-1]) / np.diff(cut)
    return np.packbits(mean[:-1] > mean[1:]).tobytes().hex()


def media_columns(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, the payload as read back from the stored file, the file, its size in samples, its feature."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, most=1 << 21):
                data, at = text_bytes(part["text"])
                size = np.diff(at)
                rows = np.maximum(-(-size // ROW), 1)
                begin = np.cumsum(rows * ROW) - rows * ROW
                payload = np.full(int(rows.sum()) * ROW, 32, np.uint8)
                payload[np.arange(len(data)) + np.repeat(begin - at[:-1], size)] = data
                media = write_media(payload, rows.tolist())
                back = decode_dc(media)
                frames = [f[0] for f, _ in back]
                high = [sum(x.height for x in f) for f, _ in back]
                feature = [f"{f.width}x{h}:{thumbnail_hash(s)}" for f, h, (_, s) in zip(frames, high, back)]
                yield pa.RecordBatch.from_arrays([
                    part["doc_id"], pa.array(size, pa.int64()), pa.array([s.tobytes() for _, s in back], pa.binary()), pa.array(media, pa.binary()),
                    pa.array([f.width for f in frames], pa.int32()), pa.array(high, pa.int32()), pa.array(feature)], ["doc_id", "n_bytes", "payload", "media", "width", "height", "feature"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, SCHEMA)
