"""A range coder for token ids, driven by mixed predictions of order 0, 1 and 2.

A block of ids is cut into *lanes* of consecutive ids. All lanes step forward together,
each with a range coder of its own, and share one model that learns from every lane's
id of a step before the next one. So a step is a few numpy operations on all lanes,
and encoder and decoder walk through the same states.

The model holds, for the last id (order 1) and a hash of the last two (order 2), the
id that followed and a confidence of 0 to 3, and for order 0 the counts of all ids that
neither foretold. The confidences and whether both foretell the same select a mixing
context, whose adaptive counts give the probabilities of "order 2 is right", "order 1
is right" and "neither"; the last share is dealt out among ids by the order-0 counts.
Ids that the block has not counted yet follow by their plain number behind an escape.

A lane's low end and range are integers below 2**49, held exactly in float64, so that
all of the coder's products and quotients are single vector operations. Words of 16
bits go out; a carry is added to the lane's last word and settled when the block ends.
A block starts from an empty model, so each can be decoded by itself.
"""

from __future__ import annotations

import numpy as np

#: Ids of a block, and of a lane.
BLOCK, LANE = 1 << 21, 256
#: Bits of the order-2 table; ids that order 0 counts, at most (others stay behind the escape).
_SLOTS, _COUNTED = 16, 1 << 15
#: Places of order 0, mixing shares, both together; a word; the least and the whole range of a lane.
_PLACES, _SHARES, _BOTH, _WORD, _LEAST, _FULL = (float(1 << k) for k in (16, 12, 28, 16, 32, 48))
#: Order-0 counts are refreshed after these steps and every 16th, mixing shares every 4th.
_EARLY = frozenset((1, 2, 3, 4, 6, 8, 12))


class _Model:
    """What both sides know of a block after each step."""

    def __init__(self, vocabulary: int, lanes: int):
        self.vocabulary = vocabulary
        self.one = np.full(vocabulary, -4, np.int32)
        self.two = np.full(1 << _SLOTS, -4, np.int32)
        self.last = np.zeros(lanes, np.int64)
        self.before = np.zeros(lanes, np.int64)
        self.mixed = np.full((32, 3), (40.0, 4.0, 20.0))
        self.counts = np.zeros(vocabulary, np.int64)
        self.known = np.zeros(0, np.int64)
        self.begin, self.width = np.zeros(vocabulary, np.uint16), np.zeros(vocabulary, np.uint16)
        self.place = np.zeros(int(_PLACES), np.uint16 if vocabulary < 1 << 16 else np.int64)
        self.pending: list[np.ndarray] = []
        self.cells: list[np.ndarray] = []
        self.steps = 0
        self._settle()
        self._share()

    def _settle(self) -> None:
        """Order-0 places: at least one for each counted id; the escape has the first ones."""
        if self.pending:
            self.counts += np.bincount(np.concatenate(self.pending), minlength=self.vocabulary)
            self.pending = []
            if len(self.known) < _COUNTED:
                new = self.counts > 0
                new[self.known] = False
                self.known = np.concatenate([self.known, new.nonzero()[0]])[:_COUNTED]
        count = self.counts[self.known]
        total, n = int(count.sum()), len(count)
        left = int(_PLACES) - n - 1
        escape = 1 + left * (n + 1) // (total + n + 1)
        size = 1 + (left - escape + 1) * count // max(total, 1)
        escape = int(_PLACES) - int(size.sum())
        self.begin[self.known], self.width[self.known] = escape + np.cumsum(size) - size, size
        self.escape = float(escape)
        self.place[escape:] = np.repeat(self.known, size)

    def _share(self) -> None:
        """Each mixing context's three shares, none of them empty."""
        if self.cells:
            self.mixed += np.bincount(np.concatenate(self.cells), minlength=96).reshape(32, 3)
            self.cells = []
            large = self.mixed.sum(axis=1) > 60_000
            self.mixed[large] = self.mixed[large] / 2 + 0.5
        share = np.floor(self.mixed[:, :2] * (_SHARES / self.mixed.sum(axis=1, keepdims=True)))
        first = np.clip(share[:, 0], 1, _SHARES - 2)
        both = np.clip(first + share[:, 1], first + 1, _SHARES - 1)
        self.first, self.both = first * _PLACES, both * _PLACES
        self.start = np.stack([np.zeros(32), self.first, self.both], 1).ravel()
        self.size = np.stack([first, both - first, _SHARES - both], 1).ravel()

    def foretell(self, n: int) -> None:
        last = self.last[:n]
        mixed = last.astype(np.uint32) * np.uint32(0x9E3779B1) ^ self.before[:n].astype(np.uint32) * np.uint32(0x85EBCA6B)
        self.slot = (mixed * np.uint32(0xC2B2AE35) >> np.uint32(32 - _SLOTS)).astype(np.int64)
        self.held1, self.held2 = self.one[last], self.two[self.slot]
        self.id1, self.id2 = self.held1 >> 2, self.held2 >> 2
        self.sure1, self.sure2 = self.held1 & 3, self.held2 & 3
        self.context = ((self.sure2 << 3) + (self.sure1 << 1) + (self.id1 == self.id2)).astype(np.int64)

    def learn(self, ids: np.ndarray, cell: np.ndarray, free: np.ndarray) -> None:
        """Take in a step's ids, the mixing cells that came true, and the ids that none foretold."""
        n = len(ids)
        narrow = ids.astype(np.int32)
        fresh = (narrow << 2) + 1
        for table, at, held, known, sure in ((self.one, self.last[:n], self.held1, self.id1, self.sure1), (self.two, self.slot, self.held2, self.id2, self.sure2)):
            right = known == narrow
            # right: more confident, up to 3; wrong: less; wrong without confidence: this id instead
            held += (right.view(np.int8) << 1) - 1
            held -= right & (sure == 3)
            np.copyto(held, fresh, where=(sure == 0) > right)
            table[at] = held
        self.before[:n] = self.last[:n]
        self.last[:n] = ids
        self.pending.append(free)
        self.cells.append(cell)
        self.steps += 1
        if self.steps in _EARLY or self.steps % 16 == 0:
            self._settle()
        if self.steps < 8 or self.steps % 4 == 0:
            self._share()


def _shape(n: int) -> tuple[int, int, int]:
    """Lanes, steps, and how many lanes (the first ones) take part in the last step."""
    lanes = -(-n // LANE)
    steps = -(-n // lanes) if n else 0
    return lanes, steps, n - (steps - 1) * lanes if n else 0


def _rows(ids: np.ndarray) -> np.ndarray:
    """A row for each step with every lane's id; lanes without a last id have 0 there."""
    lanes, steps, full = _shape(len(ids))
    out = np.zeros((lanes, steps), np.int64)
    out[:full] = ids[: full * steps].reshape(full, steps)
    out[full:, : steps - 1] = ids[full * steps :].reshape(lanes - full, steps - 1)
    return np.ascontiguousarray(out.T)


def _digits(vocabulary: int) -> list[tuple[int, int]]:
    """How an id behind an escape is cut: (divisor, number of values) of each part, high parts first."""
    parts, divisor = [], 1
    while divisor < vocabulary:
        parts.append((divisor, min(1 << 16, -(-vocabulary // divisor))))
        divisor <<= 16
    return parts[::-1]


class _Writer:
    """The lanes' low ends, ranges and words."""

    def __init__(self, lanes: int, ids: int):
        self.low, self.span, self.latest = np.zeros(lanes), np.full(lanes, _FULL), np.zeros(lanes, np.int64)
        self.words, self.owner, self.used = np.zeros(ids + 4 * lanes, np.int32), np.zeros(ids + 4 * lanes, np.uint16), 0

    def _emit(self, top: np.ndarray, lane: np.ndarray) -> None:
        end = self.used + len(lane)
        if end > len(self.words):
            self.words, self.owner = np.concatenate([self.words, np.zeros_like(self.words)]), np.concatenate([self.owner, np.zeros_like(self.owner)])
        self.words[self.used : end], self.owner[self.used : end] = top, lane
        self.latest[lane] = np.arange(self.used, end)
        self.used = end

    def narrow(self, at: np.ndarray, start, size, unit: np.ndarray) -> None:
        """Lanes ``at`` keep ``size`` from ``start`` on, in units of their range."""
        new, wide = self.low[at], unit * size
        new += unit * start
        over = (new >= _FULL).nonzero()[0]
        if len(over):
            new[over] -= _FULL
            self.words[self.latest[at[over]]] += 1
        out = (wide < _LEAST).nonzero()[0]
        while len(out):
            value = new[out]
            top = np.floor(value * (1 / _LEAST))
            self._emit(top, at[out])
            new[out] = (value - top * _LEAST) * _WORD
            left = wide[out] * _WORD
            wide[out] = left
            out = out[left < _LEAST]
        self.low[at], self.span[at] = new, wide

    def finish(self) -> bytes:
        """One more word for each lane, the first multiple of 2**32 in what is left; then all words by lane."""
        lanes = len(self.low)
        last = np.ceil(self.low * (1 / _LEAST))
        over = (last >= _WORD).nonzero()[0]
        last[over] -= _WORD
        self.words[self.latest[over]] += 1
        self._emit(last, np.arange(lanes))
        owner = self.owner[: self.used]
        words = self.words[: self.used][np.argsort(owner, kind="stable")]
        while len(over := (words > 0xFFFF).nonzero()[0]):
            words[over] -= 1 << 16
            words[over - 1] += 1
        return np.bincount(owner, minlength=lanes).astype("<u2").tobytes() + words.astype("<u2").tobytes()


class _Reader:
    """The lanes' ranges and what of their words lies above the low end."""

    def __init__(self, blob: bytes, lanes: int):
        count = np.frombuffer(blob, "<u2", lanes).astype(np.int64)
        self.words = np.zeros(int(count.sum()) + 1)
        self.words[:-1] = np.frombuffer(blob, "<u2", offset=2 * lanes)
        self.end = np.cumsum(count)
        self.at = self.end - count
        self.code, self.span = np.zeros(lanes), np.full(lanes, _FULL)
        for _ in range(3):
            self.code = self.code * _WORD + self._take(np.arange(lanes))

    def _take(self, lane: np.ndarray) -> np.ndarray:
        """The next word of these lanes; 0 behind a lane's end."""
        place = self.at[lane]
        self.at[lane] = place + 1
        return self.words[np.where(place < self.end[lane], place, len(self.words) - 1)]

    def narrow(self, at: np.ndarray, start, size, unit: np.ndarray) -> None:
        value, wide = self.code[at], unit * size
        value -= unit * start
        out = (wide < _LEAST).nonzero()[0]
        while len(out):
            value[out] = value[out] * _WORD + self._take(at[out])
            left = wide[out] * _WORD
            wide[out] = left
            out = out[left < _LEAST]
        self.code[at], self.span[at] = value, wide


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    """A block's words: how many each lane has (unsigned 16 bits), then the lanes' words one after the other."""
    if not len(ids):
        return b""
    lanes, steps, full = _shape(len(ids))
    rows, model, digits = _rows(ids), _Model(vocabulary, lanes), _digits(vocabulary)
    writer, everyone = _Writer(lanes, len(ids)), np.arange(lanes)
    for step in range(steps):
        n = lanes if step < steps - 1 else full
        now = rows[step, :n]
        model.foretell(n)
        two, one = model.id2 == now, model.id1 == now
        none = ~(two | one)
        cell = model.context * 3
        cell += none
        cell += ~two
        free = none.nonzero()[0]
        own = now[free]
        start, share = model.start[cell], model.size[cell]
        size = share * _PLACES
        width, part = model.width[own], share[free]
        new = width == 0
        start[free] += part * np.where(new, 0, model.begin[own])
        size[free] = part * np.where(new, model.escape, width)
        writer.narrow(everyone[:n], start, size, np.floor(writer.span[:n] * (1 / _BOTH)))
        lost = free[new]
        for divisor, base in digits if len(lost) else ():
            writer.narrow(lost, (now[lost] // divisor % base).astype(float), 1.0, np.floor(writer.span[lost] / base))
        model.learn(now, cell, own)
    return writer.finish()


def decode_block(blob: bytes, n_ids: int, vocabulary: int) -> np.ndarray:
    """The ids of a block as unsigned 32-bit integers."""
    if not n_ids:
        return np.zeros(0, np.uint32)
    lanes, steps, full = _shape(n_ids)
    model, digits = _Model(vocabulary, lanes), _digits(vocabulary)
    reader, everyone = _Reader(blob, lanes), np.arange(lanes)
    rows = np.zeros((steps, lanes), np.uint32)
    for step in range(steps):
        n = lanes if step < steps - 1 else full
        model.foretell(n)
        unit = np.floor(reader.span[:n] * (1 / _BOTH))
        spot = np.minimum(np.floor(reader.code[:n] / unit), _BOTH - 1)
        beyond, none = spot >= model.first[model.context], spot >= model.both[model.context]
        cell = model.context * 3
        cell += beyond
        cell += none
        now = np.where(beyond, model.id1, model.id2).astype(np.int64)
        start, share = model.start[cell], model.size[cell]
        size = share * _PLACES
        free = none.nonzero()[0]
        part = share[free]
        place = np.floor((spot[free] - start[free]) / part)
        own = model.place[place.astype(np.int64)].astype(np.int64)
        new = place < model.escape
        start[free] += part * np.where(new, 0, model.begin[own])
        size[free] = part * np.where(new, model.escape, model.width[own])
        reader.narrow(everyone[:n], start, size, unit)
        lost = free[new]
        if len(lost):
            whole = np.zeros(len(lost), np.int64)
            for divisor, base in digits:
                unit = np.floor(reader.span[lost] / base)
                digit = np.minimum(np.floor(reader.code[lost] / unit), base - 1)
                reader.narrow(lost, digit, 1.0, unit)
                whole += digit.astype(np.int64) * divisor
            own[new] = whole
        now[free] = own
        rows[step, :n] = now
        model.learn(now, cell, own)
    flat = rows.T
    return np.concatenate([flat[:full].ravel(), flat[full:, : steps - 1].ravel()])
