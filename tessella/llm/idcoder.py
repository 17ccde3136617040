"""Adaptive context-mixing range coder for token ids.

A block of ids is dealt to lanes, contiguous runs that are coded in step, so
that every operation is one numpy call over all lanes. The lanes share a model
that starts empty in every block and learns row by row:

* order 2 and order 1: the id that last followed the two ids, or the one id,
  before, with a confidence that grows while it is right;
* order 0: frequencies of all ids seen so far in the block.

The confidences, whether the two guesses agree, and how frequent each guess is
make up one of a fixed number of situations. For each of them, logistic
mixtures of what all three orders say, with weights that learn, give the
probabilities that the order-2 guess, the order-1 guess, or neither is right:
the mixing is done for all situations at once, in the first rows of a block and
then every few, and lanes look theirs up. Ids that neither predicts are coded
with the order-0 frequencies. Both decisions drive an asymmetric numeral system
(rANS) with a 64-bit state per lane and one stream of 32-bit words for all
lanes: the model runs forward, its choices are then coded from the last to the
first, and decoding meets them in order. Totals are powers of two. The
arithmetic is integral, so any machine decodes what another wrote.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

_U = np.uint64
MAGIC = b"TIDR"
#: Ids of a block, lanes at most, and ids of a lane at least.
BLOCK_IDS, MAX_LANES, LANE_IDS = 1 << 21, 16384, 128
_HEAD = struct.Struct("<4sIIIII")  # magic, ids, vocabulary, lanes, crc32 of the ids, bytes of payload
#: Rows that are each followed by mixing; later, every so many are.
_EAGER_ROWS, _MIX_ROWS = 16, 4
_ORDER0_BITS, _PROB_BITS = 22, 12
_CONTEXTS = 1 << 18
_PROB = 1 << _PROB_BITS
#: States lie from _LEAST on, below 2**64, between steps.
_LEAST, _WORD = _U(1 << 32), _U(32)
#: Order-0 values at which decoding knows the id.
_SPACE_BITS = 8
_SPACED = np.arange(0, (1 << _ORDER0_BITS) + (1 << _SPACE_BITS), 1 << _SPACE_BITS)
#: Logit in 1/256 of each probability in 1/4096, and back (index: logit + 2047).
STRETCH = np.array([max(-2047, min(2047, round(256 * math.log((p + 0.5) / (_PROB - p - 0.5))))) for p in range(_PROB)], dtype=np.int64)
SQUASH = np.array([max(1, min(_PROB - 1, int(_PROB / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)], dtype=np.int64)
#: How frequent a guess is: classes by order-0 probability, their bounds in 1/2**22, and a typical probability in 1/4096.
_CLASS_BOUNDS, _CLASS_LOGIT = np.array([1 << 8, 1 << 11, 1 << 14]), STRETCH[[0, 1, 6, 64]]
#: Situations: confidence of order 2 and 1 (8 each), whether they agree (2), class of either guess (4 each).
_N = 8 * 8 * 2 * 4 * 4
_AT = np.arange(_N)
_SURE2, _SURE1, _SAME, _CLASS2, _CLASS1 = _AT & 7, _AT >> 3 & 7, _AT >> 6 & 1, _AT >> 7 & 3, _AT >> 9 & 3
_SEL2, _SEL1 = _SURE2 + 8 * _SAME, _SURE1 + 8 * (_SURE2 > 0)
_APPLIES2, _APPLIES1 = _SURE2 > 0, (_SURE1 > 0) & (_SAME == 0)


class _Model:
    def __init__(self, vocabulary: int):
        self.v = vocabulary
        # By context, the guess (-1: none) times 8, and its confidence.
        self.next1 = np.full(vocabulary + 1, -8, dtype=np.int64)
        self.next2 = np.full(_CONTEXTS, -8, dtype=np.int64)
        self.counts = np.zeros(vocabulary, dtype=np.int64)
        self.recent: list[np.ndarray] = []
        self.rows = 0
        self.right = [np.full(16, _PROB // 2, dtype=np.int64), np.full(16, _PROB // 2, dtype=np.int64)]
        self.weights = [np.full((16, 3), 1 << 14, dtype=np.int64), np.full((16, 3), 1 << 14, dtype=np.int64)]
        self.met: list[np.ndarray] = []
        self._rebuild()

    def _rebuild(self) -> None:
        total = max(1, int(self.counts.sum()))
        f = 1 + self.counts * ((1 << _ORDER0_BITS) - self.v) // total
        f[int(np.argmax(self.counts))] += (1 << _ORDER0_BITS) - int(f.sum())
        self.cum = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(f)))
        self.start, self.size = self.cum[:-1].astype(np.uint32), f.astype(np.uint32)
        self.coarse = None
        classes = np.searchsorted(_CLASS_BOUNDS, f, side="right")
        self.classes2, self.classes1 = classes << 7, classes << 9

    def find(self, value: np.ndarray) -> np.ndarray:
        """The id in whose order-0 range each value lies: by a table of evenly spaced values, and by search where several ids lie between two of them."""
        if self.coarse is None:
            self.coarse = np.searchsorted(self.cum, _SPACED, side="right") - 1
        slot = value >> _SPACE_BITS
        found = self.coarse.take(slot)
        several = np.flatnonzero(found < self.coarse.take(slot + 1))
        found[several] = np.searchsorted(self.cum, value[several], side="right") - 1
        return found

    def look(self, p2: np.ndarray, p1: np.ndarray) -> None:
        """Guesses and situations of a row of lanes with the ids before."""
        if self.rows < _EAGER_ROWS or self.rows % _MIX_ROWS == 0:
            self.learn()
            self.mix()
        self.c2 = (p2 * 0x9E3779B1 + p1 * 0x85EBCA6B >> 7) & (_CONTEXTS - 1)
        self.c1 = p1
        self.e2, self.e1 = self.next2.take(self.c2), self.next1.take(p1)
        self.s2, self.s1 = self.e2 & 7, self.e1 & 7
        self.g2, self.g1 = self.e2 >> 3, self.e1 >> 3
        # Where there is no guess its class is that of the last id, in coding and decoding alike.
        at = self.s1 << 3
        at |= self.s2
        at |= (self.g1 == self.g2).astype(np.int64) << 6
        at |= self.classes2.take(self.g2)
        at |= self.classes1.take(self.g1)
        self.at = at

    def mix(self) -> None:
        """The bounds of each outcome in every situation."""
        other = [np.where(_SAME == 1, STRETCH[self.right[1][_SURE1]], 0), np.where(_SURE2 > 0, STRETCH[self.right[0][_SURE2]], 0)]
        self.inputs, chances = [], []
        for k, (sel, applies, logit) in enumerate(((_SEL2, _APPLIES2, _CLASS_LOGIT[_CLASS2]), (_SEL1, _APPLIES1, _CLASS_LOGIT[_CLASS1]))):
            x = (STRETCH[self.right[k][sel]], other[k], logit)
            w = self.weights[k][sel]
            dot = (w[:, 0] * x[0] + w[:, 1] * x[1] + w[:, 2] * x[2]) >> 15
            self.inputs.append(x)
            chances.append(np.where(applies, np.minimum(SQUASH[np.clip(dot, -2047, 2047) + 2047], _PROB - 3), 0))
        self.p = chances
        two = chances[0]
        one = np.where(_APPLIES1, np.maximum(1, np.minimum((_PROB - two) * chances[1] >> _PROB_BITS, _PROB - two - 1)), 0)
        # At four times the situation plus the outcome, where the outcome begins and how wide it is.
        self.begins = np.stack([np.zeros(_N, dtype=np.int64), two, two + one, np.full(_N, _PROB)], axis=1).astype(np.uint16).reshape(-1)
        self.widths = np.stack([two, one, _PROB - two - one, np.zeros(_N, dtype=np.int64)], axis=1).astype(np.uint16).reshape(-1)

    def learn(self) -> None:
        """From four times the situation of every lane plus its outcome, of the rows since mixing: 0, the order-2 guess is right; 1, the order-1 guess is; 2, neither."""
        if not self.met:
            return
        n3 = sum(np.bincount(where, minlength=4 * _N) for where in self.met).reshape(_N, 4)
        self.met = []
        for k, (sel, applies) in enumerate(((_SEL2, _APPLIES2), (_SEL1, _APPLIES1))):
            n = np.where(applies, n3[:, k:].sum(1), 0)
            hits = np.where(applies, n3[:, k], 0)
            all_n = np.bincount(sel, weights=n, minlength=16).astype(np.int64)
            seen = np.flatnonzero(all_n)
            m = all_n[seen]
            rate = np.minimum(m, 64)
            mean = np.bincount(sel, weights=hits, minlength=16).astype(np.int64)[seen] * (_PROB - 1) // m
            self.right[k][seen] = np.clip(self.right[k][seen] + (mean - self.right[k][seen]) * rate // 128, 32, _PROB - 32)
            error = hits * _PROB - n * self.p[k]
            for i, x in enumerate(self.inputs[k]):
                step = np.bincount(sel, weights=error * x, minlength=16).astype(np.int64)[seen] // m
                self.weights[k][seen, i] += (step * rate) >> 14

    def update(self, ids: np.ndarray, where: np.ndarray) -> None:
        self.met.append(where)
        fresh = ids << 3 | 1
        for table, c, e, g, sure in ((self.next2, self.c2, self.e2, self.g2, self.s2), (self.next1, self.c1, self.e1, self.g1, self.s1)):
            # A guess that fails is halved in confidence, or gives way.
            table[c] = np.where(g == ids, e + (sure < 7), np.where(sure <= 1, fresh, e - (sure + 1 >> 1)))
        self.recent.append(ids)
        self.rows += 1
        if self.rows & (self.rows - 1) == 0 or self.rows % 16 == 0:
            self.counts += np.bincount(np.concatenate(self.recent), minlength=self.v)
            self.recent = []
            self._rebuild()


def _push(state: np.ndarray, begin: np.ndarray, width: np.ndarray, bits: int) -> np.ndarray:
    """The states (changed in place) take up the range from ``begin``, so wide, of 2**bits; returns the words that leave them, in order of lanes."""
    begin, width = begin.astype(_U), width.astype(_U)
    full = np.flatnonzero(state > (width << _U(64 - bits)) - _U(1))  # none if the range is all there is
    words = state[full].astype(np.uint32)
    state[full] >>= _WORD
    q = state // width
    state += (q << _U(bits)) - q * width + begin
    return words


class _Words:
    def __init__(self, words: np.ndarray):
        self.words, self.at = words, 0

    def pop(self, state: np.ndarray, value: np.ndarray, begin: np.ndarray, width: np.ndarray, bits: int) -> None:
        """The states (changed in place) give up the range that holds their ``value``, and take words where they get small."""
        state >>= _U(bits)
        state *= width
        state += value
        state -= begin
        small = np.flatnonzero(state < _LEAST)
        end = self.at + len(small)
        if end > len(self.words):
            raise ValueError("token block is damaged")
        state[small] = (state[small] << _WORD) | self.words[self.at : end]
        self.at = end


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    """Bytes of a block that holds ``ids``, each below ``vocabulary``."""
    n = len(ids)
    ids = np.asarray(ids, dtype=np.int64)
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    lanes = max(1, min(MAX_LANES, n // LANE_IDS))
    rows = -(-n // lanes)
    lanes = -(-n // rows) if n else 1
    grid = np.zeros(lanes * rows, dtype=np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, rows).T)
    model, steps = _Model(vocabulary), []
    p2 = p1 = np.full(lanes, vocabulary, dtype=np.int64)
    for r in range(rows):
        m = -(-(n - r) // rows)
        x = grid[r, :m]
        model.look(p2[:m], p1[:m])
        outcome = (2 - (model.g1 == x).astype(np.int64)) * (model.g2 != x)
        where = (model.at << 2) + outcome
        miss = np.flatnonzero(outcome == 2)
        missed = x[miss]
        steps.append((m, model.begins.take(where), model.widths.take(where), miss.astype(np.uint32), model.start.take(missed), model.size.take(missed)))
        model.update(x, where)
        p2, p1 = p1[:m], x
    state, words = np.full(lanes, _LEAST, dtype=_U), []
    while steps:
        m, begin, width, miss, start, size = steps.pop()
        rest = state[miss]
        words.append(_push(rest, start, size, _ORDER0_BITS))
        state[miss] = rest
        words.append(_push(state[:m], begin, width, _PROB_BITS))
    body = state.astype("<u8").tobytes() + b"".join(w.astype("<u4").tobytes() for w in reversed(words))
    return _HEAD.pack(MAGIC, n, vocabulary, lanes, crc, len(body)) + body


def decode_block(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """Ids of the block at ``at`` and the place after it; ValueError if they do not have their checksum."""
    magic, n, vocabulary, lanes, crc, size = _HEAD.unpack_from(data, at)
    at += _HEAD.size
    if magic != MAGIC or len(data) < at + size:
        raise ValueError("no token block here")
    if lanes < 1 or size < 8 * lanes or size % 4:
        raise ValueError("token block is damaged")
    state = np.frombuffer(data, dtype="<u8", count=lanes, offset=at).astype(_U)
    words = _Words(np.frombuffer(data, dtype="<u4", count=(size - 8 * lanes) // 4, offset=at + 8 * lanes))
    rows = -(-n // lanes)
    grid = np.zeros((rows, lanes), dtype=np.int64)
    model = _Model(vocabulary)
    p2 = p1 = np.full(lanes, vocabulary, dtype=np.int64)
    try:
        for r in range(rows):
            m = -(-(n - r) // rows)
            model.look(p2[:m], p1[:m])
            now = state[:m]
            value = now & _U(_PROB - 1)
            where = model.at << 2
            outcome = (value >= model.begins.take(where + 1)).astype(np.int64) + (value >= model.begins.take(where + 2))
            where += outcome
            words.pop(now, value, model.begins.take(where), model.widths.take(where), _PROB_BITS)
            x = np.where(outcome == 0, model.g2, model.g1)
            miss = np.flatnonzero(outcome == 2)
            rest = now[miss]
            value = rest & _U((1 << _ORDER0_BITS) - 1)
            found = model.find(value.astype(np.int64))
            x[miss] = found
            words.pop(rest, value, model.start.take(found), model.size.take(found), _ORDER0_BITS)
            now[miss] = rest
            grid[r, :m] = x
            model.update(x, where)
            p2, p1 = p1[:m], x
    except IndexError as e:
        raise ValueError("token block is damaged") from e
    ids = grid.T.reshape(-1)[:n].astype("<u4")
    if words.at != len(words.words) or (state != _LEAST).any() or zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("token block fails its checksum")
    return ids, at + size
