"""Packing examples into sequences under several limits at once.

Vector bin packing: an example demands tokens, a segment and loss-bearing
tokens; a sequence has a limit on each. Among the open sequences where an
example fits, the one whose remaining room has the largest dot product with the
demand (both as shares of the limits) takes it. Where none fits and enough are
open, the example is cut to fill the fullest, and its rest is placed again.

Every task packs its own rows as they stream by, with a bounded number of open
sequences; nothing is shuffled and no group is gathered.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessella.llm.common import lean
from tessella.llm.tokenize import tokenizer

SEQUENCE, SEGMENTS, END_ID = 1024, 512, 0
OPEN = 24
BATCH_CHARS = 1 << 21


#: Loss-bearing tokens between two places of an example whose tokens all, or none, bear loss.
_SPANS = {True: lambda a, b: b - a, False: lambda a, b: 0}


@dataclass
class Packer:
    """Places examples one by one; ``emit(example, start, length, sequence, offset)`` learns where each piece went.

    ``limits``: tokens, segments and loss-bearing tokens of a sequence. Without
    ``cuttable``, an example goes whole into a sequence; one longer than a
    sequence is then cut at its limit.
    """

    emit: Callable
    limits: tuple[int, int, int] = (SEQUENCE, SEGMENTS, SEQUENCE)
    cuttable: bool = True
    next_sequence: int = 0
    room: np.ndarray = field(init=False)
    pieces: list = field(init=False)

    def __post_init__(self):
        self.room = np.zeros((0, 3), dtype=np.int64)
        self.pieces = []
        self.scale = 1.0 / np.asarray(self.limits, dtype=np.float64)

    def add(self, example, tokens: int, loss: np.ndarray | bool = True) -> None:
        """Place an example; ``loss`` flags its loss-bearing tokens, each or all alike."""
        loss_of = _SPANS[loss] if isinstance(loss, bool) else (lambda a, b: int(loss[a:b].sum()))
        start, limit = 0, self.limits[0]
        while start < tokens:
            left = tokens - start
            if left >= limit and loss_of(start, start + limit) <= self.limits[2]:
                self.emit(example, start, limit, self.next_sequence, 0)
                self.next_sequence += 1
                start += limit
                continue
            need = np.array([left, 1, loss_of(start, tokens)])
            fits = (self.room >= need).all(1)
            if fits.any():
                i = int(np.argmax(np.where(fits, (self.room * self.scale) @ (need * self.scale), -1.0)))
                length = left
            elif len(self.room) < OPEN or not self.cuttable:
                if len(self.room) >= OPEN:
                    self._close(int(np.argmin(self.room[:, 0])))
                i = len(self.room)
                self.room = np.vstack([self.room, self.limits])
                self.pieces.append([])
                length = min(left, limit)
            else:
                i = int(np.argmin(np.where(self.room[:, 1] > 0, self.room[:, 0], limit + 1)))
                length = min(left, int(self.room[i, 0]))
            length = self._within(loss_of, start, length, int(self.room[i, 2]))
            if length == 0:
                self._close(i)
                continue
            self.pieces[i].append((example, start, length, loss_of))
            self.room[i] -= (length, 1, loss_of(start, start + length))
            start += length
            if self.room[i].min() == 0 and (self.room[i, 0] == 0 or self.room[i, 1] == 0):
                self._close(i)

    def _within(self, loss_of, start: int, length: int, allowed: int) -> int:
        """The longest piece of at most ``length`` with at most ``allowed`` loss-bearing tokens."""
        if loss_of(start, start + length) <= allowed:
            return length
        lo, hi = 0, length
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if loss_of(start, start + mid) <= allowed else (lo, mid - 1)
        return lo

    def _close(self, i: int) -> None:
        offset = 0
        for example, start, length, _ in self.pieces.pop(i):
            self.emit(example, start, length, self.next_sequence, offset)
            offset += length
        self.room = np.delete(self.room, i, 0)
        self.next_sequence += bool(offset)

    def finish(self) -> None:
        """Close what is open; where cutting is allowed, the emptiest sequences fill the others first."""
        while self.cuttable and len(self.room) > 1:
            last = int(np.argmax(self.room[:, 0]))
            loose, self.pieces = self.pieces[last], self.pieces[:last] + self.pieces[last + 1 :]
            self.room = np.delete(self.room, last, 0)
            while loose and len(self.room):
                i = int(np.argmax(np.where(self.room[:, 1] > 0, self.room[:, 0], -1)))
                if self.room[i, 1] <= 0 or self.room[i, 0] <= 0:
                    break
                example, start, length, loss_of = loose.pop()
                take = self._within(loss_of, start, min(length, int(self.room[i, 0])), int(self.room[i, 2]))
                if take:
                    self.pieces[i].append((example, start, take, loss_of))
                    self.room[i] -= (take, 1, loss_of(start, start + take))
                if take < length:
                    loose.append((example, start + take, length - take, loss_of))
                if not take or self.room[i, 0] == 0 or self.room[i, 1] == 0:
                    self._close(i)
            if loose:
                used = sum(x[2] for x in loose), len(loose), sum(x[3](x[1], x[1] + x[2]) for x in loose)
                self.pieces.append(loose)
                self.room = np.vstack([self.room, np.subtract(self.limits, used)])
                for i in range(len(self.room) - 2, -1, -1):
                    self._close(i)
                break
        while len(self.room):
            self._close(0)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, loss_col: str | None = None, limits: tuple[int, int, int] = (SEQUENCE, SEGMENTS, SEQUENCE), cuttable: bool = True) -> DataFrame:
    """One row per piece of a document in a packed sequence (columns of SCHEMA).

    Every document is tokenized whole (null: empty) and followed by ``end_id``;
    each id lies in exactly one piece. ``limits``: tokens, segments and
    loss-bearing tokens of a sequence; pieces lie in it without gaps from offset
    0. ``loss_col`` names a boolean column that says whether a row's ids bear
    loss, as the assistant's turns do in instruction data (null: they don't);
    without it all do. Unless ``cuttable``, only rows longer than a sequence or
    its loss limit are cut. Sequence ids are unique and, for the same input
    splits, always the same. Rows that repeat an id are packed each; null ids
    stay null; an empty table gives no rows. With the limits of this module,
    padding stays small unless most documents have fewer than two tokens.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(tokenizer_path)
        out: list[tuple] = []

        def emit(example, start, length, sequence, offset):
            doc_id, ids = example
            out.append((doc_id, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), sequence, offset))

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        packer = Packer(emit, limits, cuttable, next_sequence=TaskContext.get().partitionId() << 36)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            keys, texts, bears = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()
            at = 0
            while at < len(keys):
                part, size = [], 0
                while at + len(part) < len(keys) and (not part or size < BATCH_CHARS):
                    part.append(texts[at + len(part)].as_py() or "")
                    size += len(part[-1])
                for key, ids, loss in zip(keys[at : at + len(part)], t.encode(part), bears[at : at + len(part)], strict=True):
                    packer.add((key, np.concatenate((ids, end))), len(ids) + 1, loss)
                at += len(part)
                if out:
                    yield rows()
        packer.finish()
        yield rows()

    loss = f"coalesce(`{loss_col}`, false)" if loss_col else "true"
    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text", f"{loss} as loss").mapInArrow(run, SCHEMA)
