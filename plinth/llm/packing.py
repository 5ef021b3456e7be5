"""Vector bin packing of tokenised examples into fixed-length training sequences.

A sequence is a bin with three limits at once: tokens, segments and loss-bearing tokens. The open
bin takes the item that fits and has the largest dot product of its demand with what the bin has
left (both as shares of the limits). ``pack_examples`` keeps examples whole; ``pack_documents`` may
cut them: full-length pieces make sequences of their own, the rest is placed by the same rule, and
when nothing fits, the best item is cut to fill the bin. What a partition has left at its end is
dealt into sequences whose lengths are powers of two, which need no padding.

Items of equal demand are one class, and classes are scored, not items. Placement happens inside each
input partition, one bounded pool at a time: no shuffle, no group of any size in one place. Defined cases: a null text is empty (its document is the end id alone); a null
id stays null; repeated rows are packed each; an empty table gives no rows; other columns are ignored.
Run it over a stored table, so that a task that is tried again sees the same rows in the same order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, tokens

POOL = 4096  # items among which the open bin may choose
LEAST_WASTE = 16  # tokens of padding that are left rather than cutting on
SCHEMA = "{id} {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Fills bins from a pool of items (tag, start, tokens, loss). Emits (tag, start, tokens, bin, offset)."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, cut: bool, base: int = 0):
        self.limits = np.array([max_tokens, max_segments, max_loss], dtype=float)
        self.cut, self.bin = cut, base
        self.full = min(max_tokens, max_loss)
        self.count = 0
        self.classes: dict[tuple[int, int], int] = {}  # (tokens, loss) to a row of the tables
        self.items: list[deque] = []  # (tag, start) of each class, in order of arrival
        self.demand = np.zeros((64, 3))
        self.free = np.zeros(64, dtype=bool)

    @property
    def waiting(self) -> set:
        return {tag for own in self.items for tag, _ in own}

    def add(self, tag, n: int, loss: int) -> Iterator[tuple]:
        start = 0
        if self.cut:
            dense = loss == n  # else loss-bearing tokens are taken to be spread evenly
            size = self.full if dense else max(1, min(int(self.limits[0]), int(self.limits[2] * n / max(loss, 1))))
            while n - start >= size:
                yield tag, start, size, self.bin, 0
                self.bin += 1
                start += size
            if start == n:
                return
            loss = loss - loss * start // n
        elif n > self.limits[0] or loss > self.limits[2]:
            raise ValueError(f"example {tag!r} of {n} tokens, {loss} with loss, fits no sequence")
        self._put(tag, start, n - start, loss)
        if self.count >= POOL:
            yield from self.fill(POOL // 2)

    def _put(self, tag, start: int, n: int, loss: int, first: bool = False) -> None:
        k = self.classes.get((n, loss))
        if k is None:
            k = self.classes[n, loss] = len(self.items)
            self.items.append(deque())
            if k >= len(self.demand):
                self.demand, self.free = np.r_[self.demand, np.zeros_like(self.demand)], np.r_[self.free, np.zeros_like(self.free)]
            self.demand[k] = np.array([n, 1, loss]) / self.limits
        (self.items[k].appendleft if first else self.items[k].append)((tag, start))
        self.free[k] = True
        self.count += 1

    def _take(self, k: int) -> tuple:
        tag, start = self.items[k].popleft()
        self.free[k] = bool(self.items[k])
        self.count -= 1
        return tag, start

    def _tidy(self) -> None:
        """Drops classes without items once they are the most."""
        if len(self.items) > 2 * POOL:
            old = [(key, self.items[k]) for key, k in self.classes.items() if self.items[k]]
            self.classes, self.items, self.count = {}, [], 0
            self.free[:] = False
            for (n, loss), own in old:
                for tag, start in own:
                    self._put(tag, start, n, loss)

    def fill(self, keep: int) -> Iterator[tuple]:
        """Closes full bins until at most ``keep`` items are left."""
        self._tidy()
        sizes = {k: key for key, k in self.classes.items()}
        while self.count > keep:
            room, placed, used = np.ones(3), [], 0
            while self.count:
                n_classes = len(self.items)
                demand, free = self.demand[:n_classes], self.free[:n_classes]
                fits = free & (demand <= room + 1e-9).all(1)
                whole = bool(fits.any())
                if whole:
                    best = int(np.where(fits, demand @ room, -1.0).argmax())
                elif self.cut and used < self.limits[0] and room[1] * self.limits[1] > 0.5 and room[2] * self.limits[2] >= 1:
                    best = int(np.where(free, demand @ room, -1.0).argmax())
                else:
                    break
                n, loss = sizes[best]
                tag, start = self._take(best)
                take, lost = n, loss
                if not whole:
                    take = int(min(n, self.limits[0] - used))
                    lost = -(-loss * take // n)
                    if lost > (most := round(room[2] * self.limits[2])):
                        take, lost = max(1, int(take * most / lost)), int(most)
                    rest = n - take, max(0, loss - lost)
                    self._put(tag, start + take, *rest, first=True)
                    sizes[self.classes[rest]] = rest
                placed.append((tag, start, take))
                used += take
                room = room - np.array([take, 1, lost]) / self.limits
            if self.cut and not self.count and self.limits[0] - used > LEAST_WASTE:
                yield from self._powers(placed, used)
                continue
            at = 0
            for tag, start, n in placed:
                yield tag, start, n, self.bin, at
                at += n
            self.bin += 1

    def _powers(self, placed: list[tuple], used: int) -> Iterator[tuple]:
        room = 1 << (used.bit_length() - 1)
        at = 0
        for tag, start, n in placed:
            while n:
                take = min(n, room - at)
                yield tag, start, take, self.bin, at
                at, start, n, used = at + take, start + take, n - take, used - take
                if at == room:
                    self.bin += 1
                    at, room = 0, 1 << max(used.bit_length() - 1, 0)

    def finish(self) -> Iterator[tuple]:
        if self.count:
            yield from self.fill(0)


def _first_bin() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 33


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 1024, max_segments: int = 256, max_loss: int | None = None, end_id: int = tokens.END_ID) -> DataFrame:
    """Tokenises, cuts and packs texts: one row per piece, with its ids as little-endian unsigned 32-bit.

    Every token of a document bears loss. Each id lies in exactly one piece; a sequence's pieces are gapless.
    """
    path = tokenizer_path or tokens.default_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(max_tokens, max_segments, max_loss or max_tokens, True, _first_bin())
        held: dict[int, tuple] = {}
        count = 0
        schema = None

        def emit(pieces) -> pa.RecordBatch:
            rows = [(held[tag][0], start, n, held[tag][1][start : start + n].tobytes(), len(held[tag][1]), seq, at) for tag, start, n, seq, at in pieces]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            if schema is None:
                long = pa.int64()
                schema = pa.schema([(id_col, batch.schema.field(0).type), ("start", long), ("length", long), ("ids", pa.binary()), ("doc_tokens", long), ("sequence_id", long), ("offset", long)])
            for part in tokens.portions(batch, 1):
                out = []
                ids, ends = tokens.encode_column(part.column(1), path, end_id)
                for key, own in zip(part.column(0).to_pylist(), np.split(ids, ends[:-1]), strict=True):
                    held[count] = (key, own)
                    out += packer.add(count, len(own), len(own))
                    count += 1
                yield emit(out)
                waiting = packer.waiting
                held = {tag: (held[tag][0], held[tag][1].copy() if held[tag][1].base is not None else held[tag][1]) for tag in held.keys() & waiting}
        if schema is not None:
            yield emit(list(packer.finish()))

    return common.arrow_map(docs.select(id_col, text_col), run, SCHEMA.format(id=f"`{id_col}`", kind=kind))


def pack_examples(examples: DataFrame, id_col: str, tokens_col: str, loss_col: str, max_tokens: int = 1024, max_segments: int = 64, max_loss: int = 1024) -> DataFrame:
    """Places whole examples of given token and loss counts: rows (id, sequence_id, offset). Null counts are 0.

    An example beyond a limit raises ValueError, as it fits no sequence uncut.
    """
    kind = examples.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(max_tokens, max_segments, max_loss, False, _first_bin())
        schema, keys, count = None, {}, 0

        def emit(pieces) -> pa.RecordBatch:
            rows = [(keys.pop(tag), seq, at) for tag, _, _, seq, at in pieces]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            schema = schema or pa.schema([(id_col, batch.schema.field(0).type), ("sequence_id", pa.int64()), ("offset", pa.int64())])
            out = []
            for key, n, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys[count] = key
                out += packer.add(count, n or 0, loss or 0)
                count += 1
            yield emit(out)
        if schema is not None:
            yield emit(list(packer.finish()))

    return common.arrow_map(examples.select(id_col, tokens_col, loss_col), run, f"`{id_col}` {kind}, sequence_id long, offset long")
