"""Hierarchical multi-length packing of token sequences.

Each task packs its own documents; nothing is shuffled. A document is cut into full windows while it fills the longest
context; what is left is routed to the tier, the smallest context, that holds it. From the longest tier down, the longest
waiting piece opens a window of its tier and the gap behind it is filled from the shorter pieces: the largest that fits,
and last a piece cut to size. Windows are thus full, at 4096, 2048, 1024 or 512 ids. What remains at a task's end is cut
into full windows of ever smaller powers of two, so nothing is padded. Sequences are then dealt to step groups of
``step_tokens`` ids, longest first; as lengths are powers of two, the groups come out equally full.

With a slot column, the rows are dealt to tasks by ranges of slots and read slot by slot, and after each slot all that
fills windows is written out, in the order of the sequences' first documents. So sequence numbers follow the slots. What
fills no window, under the shortest context's ids, leads the next slot's first sequence. A step group takes each sequence
that fits it; as only small gaps stay open, and few, groups follow the slots too.

At most ``buffer_tokens`` ids wait in a task; then all that fills windows is written out and the rest is carried on.
Null and empty texts are the end id alone. Repeated rows are packed each. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import text_bytes
from .tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, step_group long"
Piece = tuple[int, int, int]  # length, document's number in the buffer, start


class Packer:
    def __init__(self, contexts: tuple[int, ...], step_tokens: int):
        self.contexts = sorted(contexts)
        self.top = self.contexts[-1]
        if any(c & (c - 1) for c in self.contexts):
            raise ValueError("contexts must be powers of two")
        self.step_tokens = step_tokens
        self.pool: list[Piece] = []  # sorted
        self.done: list[list[Piece]] = []
        self.waiting = 0
        self.open: list[list[int]] = []  # step groups with room: [number, ids left]
        self.groups = 0

    def add(self, doc: int, n: int) -> None:
        at = 0
        while n - at >= self.top:
            self.done.append([(self.top, doc, at)])
            at += self.top
        if n > at:
            insort(self.pool, (n - at, doc, at))
            self.waiting += n - at

    def window(self, size: int, lead: int | None, got: list[Piece] | None = None) -> None:
        """Fill one window, from the piece at ``lead`` on; the pool holds enough ids. ``got`` are pieces that it starts with."""
        got = got or []
        gap = size - sum(p[0] for p in got)
        while gap:
            at = lead if not got else bisect_right(self.pool, (gap, 1 << 62, 0)) - 1
            n, doc, start = self.pool.pop(max(at, 0))
            take = min(n, gap)
            got.append((take, doc, start))
            if take < n:
                insort(self.pool, (n - take, doc, start + take))
            gap -= take
        self.waiting -= size
        self.done.append(got)

    def carried(self, before: int) -> None:
        """Fill one window that starts with the pieces of documents numbered below ``before``."""
        old = sorted((p for p in self.pool if p[1] < before), key=lambda p: p[1:])
        n = sum(p[0] for p in old)
        fits = [c for c in self.contexts if n <= c <= self.waiting]
        if old and fits:
            self.pool = [p for p in self.pool if p[1] >= before]
            longest = self.pool[-1][0] if self.pool else 0
            self.window(next((c for c in fits if c >= longest), fits[-1]), None, old)

    def drain(self, last: bool) -> None:
        """Write out full windows of every tier; with ``last`` also what fills no tier."""
        for k in range(len(self.contexts) - 1, -1, -1):
            size, below = self.contexts[k], self.contexts[k - 1] if k else 0
            while self.waiting >= size and self.pool and self.pool[-1][0] > below:
                self.window(size, len(self.pool) - 1)
        if last:
            size = self.top
            while size:
                while self.waiting >= size:
                    self.window(size, max(0, bisect_left(self.pool, (size, 1 << 62, 0)) - 1))
                size //= 2

    def steps(self) -> Iterator[tuple[int, list[Piece], int]]:
        """The sequences done so far: (step group, pieces, length), longest first."""
        group, left = 0, self.step_tokens
        for got in sorted(self.done, key=lambda x: -sum(p[0] for p in x)):
            n = sum(p[0] for p in got)
            if n > left:
                group, left = group + 1, self.step_tokens
            left -= n
            yield group, got, n
        self.done = []

    def in_order(self) -> Iterator[tuple[int, list[Piece], int]]:
        """As ``steps``, by first document; groups reach over calls, and their numbers go on."""
        for got in sorted(self.done, key=lambda x: min(p[1] for p in x)):
            n = sum(p[0] for p in got)
            at = next((g for g in self.open if g[1] >= n), None)
            if at is None:
                at = [self.groups, max(n, self.step_tokens)]
                self.groups += 1
                self.open.append(at)
            at[1] -= n
            if not at[1]:
                self.open.remove(at)
            yield at[0], got, n
        self.done = []


def _pack(path: str, end_id: int, contexts: tuple[int, ...], step_tokens: int, buffer_tokens: int, by_slot: bool) -> Callable:
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(path), Packer(contexts, step_tokens)
        docs: dict[int, tuple] = {}
        high = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        n_docs = n_seq = n_group = held = first = 0
        slot = None

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal n_seq, n_group, held, first
            if by_slot:
                packer.carried(first)
                first = n_docs
            packer.drain(last)
            out: list[tuple] = []
            most = -1
            for group, got, n in packer.in_order() if by_slot else packer.steps():
                offset, most = 0, -1 if by_slot else group
                for take, doc, start in got:
                    doc_id, ids = docs[doc]
                    out.append((doc_id, start, take, zlib.crc32(ids[4 * start : 4 * (start + take)]), len(ids) // 4, high + n_seq, offset, n, high + n_group + group))
                    offset += take
                n_seq += 1
            n_group += most + 1
            left = {p[1] for p in packer.pool}
            for k in [k for k in docs if k not in left]:
                held -= len(docs.pop(k)[1]) // 4
            for at in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[at : at + 20_000])], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            slots = batch.column(2).to_pylist() if by_slot else [None] * len(batch)
            for doc_id, raw, now in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), slots):
                if now != slot:
                    if n_docs:
                        yield from flush(False)
                    slot = now
                ids = enc.ids(raw.decode()) + end
                docs[n_docs] = (doc_id, ids)
                packer.add(n_docs, len(ids) // 4)
                n_docs += 1
                held += len(ids) // 4
                if held >= buffer_tokens:
                    yield from flush(False)
        yield from flush(True)

    return run


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, contexts: tuple[int, ...] = (512, 1024, 2048, 4096), step_tokens: int = 65_536, buffer_tokens: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", slot_col: str | None = None, place_col: str | None = None) -> DataFrame:
    """One row per piece; see ``SCHEMA``. Sequence and group numbers hold the task's number in their upper bits.

    ``slot_col`` and ``place_col`` give the order of the rows, if it is to be kept.
    """
    columns = [docs[id_col].cast("long").alias("doc_id"), text_bytes(text_col)]
    if slot_col is None:
        rows = docs.select(*columns)
    else:
        rows = docs.select(*columns, docs[slot_col].cast("long").alias("slot"), docs[place_col].alias("place"))
        rows = rows.repartitionByRange("slot").sortWithinPartitions("slot", "place", "doc_id").drop("place")
    return rows.mapInArrow(_pack(vocabulary, end_id, tuple(contexts), step_tokens, buffer_tokens, slot_col is not None), SCHEMA)
