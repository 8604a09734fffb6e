"""Packing of tokenised documents into sequences by minimum bin slack.

Every task packs its own documents; nothing is shuffled and nothing grows with the
table.  A document's ids are cut into whole sequences of ``capacity`` ids and a rest.
Rests are collected in windows of ``WINDOW`` pieces.  In a window the largest rest
opens a sequence and a subset-sum dynamic program over the multiset of remaining
lengths (one bit per reachable sum) fills it; the counts of each length are found by
going back through the program's steps, and the pattern is repeated as often as the
counts allow.  A rest that no multiset completes exactly waits for the next window;
where too many wait, and at the end, they are laid end to end and cut at the capacity.
What is left at the end of a task, less than one sequence, is cut into sequences whose
lengths are powers of two, which need no padding.  So no id of padding is left.

Defined results.  Null text counts as empty: such a document is the end id alone.
Repeated rows are packed once each; rests of equal length are taken in any order; a null
identifier stays null.  Texts of any length are encoded whole.  An empty table gives an
empty result.  Sequence
numbers are unique, not consecutive: the task's partition number is in the upper bits.
Only the identifier and text columns are read.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import from_arrow_schema

from quillstone.llm.bpe import ids_of
from quillstone.llm.rows import as_batch

CAPACITY = 2048
#: Rests packed together, and rests that may wait for a later window.
WINDOW = 4096

PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)


def fill(counts: dict[int, int], lengths: list[int], room: int) -> tuple[int, dict[int, int]]:
    """The largest sum up to ``room`` of a sub-multiset, and its counts.

    ``lengths``: the keys of ``counts`` from large to small.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        if length > room:
            continue
        left, part = min(counts[length], room // length), 1
        while left > 0:  # 1, 2, 4, ... copies: any count up to the whole is a sum of these
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, part = left - take, part * 2
        if reach >> room & 1:
            break
    total = rest = reach.bit_length() - 1
    used: dict[int, int] = defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> rest & 1:
            used[length] += take
            rest -= length * take
    return total, used


def minimum_slack(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Patterns (counts by length, times used) that fill sequences exactly, and what is left."""
    counts, patterns, waiting = {k: v for k, v in counts.items() if v}, [], {}
    lengths = sorted(counts, reverse=True)
    while lengths:
        largest = lengths[0]
        counts[largest] -= 1
        room = capacity - largest
        total, used = fill(counts, lengths, room) if room else (0, {})
        counts[largest] += 1
        if total < room:
            waiting[largest] = counts.pop(largest)
            lengths.pop(0)
            continue
        used = {**used, largest: used.get(largest, 0) + 1}
        times = min(counts[k] // n for k, n in used.items())
        patterns.append((used, times))
        for k, n in used.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        lengths = [k for k in lengths if k in counts]
    return patterns, waiting


class Packer:
    """Packs one task's documents; yields result rows."""

    def __init__(self, partition: int, end_id: int, capacity: int):
        self.next_id, self.end, self.capacity = partition << 40, np.array([end_id], "<u4").tobytes(), capacity
        self.rests: dict[int, list[tuple]] = defaultdict(list)
        self.n = 0

    def take_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        ids += self.end
        total = len(ids) // 4
        for start in range(0, total, self.capacity):
            part = ids[4 * start : 4 * (start + self.capacity)]
            if len(part) == 4 * self.capacity:
                yield doc_id, start, self.capacity, part, total, self.take_id(), 0
            else:
                self.rests[len(part) // 4].append((doc_id, start, part, total))
                self.n += 1
        if self.n >= WINDOW:
            yield from self.window()
            if self.n >= WINDOW // 2:
                yield from self.cut(last=False)

    def window(self) -> Iterator[tuple]:
        patterns, _ = minimum_slack({k: len(v) for k, v in self.rests.items()}, self.capacity)
        for used, times in patterns:
            for _ in range(times):
                sequence, offset = self.take_id(), 0
                for length, n in used.items():
                    for _ in range(n):
                        doc_id, start, part, total = self.rests[length].pop()
                        self.n -= 1
                        yield doc_id, start, length, part, total, sequence, offset
                        offset += length
        self.rests = defaultdict(list, {k: v for k, v in self.rests.items() if v})

    def cut(self, last: bool) -> Iterator[tuple]:
        """Waiting rests end to end, cut at the capacity; the last of them at powers of two."""
        queue = [piece for k in sorted(self.rests, reverse=True) for piece in self.rests[k]]
        left = sum(len(p[2]) // 4 for p in queue)
        self.rests, self.n = defaultdict(list), 0
        room = offset = 0
        for doc_id, start, part, total in queue:
            at, size = 0, len(part) // 4
            while at < size:
                if offset == room:
                    if left < self.capacity and not last:
                        self.rests[size - at].append((doc_id, start + at, part[4 * at :], total))
                        self.n += 1
                        left -= size - at
                        break
                    room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                    sequence, offset = self.take_id(), 0
                n = min(size - at, room - offset)
                yield doc_id, start + at, n, part[4 * at : 4 * (at + n)], total, sequence, offset
                at, offset, left = at + n, offset + n, left - n


def added_tokens(vocabulary_file: str) -> dict[str, int]:
    """The added tokens of a vocabulary file of the tokenizers library, which that library
    finds in a text before anything else."""
    with open(vocabulary_file, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


def pack(docs: DataFrame, rank_file: str, pattern: str, end_id: int = 1, capacity: int = CAPACITY, special: dict[str, int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset.

    ``rank_file`` and ``pattern`` give the vocabulary as tiktoken reads it.  A byte-level
    vocabulary of the tokenizers library has the same ids in that form, with its
    ``added_tokens`` as ``special``; without them their strings are ordinary text.
    """
    marks = tuple((special or {}).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, rows, size = Packer(TaskContext.get().partitionId(), end_id, capacity), [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                for row in packer.add(doc_id.as_py(), ids_of(text.as_py() or "", rank_file, pattern, special=marks)):
                    rows.append(row)
                    size += len(row[3])
                    if size > 4_000_000:
                        yield as_batch(rows, PIECES)
                        rows, size = [], 0
        for step in (packer.window(), packer.cut(last=True)):
            rows.extend(step)
            if rows:
                yield as_batch(rows, PIECES)
                rows = []

    return docs.select(id_col, text_col).mapInArrow(run, from_arrow_schema(PIECES))
