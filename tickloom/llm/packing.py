"""Order-preserving packing by dynamic programming.

The documents of one input partition, in their order, form one stream of tokens. Windows of at most
``LIMIT`` tokens are cut from it at document ends, sentence ends or, where no sentence ends for long, at
spaced-out tokens. A cut's cost is the padding of its window plus a penalty for what it cuts through; for
windows of one size class the best earlier cut is the front of a monotone queue, so a cut costs O(1).

A window is padded to ``LIMIT`` unless its length is a power of two, which is a second kind of transition.
The stream runs through bounded buffers: the last window of a buffer is reopened in the next, so that only
the end of a partition can be short, and that end falls apart into powers of two.

Nothing is shuffled: a lost task is run again from its input partition with the same result.
Defined results: a null text is an empty document (just its end token); repeated rows and equal ids are
documents each; ids may be null and of any type; an empty table gives no pieces; further columns are not read.
Words are known by a 64-bit hash of their bytes.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WordBpe, tokenizer_path
from .common import as_bytes

LIMIT = 4096
END_ID = 2
#: Costs, in padding tokens: of a window, and of a cut after a sentence or inside one.
WINDOW_COST, SENTENCE_COST, INSIDE_COST = 32, 8, 48
#: Farthest apart that two places to cut may lie inside a sentence.
SPACING = 64
#: Tokens that are planned together.
BUFFER = 1 << 19
#: Smallest power of two that a plan uses on purpose.
LEAST_POWER = 256

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NUMBERS = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def plan(cuts: np.ndarray, costs: np.ndarray, limit: int = LIMIT) -> list[int]:
    """Indices of the chosen cuts (first and last included) of least total cost. Neighbouring cuts lie at most ``limit`` apart."""
    n = len(cuts)
    place, cost = cuts.tolist(), costs.tolist()
    exact: dict[int, list[int]] = {}
    power = LEAST_POWER
    while power <= limit:
        i = np.searchsorted(cuts, cuts - power)
        for j in np.flatnonzero(cuts[i] == cuts - power).tolist():
            exact.setdefault(j, []).append(int(i[j]))
        power *= 2
    best, back = [0] * n, [0] * n
    queue: deque[tuple[int, int, int]] = deque([(place[0], place[0], 0)])  # (cost so far + place, place, index), costs rising
    for j in range(1, n):
        here = place[j]
        while queue[0][1] < here - limit:
            queue.popleft()
        value, _, i = queue[0]
        total = value + limit - here
        for e in exact.get(j, ()):
            if best[e] < total:
                total, i = best[e], e
        total += cost[j] + WINDOW_COST
        best[j], back[j] = total, i
        value = total + here
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, here, j))
    chosen = [n - 1]
    while chosen[-1]:
        chosen.append(back[chosen[-1]])
    return chosen[::-1]


def candidates(lengths: list[int], ends: list[np.ndarray], limit: int = LIMIT, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places to cut and what a cut costs there. ends: for each document, tokens after which a sentence ends. skip: tokens already gone from the first."""
    places, costs, base = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], -skip
    for n, end in zip(lengths, ends, strict=True):
        inner = end[end < n] + base
        places += [inner, np.array([n + base])]
        costs += [np.full(len(inner), SENTENCE_COST), np.zeros(1, np.int64)]
        base += n
    place, cost = np.concatenate(places), np.concatenate(costs)
    keep = (place > 0) | (np.arange(len(place)) == 0)
    place, cost = place[keep], cost[keep]
    gaps = np.diff(place)
    wide = np.flatnonzero(gaps > SPACING)
    if len(wide):
        extra = np.concatenate([np.arange(place[i] + SPACING, place[i + 1], SPACING) for i in wide])
        place, cost = np.concatenate([place, extra]), np.concatenate([cost, np.full(len(extra), INSIDE_COST)])
        order = np.argsort(place, kind="stable")
        place, cost = place[order], cost[order]
    return place, cost


class _Packer:
    def __init__(self, bpe: WordBpe, first_sequence: int, limit: int) -> None:
        self.bpe, self.limit, self.sequence = bpe, limit, first_sequence
        self.docs: list[list] = []  # doc_id, ids as bytes, tokens
        self.skip = 0  # tokens of the first document that are packed
        self.held = 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        self.docs.append([doc_id, ids, len(ids) // 4])
        self.held += len(ids) // 4
        if self.held >= BUFFER:
            yield from self.flush(last=False)

    def flush(self, last: bool) -> Iterator[tuple]:
        if not self.docs:
            return
        ends = [self.bpe.sentence_ends(d[1]) for d in self.docs]
        place, cost = candidates([d[2] for d in self.docs], ends, self.limit, self.skip)
        bounds = place[plan(place, cost, self.limit)].tolist()
        if not last:
            bounds.pop()
        else:
            bounds = self._spread(bounds)
        if len(bounds) > 1:
            yield from self._pieces(bounds)
        done, self.docs, self.skip, self.held = bounds[-1] + self.skip, self.docs, self.skip, self.held
        gone = 0
        while gone < len(self.docs) and done >= self.docs[gone][2]:
            done -= self.docs[gone][2]
            gone += 1
        self.docs, self.skip = self.docs[gone:], done
        self.held = sum(d[2] for d in self.docs) - done

    def _spread(self, bounds: list[int]) -> list[int]:
        """The last window falls apart into powers of two, which need no padding."""
        if len(bounds) < 2:
            return bounds
        at, left, out = bounds[-2], bounds[-1] - bounds[-2], bounds[:-1]
        while left:
            at += 1 << (left.bit_length() - 1)
            left -= 1 << (left.bit_length() - 1)
            out.append(at)
        return out

    def _pieces(self, bounds: list[int]) -> Iterator[tuple]:
        doc, begin = 0, -self.skip  # of the document at hand, in the places of this buffer
        for left, right in zip(bounds[:-1], bounds[1:], strict=True):
            at = left
            while at < right:
                doc_id, ids, tokens = self.docs[doc]
                stop = min(right, begin + tokens)
                a, b = at - begin, stop - begin
                yield doc_id, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), tokens, self.sequence, at - left
                at = stop
                if stop == begin + tokens:
                    doc, begin = doc + 1, begin + tokens
            self.sequence += 1


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """One row per piece. ``sequence_id`` holds the partition in its upper bits and counts up inside it."""
    path = tokenizer_path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = WordBpe.load(path), np.array([end_id], "<u4").tobytes()
        packer = _Packer(bpe, TaskContext.get().partitionId() << 40, limit)
        rows: list[tuple] = []
        id_type = pa.int64()

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * (1 + len(_NUMBERS))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["doc_id", *_NUMBERS.names])

        for batch in batches:
            id_type, keys = batch.column(0).type, batch.column(0).to_pylist()
            for row, stop, ids, bounds in bpe.encode_steps(batch.column(1)):
                raw, at = ids.astype("<u4").tobytes(), (4 * bounds).tolist()
                for key, a, b in zip(keys[row:stop], at[:-1], at[1:], strict=True):
                    rows += packer.add(key, raw[a:b] + end)
                if len(rows) > 20_000:
                    yield out()
        if packer.docs or rows:
            rows += packer.flush(last=True)
            yield out()

    rows = docs.select(F.col(doc_id).alias("doc_id"), as_bytes(F.col(text)).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
