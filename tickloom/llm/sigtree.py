"""N-gram Jaccard join with signature trees.

A document is its set of distinct 5-word shingles, each a 64-bit hash. Two documents link when their Jaccard
coefficient is 0.75 or more; all such links count, and components of them are returned.

Inside a task, documents hang in a signature tree: a node holds the OR of the token bitmaps below it and the
range of their set sizes. Two trees (or one with itself) are walked together; a pair of nodes goes no further
if the sizes can't fit or if the bits they share leave too small an overlap possible.

What meets in a task is found in three exact steps, so that work follows the links and not all pairs:

1. Documents with the same set become one class (two 64-bit sums over the set and its size).
2. Linked sets share at least k of their smallest hashes, so a class without k shared ones links with nothing.
   Postings for this are packed per bucket of the hash; a hash with a million documents is one run of numbers.
   Inside a bucket 32 bits stand for a hash: two that look alike may add a count, but none is ever lost.
3. What is left meets twice. First by min-hash, in tiles of bounded size: this joins nearly all near copies
   into components. Then, for completeness, sets that lie to three quarters in sets of other components meet in
   families: sets of two components and of near enough sizes that share a hash of their prefix are of one family.
   The prefix takes hashes that many sets hold last, so a passage that many texts quote chains only those that hold
   little else. A family is one tile, or all pairs of tiles if it is larger, so each set travels once for each tile
   and not for each hash. Pairs inside one component are never compared, so a group of copies costs about one
   comparison a member.

Python memory is bounded by a bucket of postings, of which there are the more the more hashes there are, or by two tiles
of sets. Nothing but two fixed bitmaps of 8 MB, sums and emptiness tests reaches the driver.

Defined results: without words or text the set is empty, linked with nothing, and the component is the own id;
repeated rows are equal sets, hence one component; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import MULTIPLIERS, Words, as_bytes, discard, few, fresh, give_back, materialise, mix, word_steps
from .components import components

SHINGLE = 5
#: The threshold in hundredths.
PERCENT = 75
#: Share of a set, beyond the prefix that any link must touch, that the first filter looks at.
EXTRA_PERCENT = 15
#: Documents in one tile, and children of a tree node.
TILE, FANOUT = 1024, 8
#: Bits of the bitmaps: that which keeps sets without a chance from being shuffled, and that of hashes with many sets.
SIEVE_BITS = 1 << 26
#: A hash with more sets comes last in their prefixes.
HOT = 16
#: Rows of 16 bytes that may be broadcast.
FEW = 1 << 20


def shingle_sets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, rising, end to end; and where each text begins."""
    keys, at = words.windows(SHINGLE)
    doc = words.doc[at]
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        whole = []
        for d in short.tolist():
            h = words.hashes[words.first[d] : words.first[d + 1]]
            whole.append(np.sum(mix(h * MULTIPLIERS[: len(h)])) + np.uint64(len(h)))
        keys = np.concatenate([keys, mix(np.array(whole, np.uint64))])
        doc = np.concatenate([doc, short])
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    if len(keys):
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])])
        keys, doc = keys[new], doc[new]
    return keys, np.searchsorted(doc, np.arange(len(counts) + 1))


def _class_keys(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each set."""
    out = []
    for m in MULTIPLIERS[8:10]:
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(keys * m), dtype=np.uint64)])
        out.append(mix((total[first[1:]] - total[first[:-1]]) + np.diff(first).astype(np.uint64)))
    return out[0], out[1]


def _class_of(text: pa.Array) -> pa.Array:
    n, k1, k2 = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for _, _, words in word_steps(text):
        keys, first = shingle_sets(words)
        a, b = _class_keys(keys, first)
        n.append(np.diff(first))
        k1.append(a.view(np.int64))
        k2.append(b.view(np.int64))
    return pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in (n, k1, k2)], ["n", "k1", "k2"])


def _least_kept(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of a set of n with any linked set."""
    return -(-n * percent // 100)


def _extra(n: np.ndarray) -> np.ndarray:
    return np.maximum(1, n * EXTRA_PERCENT // 100)


def _take(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of the first ``size`` entries of each run."""
    return np.repeat(first[:-1], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


_POSTING = pa.schema([("bucket", pa.int32()), ("counted", pa.bool_()), ("docs", pa.binary()), ("counts", pa.binary()), ("marks", pa.binary())])
_POSTED = "bucket int, counted boolean, docs binary, counts binary, marks binary"


def _places(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each hash, and its mark: 32 bits that stand for it there."""
    spread = mix(hashes)
    return (spread % np.uint64(buckets)).astype(np.int32), (spread >> np.uint64(32)).astype(np.uint32)


def _pack(hashes: np.ndarray, doc: np.ndarray, table: np.ndarray, buckets: int, counted: bool = False) -> pa.RecordBatch:
    """A row per bucket: the rows of ``table`` of its documents, how many hashes each has there, and their marks.

    A count is a byte, so a document with more hashes in a bucket is there more than once.
    """
    bucket, marks = _places(hashes, buckets)
    order = np.lexsort((doc, bucket))
    marks, doc, bucket = marks[order], doc[order], bucket[order]
    first = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])])) if len(bucket) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(bucket)))
    pieces = -(-size // 255)
    own, which = table[np.repeat(doc[first], pieces)], np.repeat(bucket[first], pieces)
    counts = np.full(len(own), 255, np.uint8)
    counts[np.cumsum(pieces) - 1] = size - 255 * (pieces - 1)
    found, at = np.unique(which, return_index=True)
    ends, edge = [*at[1:].tolist(), len(which)], np.searchsorted(bucket, found, side="right").tolist()
    rows = list(zip(at.tolist(), ends, [0, *edge[:-1]], edge, strict=True)) if len(found) else []
    columns = [found, [counted] * len(rows), [own[a:b].tobytes() for a, b, _, _ in rows], [counts[a:b].tobytes() for a, b, _, _ in rows], [marks[a:b].tobytes() for _, _, a, b in rows]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _POSTING.types, strict=True)], schema=_POSTING)


def _unpack(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Marks and, for each, its document's row."""
    docs = np.frombuffer(b"".join(table["docs"].to_pylist()), np.int64).reshape(-1, width)
    counts = np.frombuffer(b"".join(table["counts"].to_pylist()), np.uint8)
    return np.frombuffer(b"".join(table["marks"].to_pylist()), np.uint32), np.repeat(docs, counts, axis=0)


def _twins(hashes: np.ndarray, doc: np.ndarray, buckets: int) -> np.ndarray:
    """Which hashes look like an earlier one of the same document in their bucket."""
    bucket, marks = _places(hashes, buckets)
    order = np.lexsort((bucket, marks, doc))
    doc, marks, bucket = doc[order], marks[order], bucket[order]
    twin = np.zeros(len(order), dtype=bool)
    twin[order[1:]] = (doc[1:] == doc[:-1]) & (marks[1:] == marks[:-1]) & (bucket[1:] == bucket[:-1])
    return twin


#: Hashes in a bucket of postings, about.
BUCKET_HASHES = 1 << 20


def _buckets(sizes: DataFrame, share: int = 100) -> int:
    """So many buckets that each holds about ``BUCKET_HASHES``, and one for each shuffle partition at least. sizes: column n; share: hundredths posted."""
    hashes = (sizes.agg(F.sum("n")).first()[0] or 0) * share // 100
    return max(1, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(hashes) // BUCKET_HASHES))


_DEALT = "target int, keys binary, counts binary"


def _dealt(keys: np.ndarray, counts: np.ndarray, targets: int) -> pa.Table:
    """Counts of one bucket, packed by where their keys are summed up: a row for each target and not for each key."""
    target = (mix(keys.astype(np.int64).view(np.uint64)) % np.uint64(targets)).astype(np.int32)
    order = np.argsort(target, kind="stable")
    keys, counts, target = keys[order].astype(np.int64), counts[order].astype(np.int64), target[order]
    own, first = np.unique(target, return_index=True)
    edge = [*first.tolist(), len(target)]
    pieces = list(zip(edge, edge[1:], strict=False))
    return pa.table({"target": pa.array(own, pa.int32()), "keys": pa.array([keys[a:b].tobytes() for a, b in pieces], pa.binary()), "counts": pa.array([counts[a:b].tobytes() for a, b in pieces], pa.binary())})


def _added(keys: pa.ChunkedArray, counts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Packed keys, each once, and the sums of their packed counts."""
    k, which = np.unique(np.frombuffer(b"".join(keys.to_pylist()), np.int64), return_inverse=True)
    return k, np.bincount(which, np.frombuffer(b"".join(counts.to_pylist()), np.int64), len(k)).astype(np.int64)


def _summed(dealt: DataFrame) -> DataFrame:
    """(k1, c): the packed counts added up."""

    def add(table: pa.Table) -> pa.Table:
        k, total = _added(table["keys"], table["counts"])
        return pa.table({"k1": k, "c": total})

    return dealt.groupBy("target").applyInArrow(add, "k1 long, c long")


def _survivors(texts: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Keys of classes that share enough of their smallest hashes to have a link. sizes: (k1, n).

    A hash that two classes of one step share is counted for them there, and one of them goes on to its bucket: a hash
    that very many texts hold is one posting a step, and not one a text. A class that copies spread over steps may be
    counted once a step, so counts may be too high but never too low.
    """
    buckets = _buckets(sizes, 100 - percent + EXTRA_PERCENT)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words in word_steps(batch.column(0)):
                keys, first = shingle_sets(words)
                n = np.diff(first)
                k1, _ = _class_keys(keys, first)
                once = np.zeros(len(n), dtype=bool)  # a class counts once in a step
                once[np.unique(k1, return_index=True)[1]] = True
                size = np.minimum(n, n - _least_kept(n, percent) + _extra(n)) * ((n > 0) & once)
                at, doc = _take(first, size), np.repeat(np.arange(len(n)), size)
                hashes = keys[at]
                order = np.argsort(hashes, kind="stable")
                hashes, doc = hashes[order], doc[order]
                begin = np.concatenate([[True], hashes[1:] != hashes[:-1]]) if len(hashes) else np.empty(0, bool)
                here = np.diff(np.append(np.flatnonzero(begin), len(hashes)))
                shared = np.repeat(here > 1, here)
                keep = ~shared | begin
                # Of hashes of a text that look alike in their bucket one is posted, and the others are counted here.
                twin = np.zeros(len(hashes), dtype=bool)
                twin[keep] = _twins(hashes[keep], doc[keep], buckets)
                keep &= ~twin
                for counted in (False, True):
                    at = keep & (shared == counted)
                    yield _pack(hashes[at], doc[at], k1.view(np.int64)[:, None], buckets, counted)
                own, c = np.unique(k1.view(np.int64)[doc[shared | twin]], return_counts=True)
                if len(own):
                    dealt = _dealt(own, c, buckets)
                    none = pa.array([b""] * dealt.num_rows, pa.binary())
                    columns = [pa.array(-1 - dealt["target"].to_numpy(), pa.int32()), pa.array([True] * dealt.num_rows), dealt["keys"].combine_chunks(), dealt["counts"].combine_chunks(), none]
                    yield pa.RecordBatch.from_arrays(columns, schema=_POSTING)

    def count(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        if bucket < 0:  # counts that tasks made themselves, by their target
            target, c = pa.array([-1 - bucket], pa.int32()), _added(table["docs"], table["counts"])
            return pa.table({"target": target, "keys": pa.array([c[0].tobytes()], pa.binary()), "counts": pa.array([c[1].tobytes()], pa.binary())})
        hashes, doc = _unpack(table, 1)
        doc, counted = doc[:, 0], np.repeat(table["counted"].to_numpy(), [len(x) // 4 for x in table["marks"].to_pylist()])
        # Of a hash and class the posting that is counted already comes first, and stands for the others.
        order = np.lexsort((~counted, doc, hashes))
        hashes, doc, counted = hashes[order], doc[order], counted[order]
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])])
        hashes, doc, counted = hashes[new], doc[new], counted[new]
        same = hashes[1:] == hashes[:-1]
        shared = np.zeros(len(hashes), dtype=bool)
        shared[1:] |= same
        shared[:-1] |= same
        # A counted posting has a partner that isn't here.
        begin = np.flatnonzero(np.concatenate([[True], ~same]))
        shared |= np.repeat(np.logical_or.reduceat(counted, begin), np.diff(np.append(begin, len(hashes))))
        k, c = np.unique(doc[shared & ~counted], return_counts=True)
        give_back()
        return _dealt(k, c, buckets)

    found = _summed(texts.mapInArrow(post, _POSTED).groupBy("bucket").applyInArrow(count, _DEALT))
    kept = F.ceil(F.col("n") * percent / F.lit(100)).cast("long")
    enough = F.greatest(F.lit(1).cast("long"), F.floor(kept * EXTRA_PERCENT / F.lit(100)))
    found = found.join(sizes.groupBy("k1").agg(F.max("n").alias("n")), "k1")
    return materialise(found.where(F.col("c") >= enough).select("k1"))


def _sieve(keys: DataFrame) -> np.ndarray:
    """A bitmap of fixed size in which the bits of the keys are set."""
    segment = SIEVE_BITS // 256

    def build(table: pa.Table) -> pa.Table:
        bits = np.zeros(segment, np.uint8)
        bits[table["k1"].to_numpy() % segment] = 1
        at = int(table["part"][0].as_py())
        return pa.table({"part": pa.array([at], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    place = F.pmod("k1", F.lit(SIEVE_BITS))
    parts = keys.select(F.floor(place / segment).cast("int").alias("part"), (place % segment).alias("k1")).distinct()
    out = np.zeros((256, segment // 8), np.uint8)
    for row in parts.groupBy("part").applyInArrow(build, "part int, bits binary").toArrow().to_pylist():
        out[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def _sets(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(k1, n, shingles) once for each class in ``keys`` (and a few others that the sieve lets through)."""
    spark = texts.sparkSession
    sieve = spark.sparkContext.broadcast(_sieve(keys).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.frombuffer(sieve.value, np.uint8), np.empty(0, np.uint64)
        for batch in batches:
            for _, _, words in word_steps(batch.column(0)):
                all_keys, first = shingle_sets(words)
                k1, _ = _class_keys(all_keys, first)
                place = (k1.view(np.int64) % SIEVE_BITS).astype(np.int64)
                keep = ((bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1).astype(bool) & (np.diff(first) > 0)
                chosen = np.flatnonzero(keep)
                chosen = chosen[np.unique(k1[chosen], return_index=True)[1]]
                chosen = chosen[~np.isin(k1[chosen], seen)]
                seen = np.union1d(seen, k1[chosen])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[chosen].view(np.int64)), pa.array(np.diff(first)[chosen]), pa.array([all_keys[first[d] : first[d + 1]].tobytes() for d in chosen.tolist()], pa.binary())],
                    names=["k1", "n", "shingles"],
                )

    rows = texts.mapInArrow(run, "k1 long, n long, shingles binary")
    return materialise(rows.groupBy("k1").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles")))


class SignatureTree:
    """Sets under nodes that hold OR-combined bitmaps and size ranges; ``link`` walks the tree against itself."""

    def __init__(self, sets: list[np.ndarray], fanout: int = FANOUT) -> None:
        sizes = np.array([len(s) for s in sets])
        self.order = np.argsort(sizes, kind="stable")
        self.sets = [sets[i] for i in self.order.tolist()]
        self.sizes = sizes[self.order]
        words = 1 << max(2, min(9, int(2 * max(1, self.sizes[-1]) // 64).bit_length()))
        self.bits = np.zeros((len(sets), words), np.uint64)
        for i, s in enumerate(self.sets):
            place = mix(s) % np.uint64(64 * words)
            np.bitwise_or.at(self.bits[i], (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        self.ones = np.bitwise_count(self.bits).sum(axis=1).astype(np.int64)
        self.fanout = fanout
        # levels of (bitmaps, least size, greatest size, most tokens that share a bit with another of their set)
        self.levels = []
        level = (self.bits, self.sizes, self.sizes, self.sizes - self.ones)
        while len(level[0]) > 1 or not self.levels:
            at = np.arange(0, len(level[0]), fanout)
            level = (np.bitwise_or.reduceat(level[0], at), np.minimum.reduceat(level[1], at), np.maximum.reduceat(level[2], at), np.maximum.reduceat(level[3], at))
            self.levels.append(level)

    def _possible(self, level, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        bits, low, high, spare = level
        ok = (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a])
        at = np.flatnonzero(ok)
        most = np.empty(len(at), np.int64)
        for i in range(0, len(at), 4096):
            j = at[i : i + 4096]
            most[i : i + 4096] = np.bitwise_count(bits[a[j]] & bits[b[j]]).sum(axis=1)
        most = np.minimum(np.minimum(most + np.minimum(spare[a[at]], spare[b[at]]), high[a[at]]), high[b[at]])
        ok[at] = most * (100 + percent) >= percent * (low[a[at]] + low[b[at]])
        return ok

    def leaf_pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of lowest nodes (a <= b) below which a link is possible."""
        a = b = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            ok = self._possible(self.levels[depth], a, b, percent)
            a, b = a[ok], b[ok]
            if depth == 0 or not len(a):
                return a, b
            n = len(self.levels[depth - 1][0])
            step = np.arange(self.fanout)
            a, b = (np.repeat(a[:, None] * self.fanout + step, self.fanout, axis=1).ravel(), np.tile(b[:, None] * self.fanout + step, (1, self.fanout)).ravel())
            ok = (a <= b) & (b < n)
            a, b = a[ok], b[ok]
        return a, b

    def link(self, labels: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
        """Links that join different labels, enough of them to connect all that links connect. Members as given."""
        labels = labels[self.order].copy()
        a, b = self.leaf_pairs(percent)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        found = []
        for leaf, i0, i1 in zip(*[x.tolist() for x in np.unique(a, return_index=True)], [*np.unique(a, return_index=True)[1][1:].tolist(), len(a)], strict=True) if len(a) else ():
            others = (b[i0:i1, None] * self.fanout + np.arange(self.fanout)).ravel()
            others = others[others < len(self.sets)]
            for i in range(leaf * self.fanout, min(len(self.sets), (leaf + 1) * self.fanout)):
                js = others[(others > i) & (labels[others] != labels[i])]
                js = js[(100 * self.sizes[i] >= percent * self.sizes[js])]
                for k in range(0, len(js), 128):
                    part = js[k : k + 128]
                    for j in self._verified(i, part[labels[part] != labels[i]], percent):
                        if labels[j] != labels[i]:
                            found.append((int(self.order[i]), int(self.order[j])))
                            labels[labels == labels[j]] = labels[i]
        return found

    def _verified(self, i: int, js: np.ndarray, percent: int) -> list[int]:
        common = np.bitwise_count(self.bits[i] & self.bits[js]).sum(axis=1).astype(np.int64)
        most = np.minimum(common + self.sizes[i] - self.ones[i], common + self.sizes[js] - self.ones[js])
        js = js[most * (100 + percent) >= percent * (self.sizes[i] + self.sizes[js])]
        if not len(js):
            return []
        own, flat = self.sets[i], np.concatenate([self.sets[j] for j in js.tolist()])
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        begin = np.cumsum(self.sizes[js]) - self.sizes[js]
        both = np.add.reduceat((own[at] == flat).astype(np.int64), begin)
        return js[both * (100 + percent) >= percent * (self.sizes[i] + self.sizes[js])].tolist()


def _links_of(keys: list[int], sets: list[bytes], labels: list[int] | None, percent: int) -> list[tuple[int, int]]:
    tree = SignatureTree([np.frombuffer(s, np.uint64) for s in sets])
    own = np.arange(len(keys)) if labels is None else np.unique(np.array(labels), return_inverse=True)[1]
    return [(keys[i], keys[j]) for i, j in tree.link(own, percent)]


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(links: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())}, schema=_EDGE)


def _near(sets: DataFrame, percent: int) -> DataFrame:
    """Links among sets of equal min-hash, for two min-hash functions, tile by tile along the sorted order."""

    def min_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.frombuffer(s, np.uint64) for s in batch.column(2).to_pylist()]
            for m in MULTIPLIERS[10:12]:
                low = np.array([mix(s * m).min() for s in packed], np.uint64).view(np.int64) if packed else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(low), batch.column(0), batch.column(2)], names=["low", "k1", "shingles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        links: list[tuple[int, int]] = []

        def close() -> None:
            if len(held) > 1:
                links.extend(_links_of([h[1] for h in held], [h[2] for h in held], None, percent))
            held.clear()

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and (held[0][0] != row[0] or len(held) >= TILE):
                    close()
                held.append(row)
        close()
        yield from _edges(links).to_batches()

    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sets.mapInArrow(min_hashes, "low long, k1 long, shingles binary")
    # Ranges over both columns: a min-hash that very many sets have is spread over partitions.
    return rows.repartitionByRange(n, "low", "k1").sortWithinPartitions("low", "k1").mapInArrow(run, "a long, b long")


def _covered(named: DataFrame, percent: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Keys of sets of which so much lies in sets of other components that they can link with one of these; marks of hashes that many sets hold."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(1).to_numpy()
            if len(n):
                table = np.stack([batch.column(0).to_numpy(), batch.column(3).to_numpy()], axis=1)
                yield _pack(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64), np.repeat(np.arange(len(n)), n), table, buckets)

    def count(table: pa.Table) -> pa.Table:
        marks, doc = _unpack(table, 2)
        order = np.argsort(marks, kind="stable")
        marks, doc = marks[order], doc[order]
        begin = np.flatnonzero(np.concatenate([[True], marks[1:] != marks[:-1]]))
        size = np.diff([*begin, len(marks)])
        mixed = np.minimum.reduceat(doc[:, 1], begin) != np.maximum.reduceat(doc[:, 1], begin)
        k, c = np.unique(doc[np.repeat(mixed, size), 0], return_counts=True)
        hot = pa.table({"target": pa.array([-1], pa.int32()), "keys": pa.array([marks[begin[mixed & (size > HOT)]].tobytes()], pa.binary()), "counts": pa.array([b""], pa.binary())})
        return pa.concat_tables([_dealt(k, c, buckets), hot])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint32).astype(np.int64))], names=["k1"])

    found = materialise(named.mapInArrow(post, _POSTED).groupBy("bucket").applyInArrow(count, _DEALT))
    counts = _summed(found.where("target >= 0"))
    covered = materialise(counts.join(named.select("k1", "n"), "k1").where(100 * F.col("c") >= percent * F.col("n")).select("k1"))
    return covered, found.where("target < 0").select("keys").mapInArrow(unpacked, "k1 long")


def _prefixes(keys: np.ndarray, n: np.ndarray, size: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The first ``size`` hashes of each set, end to end, by an order in which those marked in the bitmap ``hot`` come last."""
    place = (_places(keys, 1)[1] % np.uint32(SIEVE_BITS)).astype(np.int64)
    late = (hot[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1
    order = np.lexsort((late, np.repeat(np.arange(len(n)), n)))  # stable: else the sets' own order, which is that of the hashes
    return keys[order[_take(np.append(0, np.cumsum(n)), size)]]


def _chains(marks: np.ndarray, doc: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect, for each mark, the documents (key, n, component) that a link could join by it.

    Along rising sizes neighbours are chained while the sizes fit. If two sizes fit, so do all between, so both are in one
    chain. A chain of one component needs no edges.
    """
    order = np.lexsort((doc[:, 1], marks))
    marks, doc = marks[order], doc[order]
    begin = np.flatnonzero(np.concatenate([[True], (marks[1:] != marks[:-1]) | (100 * doc[:-1, 1] < percent * doc[1:, 1])]))
    size = np.diff([*begin, len(marks)])
    mixed = np.repeat(np.minimum.reduceat(doc[:, 2], begin) != np.maximum.reduceat(doc[:, 2], begin), size)
    edges = np.unique(np.stack([doc[mixed, 0], np.repeat(np.minimum.reduceat(doc[:, 0], begin), size)[mixed]], axis=1), axis=0)
    return edges[:, 0], edges[:, 1]


def _rest(sets: DataFrame, names: DataFrame, percent: int) -> DataFrame:
    """All further links that join different components (``names``: node, component)."""
    buckets = _buckets(sets)
    # Names are a few bytes a set. While they are few they go to the sets; beyond that Spark shuffles both.
    names = few(names, FEW)
    named = sets.join(names, sets["k1"] == names["node"], "left").select("k1", "n", "shingles", F.coalesce("component", "k1").alias("component"))
    covered, hot = _covered(named, percent, buckets)
    hot = named.sparkSession.sparkContext.broadcast(_sieve(hot).tobytes())
    named = named.join(few(covered, FEW), "k1", "left_semi")

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = np.frombuffer(hot.value, np.uint8)
        for batch in batches:
            n = batch.column(1).to_numpy()
            size = n - _least_kept(n, percent) + 1
            if len(n):
                prefix = _prefixes(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64), n, size, late)
                yield _pack(prefix, np.repeat(np.arange(len(n)), size), np.stack([batch.column(0).to_numpy(), n, batch.column(3).to_numpy()], axis=1), buckets)

    def blocks(table: pa.Table) -> pa.Table:
        a, b = _chains(*_unpack(table, 3), percent)
        return pa.table({"a": a, "b": b})

    stars = named.mapInArrow(post, _POSTED).groupBy("bucket").applyInArrow(blocks, "a long, b long").distinct()
    families = components(stars)
    sizes = materialise(families.groupBy("component").agg(F.count(F.lit(1)).alias("size")))
    members = families.join(few(sizes, FEW), "component").select(F.col("component").alias("block"), F.col("node").alias("k1"), "size")
    tiles = F.ceil(F.col("size") / TILE)
    members = members.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("k1"), F.col("tiles")))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    members = members.select("block", F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"), "k1")
    met = members.join(named.select("k1", "shingles", "component"), "k1")

    def run(table: pa.Table) -> pa.Table:
        return _edges(_links_of(table["k1"].to_pylist(), table["shingles"].to_pylist(), table["component"].to_pylist(), percent))

    return met.groupBy("block", "left", "right").applyInArrow(run, "a long, b long")


def _labelled(docs: DataFrame, doc_id: str, text: str, percent: int) -> DataFrame:
    """doc_id, class (k1, k2, n), node (a number for its component, null without shingles) and the component's smallest id, for each row."""
    texts = docs.select(as_bytes(F.col(text)).alias("text"))
    own = docs.select(F.col(doc_id).alias("doc_id"), arrow_udf(_class_of, "n long, k1 long, k2 long")(as_bytes(F.col(text))).alias("c")).select("doc_id", "c.*")
    own = materialise(own)
    classes = own.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("least"))
    sets = _sets(texts, _survivors(texts, own.where("n > 0").select("k1", "n"), percent))
    first = materialise(_near(sets, percent))
    second = materialise(_rest(sets, components(first), percent))
    names = components(first.union(second))
    discard(sets, first, second)
    classes = classes.join(names, classes["k1"] == names["node"], "left").select("k1", "k2", "n", "least", "component")
    classes = materialise(classes)
    linked = classes.where("component IS NOT NULL")
    lowest = linked.groupBy("component").agg(F.min("least").alias("lowest"))
    reached = linked.join(lowest, "component").select("k1", "k2", "n", F.col("component").alias("node"), F.col("lowest").alias("least"))
    alone = classes.where("component IS NULL").select("k1", "k2", "n", F.col("k1").alias("node"), "least")
    return own.join(materialise(reached.union(alone)), ["k1", "k2", "n"], "left").select("doc_id", "k1", "k2", "n", "node", "least")


def link_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links reach) for each row of ``docs``."""
    return _labelled(docs, doc_id, text, percent).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row of each component of ``docs``, with its own columns: that of the smallest id, null ids last, whatever ids repeat.

    Rows without words are linked with nothing, so all of them stay.
    """
    rows = materialise(_labelled(docs, doc_id, text, percent))
    linked = rows.where("n > 0").withColumn("key", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2", "n"))
    chosen = materialise(linked.groupBy("node").agg(F.min("key").alias("chosen")))  # written, so that Spark can split the join where a component is large
    g_id, g1, g2, gn = (fresh(docs, x) for x in ("g_id", "g1", "g2", "gn"))
    gone = linked.join(chosen, "node").where("key <> chosen").select(F.col("doc_id").alias(g_id), F.col("k1").alias(g1), F.col("k2").alias(g2), F.col("n").alias(gn)).distinct()
    gone = few(materialise(gone), FEW)
    if rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").isEmpty():
        return docs.join(gone, docs[doc_id].eqNullSafe(gone[g_id]), "left_anti")
    # Ids repeat, so an id doesn't name a row: its class is needed too, and of rows equal in both one stays.
    c, twin = fresh(docs, "_class"), fresh(docs, "_twin")
    tagged = docs.withColumn(c, arrow_udf(_class_of, "n long, k1 long, k2 long")(as_bytes(F.col(text))))
    tagged = tagged.withColumn(twin, F.when(F.col(f"{c}.n") == 0, F.monotonically_increasing_id()))
    same = F.col(doc_id).eqNullSafe(F.col(g_id)) & (F.col(f"{c}.k1") == F.col(g1)) & (F.col(f"{c}.k2") == F.col(g2)) & (F.col(f"{c}.n") == F.col(gn))
    return tagged.join(gone, same, "left_anti").dropDuplicates([doc_id, c, twin]).drop(c, twin)


ORACLE_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, seen) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.least, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node, min(seen) AS least FROM r GROUP BY node) m ON m.node = w.doc_id
"""
