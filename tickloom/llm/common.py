"""Helpers that the text operators share: scratch tables, folds and vectorised words."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20
#: Bytes of words that are hashed at once.
HASH_BYTES = 1 << 17


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it. Only a session on one machine may go without: it gets a fresh local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Whether Spark deletes a query's shuffle files when the query ends, and not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives lost executors.

    Nothing reads the shuffle files of a table that is written, so they go at once; the session's own setting stays.
    """
    path = f"{scratch_dir(df.sparkSession)}/scratch-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


#: Where the tables of ``materialise`` lie.
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def discard(*written: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing reads any more, as all that was made of them is written itself."""
    for df in written:
        if (path := _WRITTEN.pop(df, None)) is not None:
            session = df.sparkSession._jsparkSession
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(session.sessionState().newHadoopConf()).delete(where, True)


def few(df: DataFrame, rows: int) -> DataFrame:
    """A written table, marked for broadcast if it has at most so many rows; beyond that Spark shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def as_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


_rng = np.random.Generator(np.random.PCG64(20240611))
_ODD = np.uint64(1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BYTE_CASED = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[SPACE] = 0
_BYTE_CASED[SPACE] = 0
_POWER = np.cumprod(np.full(1 << 12, (int(_rng.integers(1, 1 << 62)) << 1) | 1, dtype=np.uint64))
_FAR = np.uint64((int(_rng.integers(1, 1 << 62)) << 1) | 1)
MULTIPLIERS = (_rng.integers(1, 1 << 62, 16, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of a run of texts, flat and in order. ``first[d]:first[d + 1]`` are those of text d."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of ``size`` words inside one text, and the place of its first word."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        total = np.zeros(len(at), np.uint64)
        for i in range(size):
            total += mix(self.hashes[at + i] * MULTIPLIERS[i])
        return mix(total), at


def words_of(data: np.ndarray, offsets: np.ndarray, fold_case: bool = True) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts laid end to end; each is known by a 64-bit hash of its bytes."""
    solid = ~SPACE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    begin[edges] = solid[edges]
    starts = np.flatnonzero(begin)
    stop = solid.copy()
    stop[:-1] &= ~solid[1:]
    edges = edges[edges > 0]
    stop[edges - 1] = solid[edges - 1]
    lengths = np.flatnonzero(stop) + 1 - starts
    doc = np.searchsorted(offsets, starts, side="right") - 1
    first = np.searchsorted(starts, offsets)
    hashes = np.empty(len(starts), np.uint64)
    table, letters = _BYTE if fold_case else _BYTE_CASED, data[solid]
    stops = np.cumsum(lengths)
    at = 0
    while at < len(starts):  # some thousand words at a time, so that the arrays stay small
        begin_byte = int(stops[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(stops, begin_byte + HASH_BYTES, side="right")))
        own = lengths[at:end]
        place = np.arange(int(own.sum()), dtype=np.int64) - np.repeat(np.cumsum(own) - own, own)
        value = table[letters[begin_byte : int(stops[end - 1])]] * _POWER[place & 4095]
        far = np.flatnonzero(place > 4095)  # only there, so that a word's hash doesn't depend on its neighbours
        value[far] = mix(value[far] + (place[far] >> 12).astype(np.uint64) * _FAR)
        hashes[at:end] = mix(np.add.reduceat(value, np.cumsum(own) - own) + own.astype(np.uint64))
        at = end
    return Words(data, offsets, starts, lengths, doc, first, hashes)


@cache
def _trim():
    """glibc's malloc_trim, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return None


def give_back() -> None:
    """Return memory that Arrow and the allocator hold in reserve: Python workers live on after a batch and serve other stages."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of a binary column of about ``limit`` bytes: (first row, end row, bytes, offsets from 0)."""
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end, whole[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_steps(column: pa.Array, fold_case: bool = True, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, Words]]:
    for row, end, data, offsets in steps(column, limit):
        yield row, end, words_of(data, offsets, fold_case)
    give_back()
