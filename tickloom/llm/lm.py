"""Language-model scores from a log-frequency Bloom filter.

An n-gram that occurs c times is put into the filter once for each level up to 1 + log2(c), together with the
level's number. Reading probes level after level until one is missing; the last one found gives the count
back within a factor of two. The filter takes ``ENTRY_BITS`` bits for each entry counted, and ``FILTER_BITS`` at
most, as it is broadcast; it holds word pairs and single words.

Counts cover every training token: tasks count hashes of words and of pairs of words, and Spark adds the counts up,
a row for each n-gram, so no task holds more than it can spill. Every word and pair is in the model, those seen once
too. Where all entries don't fit the filter, it holds those of level ``least`` or above, and the levels below stay in
a table: each step of texts asks the table for the n-grams that the filter doesn't know, once each, and is scored when
the answers are back. Both ways give the same counts, but for the filter's errors.

Probability of a word after another: LAMBDA times the pair's share of the first word's count, plus the rest
times the word's own smoothed share; both from probed counts.

The base score needs exact counts. Counts of the ``HOT`` most frequent words (bounded) are sent to the tasks;
words beyond them are joined by Spark. A word is known by a 64-bit hash of its bytes.

Defined results: a null text counts as empty and has one token, its end; with no training text all counts are
0; very long texts are read whole; repeated rows and equal ids are scored each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import MULTIPLIERS, Words, as_bytes, fold, give_back, materialise, mix, word_steps

#: Most and fewest bits of the filter, and bits for each entry in between (three in ten are set, three in a hundred probes err).
FILTER_BITS, FEWEST_BITS, ENTRY_BITS = 1 << 29, 1 << 22, 8
#: The filter is built in so many segments; all probes of an n-gram fall into one.
SEGMENTS = 256
PROBES = 3
#: Most words whose exact counts are sent to the tasks.
HOT = 400_000
LAMBDA = 0.4
LEVELS = 40
#: Hash of the end of a text as a token.
END = int(mix(np.array([0xE0D], np.uint64))[0])
#: Counts that a task gathers before it hands them on.
GATHER = 1 << 21


def tokens_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens (each text's words, then its end) and where each text begins."""
    n = len(words.first) - 1
    first = words.first + np.arange(n + 1)
    out = np.full(int(first[-1]), END, np.uint64)
    inside = np.ones(len(out), dtype=bool)
    inside[first[1:] - 1] = False
    out[inside] = words.hashes
    return out, first


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(mix(left * MULTIPLIERS[12]) + right * MULTIPLIERS[13])


def pairs_of(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; the first of a text follows an END."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    if len(tokens):
        before[first[:-1]] = END
    return pair_hash(before, tokens)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2(count))."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def _counted(training: DataFrame, keys_of: Callable[[Words], np.ndarray], name: str) -> DataFrame:
    """(name, c): how often each key occurs. A task merges what it gathers before it hands it on; Spark adds up the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=[name, "c"])

        for batch in batches:
            for _, _, words in word_steps(batch.column(0)):
                held.append(keys_of(words))
                if sum(map(len, held)) > GATHER:
                    yield out()
        yield out()
        give_back()

    return training.mapInArrow(run, f"{name} long, c long").groupBy(name).agg(F.sum("c").alias("c"))


def word_counts(training: DataFrame) -> DataFrame:
    """(word, c): hash and exact count of every token."""
    return _counted(training, lambda words: tokens_of(words)[0], "word")


def pair_counts(training: DataFrame) -> DataFrame:
    """(key, c): filter key and count of every pair of tokens."""
    return _counted(training, lambda words: filter_keys(pairs_of(*tokens_of(words))), "key")


def filter_keys(hashes: np.ndarray) -> np.ndarray:
    """What the filter knows an n-gram by: 48 bits, of which the top 8 name the segment."""
    return hashes >> np.uint64(16)


def spread(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each key, from which all its probes come."""
    return mix(keys), mix(keys + MULTIPLIERS[14]) | np.uint64(1)


def probe_places(base: np.ndarray, stride: np.ndarray, level: int, probe: int, segment: int) -> np.ndarray:
    """Bit of a probe inside the key's segment of so many bits (fewer than 2^32): double hashing."""
    at = base + stride * np.uint64(PROBES * level + probe)
    return (((at >> np.uint64(32)) * np.uint64(segment)) >> np.uint64(32)).astype(np.int64)


class BloomCounts:
    def __init__(self, bits: np.ndarray, least: int = 1) -> None:
        self.bits, self.least = bits, least  # packed, segment after segment

    def level(self, keys: np.ndarray) -> np.ndarray:
        """Highest level below the first that is missing; 0 for an n-gram that isn't in the filter."""
        out, at = np.zeros(len(keys), np.int64), np.arange(len(keys))
        segment = 8 * len(self.bits) // SEGMENTS
        first = (keys >> np.uint64(40)).astype(np.int64) * segment
        base, stride = spread(keys)
        for level in range(self.least, LEVELS):
            for probe in range(PROBES):
                place = first + probe_places(base, stride, level, probe, segment)
                hit = ((self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)
                at, first, base, stride = at[hit], first[hit], base[hit], stride[hit]
            if not len(at):
                break
            out[at] = level
        return out


def count_of(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level: 1, 2.5, 6, 12 ..."""
    return np.where(level > 0, np.where(level == 1, 1.0, 1.5 * 2.0 ** (level - 1.0) - 0.5), 0.0)


def leveled(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, level): all n-grams of the model by their filter keys."""
    both = words.select(F.shiftrightunsigned("word", 16).alias("key"), "c").unionByName(pairs)
    return both.select("key", F.length(F.bin("c")).cast("byte").alias("level"))


def build_filter(grams: DataFrame) -> tuple[np.ndarray, int]:
    """The filter's bits and the least level in it. Segments are built on the workers, from at most FILTER_BITS / ENTRY_BITS entries in all."""
    by_level = np.zeros(LEVELS + 1, np.int64)
    for r in grams.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect():
        by_level[r["level"]] = r["n"]
    # entries[lv]: an n-gram of level l >= lv takes l - lv + 1
    entries = np.cumsum(np.cumsum(by_level[::-1]))[::-1]
    least = next((lv for lv in range(1, LEVELS) if entries[lv] * ENTRY_BITS <= FILTER_BITS), LEVELS - 1)
    segment = 8 * -(-max(FEWEST_BITS, int(entries[least]) * ENTRY_BITS) // (8 * SEGMENTS))

    def build(table: pa.Table) -> pa.Table:
        bits = np.zeros(segment, np.uint8)
        keys, levels = table["key"].to_numpy().view(np.uint64), table["level"].to_numpy().astype(np.int64)
        base, stride = spread(keys)
        for lv in range(least, LEVELS):
            more = levels >= lv
            base, stride, levels = base[more], stride[more], levels[more]
            if not len(base):
                break
            for probe in range(PROBES):
                bits[probe_places(base, stride, lv, probe, segment)] = 1
        return pa.table({"bucket": pa.array([table["bucket"][0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    inside = grams.where(F.col("level") >= least).select(F.shiftright("key", 40).cast("int").alias("bucket"), "key", "level")
    out = np.zeros((SEGMENTS, segment // 8), np.uint8)
    for batch in inside.groupBy("bucket").applyInArrow(build, "bucket int, bits binary").toArrow().to_batches():
        for bucket, bits in zip(batch.column(0), batch.column(1), strict=True):
            out[bucket.as_py()] = np.frombuffer(bits.as_buffer(), np.uint8)
    return out.reshape(-1), int(least)


def scored(docs: DataFrame, training: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``, from the texts of ``training``."""
    spark = docs.sparkSession
    texts = training.select(as_bytes(F.col(text)).alias("text"))
    words = materialise(word_counts(texts))
    sums = words.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train, n_types = int(sums["n"] or 0), int(sums["v"])
    grams = materialise(leveled(words, pair_counts(texts)))
    bits, least = build_filter(grams)
    hot = words.orderBy(F.desc("c"), "word").limit(HOT)
    hot = materialise(hot)
    table = hot.toArrow()
    hot_keys = table["word"].to_numpy().view(np.uint64)
    order = np.argsort(hot_keys)
    shared = spark.sparkContext.broadcast((bits.tobytes(), hot_keys[order].tobytes(), table["c"].to_numpy()[order].tobytes()))
    total = n_train + n_types + 1

    def model() -> tuple[BloomCounts, np.ndarray, np.ndarray]:
        raw_bits, raw_keys, raw_counts = shared.value
        return BloomCounts(np.frombuffer(raw_bits, np.uint8), least), np.frombuffer(raw_keys, np.uint64), np.frombuffer(raw_counts, np.int64)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bloom, keys, counts = model()
        for column in columns:
            parts = [_score(words, bloom.level, keys, counts, total) for _, _, words in word_steps(column)]
            yield pa.concat_arrays(parts) if parts else _score_type([])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        bloom, keys, counts = model()
        order = np.argsort(right["key"].to_numpy())
        known, levels = right["key"].to_numpy()[order].view(np.uint64), right["level"].to_numpy()[order]

        def level(x: np.ndarray) -> np.ndarray:
            out = bloom.level(x)
            if len(known):
                miss = np.flatnonzero(out == 0)
                at = np.minimum(np.searchsorted(known, x[miss]), len(known) - 1)
                out[miss] = np.where(known[at] == x[miss], levels[at], 0)
            return out

        ids, numbers, texts = (left[c].combine_chunks().flatten() for c in ("ids", "rows", "texts"))
        parts = [_score(words, level, keys, counts, total) for _, _, words in word_steps(texts)]
        scores = pa.concat_arrays(parts) if parts else _score_type([])
        return pa.Table.from_arrays([ids, numbers, *scores.flatten()], names=["doc_id", "row", *_NAMES])

    numbered = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), as_bytes(F.col(text)).alias("text"))
    if least == 1:
        rows = materialise(numbered.select("doc_id", "row", arrow_udf(run, _SCORE)("text").alias("s")).select("doc_id", "row", "s.*"))
    else:
        id_type = numbered.schema["doc_id"].dataType.simpleString()
        asked = materialise(_asks(numbered, id_type, lambda: model()[0]))
        wanted = asked.where("keys IS NOT NULL").select("step", F.explode("keys").alias("key"))
        answers = wanted.join(grams.where(F.col("level") < least), "key").select(F.col("step").alias("of"), "key", "level")
        held = asked.where("keys IS NULL").select("step", "ids", "rows", "texts")
        rows = materialise(held.groupBy("step").cogroup(answers.groupBy("of")).applyInArrow(finish, f"doc_id {id_type}, row long, {_SCORE}"))
    cold = rows.select("row", F.explode(F.arrays_zip("cold", "cold_n")).alias("w")).select("row", F.col("w.cold").alias("word"), F.col("w.cold_n").alias("times"))
    rest = words.join(hot.select("word"), "word", "left_anti")
    found = cold.join(rest, "word").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("times").alias("more_known"))
    joined = rows.join(found, "row", "left")
    base = F.col("hot_log") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(total)))
    return joined.select("doc_id", "n_tokens", (F.col("hot_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


_SCORE = "n_tokens long, hot_known long, hot_log double, score double, cold array<long>, cold_n array<long>"
_NAMES = ["n_tokens", "hot_known", "hot_log", "score", "cold", "cold_n"]


def _score_type(_: list) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()))], _NAMES)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    # Every text has its end token, so no run is empty.
    return np.add.reduceat(values, first[:-1])


def _asks(numbered: DataFrame, id_type: str, bloom_of: Callable[[], BloomCounts]) -> DataFrame:
    """(step, keys, ids, rows, texts): for each step a row with its texts, and one with the n-grams that the filter doesn't know."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, step = bloom_of(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for row, end, words in word_steps(batch.column(2)):
                tokens, first = tokens_of(words)
                need = np.unique(filter_keys(np.concatenate([tokens, pairs_of(tokens, first)])))
                need = need[bloom.level(need) == 0]
                own = [pa.ListArray.from_arrays(pa.array([0, end - row], pa.int32()), batch.column(i).slice(row, end - row)) for i in range(3)]
                ask = pa.ListArray.from_arrays(pa.array([0, len(need)], pa.int32()), pa.array(need.view(np.int64)))
                names, at = ["step", "keys", "ids", "rows", "texts"], pa.array([step], pa.int64())
                yield pa.RecordBatch.from_arrays([at, pa.nulls(1, ask.type), *own], names=names)
                yield pa.RecordBatch.from_arrays([at, ask, *(pa.nulls(1, x.type) for x in own)], names=names)
                step += 1

    return numbered.mapInArrow(run, f"step long, keys array<long>, ids array<{id_type}>, rows array<long>, texts array<binary>")


def _score(words: Words, level: Callable[[np.ndarray], np.ndarray], keys: np.ndarray, counts: np.ndarray, total: int) -> pa.Array:
    tokens, first = tokens_of(words)
    types, which = np.unique(tokens, return_inverse=True)
    at = np.minimum(np.searchsorted(keys, types), max(0, len(keys) - 1))
    is_hot = keys[at] == types if len(keys) else np.zeros(len(types), dtype=bool)
    exact = np.where(is_hot, counts[at] if len(keys) else 0, 0)
    # the model
    own = count_of(level(filter_keys(types)))
    single = (own + 1) / total
    pair = pairs_of(tokens, first)
    before = np.empty_like(which)
    before[1:] = which[:-1]
    end = np.searchsorted(types, np.uint64(END))
    before[first[:-1]] = end
    context = own[before]
    both = np.zeros(len(tokens))
    maybe = np.flatnonzero((context > 0) & (own[which] > 0))
    both[maybe] = count_of(level(filter_keys(pair[maybe])))
    share = np.minimum(1.0, both / np.maximum(1.0, context))
    log_p = np.log10(LAMBDA * share + (1 - LAMBDA) * single[which])
    # what is left for the join: words that aren't hot, once for each text
    cold = np.flatnonzero(~is_hot[which])
    doc = np.searchsorted(first, cold, side="right") - 1
    order = np.lexsort((which[cold], doc))
    doc, kind = doc[order], which[cold][order]
    begin = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (kind[1:] != kind[:-1])])) if len(doc) else np.empty(0, np.int64)
    times = np.diff([*begin, len(doc)]) if len(begin) else np.empty(0, np.int64)
    starts = np.searchsorted(doc[begin], np.arange(len(first)))
    offsets = pa.array(starts.astype(np.int32))
    return pa.StructArray.from_arrays(
        [
            pa.array(np.diff(first)), pa.array(_sums(is_hot[which].astype(np.int64), first)), pa.array(_sums(np.log10(exact + 1.0)[which], first)), pa.array(_sums(log_p, first)),
            pa.ListArray.from_arrays(offsets, pa.array(types[kind[begin]].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64))),
        ],
        _NAMES,
    )


def held_out_scores(docs: DataFrame) -> DataFrame:
    """Scores of all rows; rows of one of seven folds are never learned from."""
    out_of = fold(F.col("doc_id"), 7) == 2
    found = scored(docs.select("doc_id", "text"), docs.where(~out_of).select("text"))
    return found.select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
