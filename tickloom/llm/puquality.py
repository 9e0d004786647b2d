"""Quality of texts by positive-unlabelled learning.

Trusted positives are rows labelled 1; labels of 0 are never read. All other texts are unlabelled: a mix of good and
bad ones in an unknown ratio. Learning takes three steps.

1. A text is described by shares of kinds of characters, lengths of words and repetition (``NAMES``), over all of it.
   Each feature is cut at quantiles of the unlabelled sample, finer at both ends, and has a weight in each interval.
2. The class prior, the share of good texts, is estimated from a first classifier of positives against unlabelled: of
   all thresholds the one where the share of unlabelled texts above it, relative to that of positives, is least, with a
   margin for the sampling error of both. The unlabelled side is counted over every row, the positive side over
   positives that the first classifier hasn't seen.
3. The weights minimise the non-negative unbiased risk with the logistic loss: prior * R_p+ + max(0, R_u- - prior *
   R_p-). Where the second term falls below zero, the step goes against it, as otherwise bad texts would be fitted to
   be rarer than none. The score is the logistic of the sum of weights: the probability of a good text.

The fit is bounded: at most ``FIT_DOCS`` positives and as many unlabelled rows, those of smallest hash. Features are
computed once for every row, with one pass over the texts, and written; the sample, the prior and the scores read them.

Defined results: null and empty texts are scored like any text, by the features of a text without words; very long
texts are read whole; of labels that disagree on an id none is trusted; a null id has no label; repeated rows are scored
each; without positives or without unlabelled rows every score is 0.5; equal hashes order by id; an empty table gives an
empty one; other columns aren't read, and ``with_quality`` passes them on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import STEP_BYTES, as_bytes, discard, fold, give_back, materialise, steps, words_of

#: Positives that a fit takes at most, and unlabelled rows.
FIT_DOCS = 20_000
THRESHOLD = 0.3
#: Where features are cut, as shares of the unlabelled sample.
CUTS = (0.005, 0.01, 0.02, 0.04, 0.07, 0.11, 0.2, 0.35, 0.5, 0.65, 0.8, 0.89, 0.93, 0.96, 0.98, 0.99, 0.995)
#: Intervals in which first scores are counted, over -REACH to REACH.
INTERVALS, REACH = 2000, 20.0
ROUNDS, RATE, PULL = 800, 0.1, 1e-5
WINDOW = 5

_KINDS = {"blank": b" \t\v\f\r", "newline": b"\n", "lower": bytes(range(97, 123)), "upper": bytes(range(65, 91)), "digit": bytes(range(48, 58)), "mark": b".,;:?'\"()-", "shout": b"!", "bar": b"|", "symbol": b"#*$%&", "wide": bytes(range(128, 256))}
_CLASS = np.full(256, len(_KINDS), np.int64)
for _i, _bytes in enumerate(_KINDS.values()):
    _CLASS[list(_bytes)] = _i
_CLASSES = len(_KINDS) + 1
NAMES = (*(f"{k}_share" for k in _KINDS), "other_share", "upper_of_letters", "marks_a_word", "log_bytes", "log_words", "word_bytes", "short_words", "long_words", "distinct_words", "top_word", "word_collisions", "repeated_windows", "equal_neighbours", "words_a_line")


def _runs(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the equal values inside each text: the text and how many they are."""
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (v[1:] != v[:-1])])) if len(d) else np.empty(0, np.int64)
    return d[first], np.diff(np.append(first, len(d)))


def describe(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Features of texts laid end to end, a row each."""
    n, size = len(offsets) - 1, np.diff(offsets)
    kinds = np.zeros(n * _CLASSES)
    for at in range(0, len(data), STEP_BYTES):  # a very long text in pieces, so that the counts' memory stays small
        doc = np.repeat(np.arange(n), np.diff(np.clip(offsets, at, at + STEP_BYTES)))
        kinds += np.bincount(doc * _CLASSES + _CLASS[data[at : at + STEP_BYTES]], minlength=n * _CLASSES)
    kinds = kinds.reshape(n, _CLASSES)
    w = words_of(data, offsets)
    words = np.diff(w.first).astype(np.float64)
    some, bytes_ = np.maximum(words, 1), np.maximum(size, 1)

    def per_text(doc: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(doc, weights, minlength=n)

    doc, held = _runs(w.doc, w.hashes)
    top = np.zeros(n)
    np.maximum.at(top, doc, held)
    hashes, at = w.windows(WINDOW)
    window_doc, window_held = _runs(w.doc[at], hashes)
    windows = np.maximum(per_text(w.doc[at]), 1)
    names = dict(zip(_KINDS, kinds.T, strict=False))
    columns = [
        *(kinds / bytes_[:, None]).T,
        names["upper"] / np.maximum(names["upper"] + names["lower"] + names["wide"], 1),
        (names["mark"] + names["shout"]) / some,
        np.log1p(size),
        np.log1p(words),
        per_text(w.doc, w.lengths) / some,
        per_text(w.doc[w.lengths <= 3]) / some,
        per_text(w.doc[w.lengths > 15]) / some,
        per_text(doc) / some,
        top / some,
        per_text(doc, held * (held - 1.0)) / np.maximum(words * (words - 1), 1),
        1 - per_text(window_doc) / windows,
        per_text(w.doc[1:][(w.doc[1:] == w.doc[:-1]) & (w.hashes[1:] == w.hashes[:-1])]) / some,
        words / (names["newline"] + 1),
    ]
    return np.stack(columns, axis=1).astype(np.float32)


def _described(column: pa.Array) -> np.ndarray:
    out = [describe(data, offsets) for _, _, data, offsets in steps(column)]
    give_back()
    return np.concatenate(out) if out else np.zeros((0, len(NAMES)), np.float32)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(NAMES))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, f) for every row."""
    found = arrow_udf(lambda column: _lists(_described(column)), "array<float>")(as_bytes(F.col(text)))
    return docs.select("doc_id", found.alias("f"))


@dataclass
class Model:
    """Cuts of each feature, and a weight for each interval of each feature."""

    cuts: list[np.ndarray] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    prior: float = 0.5

    def __post_init__(self) -> None:
        self.starts = np.cumsum([0, *[len(c) + 1 for c in self.cuts]])

    def codes(self, rows: np.ndarray) -> np.ndarray:
        """The interval of each value, numbered over all features."""
        if not self.cuts:
            return np.zeros((len(rows), 0), np.int64)
        return np.stack([np.searchsorted(cuts, rows[:, i], side="left") + self.starts[i] for i, cuts in enumerate(self.cuts)], axis=1)

    def sums(self, rows: np.ndarray) -> np.ndarray:
        return self.weights[self.codes(rows)].sum(axis=1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return _logistic(self.sums(rows)) if len(self.weights) else np.full(len(rows), 0.5)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def risk_gradient(f_p: np.ndarray, f_u: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Non-negative risk by the logistic loss, and the direction to step against, for the sums of positives and unlabelled."""
    n_p, n_u = len(f_p), len(f_u)
    r_p = np.logaddexp(0, -f_p).mean() * prior
    r_n = np.logaddexp(0, f_u).mean() - prior * np.logaddexp(0, f_p).mean()
    g_p, g_u = -prior * _logistic(f_p) / n_p, _logistic(f_u) / n_u
    if r_n < 0:  # overfitted: step back until it is as good as zero
        return float(r_p), -g_p, -g_u
    return float(r_p + r_n), g_p - prior * _logistic(-f_p) / n_p, g_u


def descend(model: Model, p: np.ndarray, u: np.ndarray, gradient) -> np.ndarray:
    """Adam over all rows of the sample, always the same steps."""
    n, w = int(model.starts[-1]), np.zeros(int(model.starts[-1]))
    m, v = np.zeros(n), np.zeros(n)
    flat_p, flat_u, wide = p.ravel(), u.ravel(), p.shape[1]
    for t in range(1, ROUNDS + 1):
        g_p, g_u = gradient(w[p].sum(axis=1), w[u].sum(axis=1))
        g = np.bincount(flat_p, np.repeat(g_p, wide), n) + np.bincount(flat_u, np.repeat(g_u, wide), n) + PULL * w / wide
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - RATE * (1 - t / (ROUNDS + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """At most so many rows, of smallest hash of the id. About twice as many pass before they are ordered."""
    n = rows.count()
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    return rows.where(h < int(min(1.0, 2.0 * most / max(n, 1)) * (1 << 40)) + 1).orderBy(h, "doc_id").limit(most)


def _interval(sums: np.ndarray) -> np.ndarray:
    return np.clip(((sums + REACH) * (INTERVALS / (2 * REACH))).astype(np.int64), 0, INTERVALS - 1)


def _counts(described: DataFrame, model: Model) -> np.ndarray:
    """Of all rows, how many have a first score in each interval."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(INTERVALS, np.int64)
        for batch in batches:
            if batch.num_rows:
                held += np.bincount(_interval(model.sums(_matrix(batch["f"]))), minlength=INTERVALS)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at])], names=["k", "n"])

    out = np.zeros(INTERVALS, np.int64)
    for r in described.select("f").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r["k"]] = r["n"]
    return out


def class_prior(unlabelled: np.ndarray, positives: np.ndarray) -> float:
    """Share of positives among unlabelled, from the counts of both in intervals of rising score."""
    n_u, n_p = unlabelled.sum(), positives.sum()
    above_u, above_p = np.cumsum(unlabelled[::-1]) / n_u, np.cumsum(positives[::-1]) / n_p
    some = above_p > 0
    above_u, above_p = above_u[some], above_p[some]
    error = np.sqrt(np.log(40) / (2 * n_u)) + np.sqrt(np.log(40) / (2 * n_p))
    best = int(np.argmin((above_u + error) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def fit(described: DataFrame, labels: DataFrame, trusted=None) -> Model:
    """``described``: (doc_id, f) of every row; ``labels``: (doc_id, quality). ``trusted`` says of which ids labels may be read, and which rows are learned from."""
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IS NOT NULL")
    open_rows = described.where("doc_id IS NOT NULL")
    if trusted is not None:
        known, open_rows = known.where(trusted), open_rows.where(trusted)
    # Bounded by FIT_DOCS, so the ids are sent to the features.
    chosen = materialise(_sample(known.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id"), FIT_DOCS))
    p = open_rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("f").alias("f")).orderBy("doc_id").select("f").toArrow()["f"].combine_chunks()
    u = _sample(open_rows, FIT_DOCS).select("f").toArrow()["f"].combine_chunks()
    discard(chosen)
    p, u = _matrix(p), _matrix(u)
    if len(p) < 2 or not len(u):
        return Model()
    return learn(p, u, lambda model: _counts(open_rows, model))


def learn(p: np.ndarray, u: np.ndarray, counts) -> Model:
    """From features of positives and unlabelled; ``counts`` gives the first classifier's counts over all rows."""
    model = Model([np.unique(np.quantile(u[:, i], CUTS, method="lower")) for i in range(u.shape[1])])
    codes_p, codes_u = model.codes(p), model.codes(u)

    def apart(f_p: np.ndarray, f_u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return -_logistic(-f_p) / len(f_p), _logistic(f_u) / len(f_u)

    first = Model(model.cuts, descend(model, codes_p[::2], codes_u, apart))
    unseen = np.bincount(_interval(first.sums(p[1::2])), minlength=INTERVALS)
    model.prior = class_prior(counts(first), unseen)
    model.weights = descend(model, codes_p, codes_u, lambda f_p, f_u: risk_gradient(f_p, f_u, model.prior)[1:])
    return model


def with_quality(docs: DataFrame, model: Model, text: str = "text", into: str = "quality_score") -> DataFrame:
    """``docs`` with a score between 0 and 1."""
    score = arrow_udf(lambda column: pa.array(model.score(_described(column))), "double")
    return docs.withColumn(into, score(as_bytes(F.col(text))))


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; labels and texts of held-out rows are never learned from."""
    described = materialise(features(docs))
    model = fit(described, labels, fold(F.col("doc_id"), 5) != 0)
    score = arrow_udf(lambda column: pa.array(model.score(_matrix(column))), "double")
    scored = described.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), score(F.col("f")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
