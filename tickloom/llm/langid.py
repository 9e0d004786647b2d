"""Language identification, word first.

A known word is scored by its log frequency in each language. An unseen word falls back to the longest
character n-grams that are known in it, shorter and shorter. Scores of the words are added up, and the
posterior over the languages gives prediction and score.

The model is fitted on a bounded sample: at most ``FIT_DOCS`` training texts a language, of smallest hash. It knows
every word and n-gram that the sample holds ``LEAST`` times or more; rarer words are unseen words, which n-grams judge.
So its size follows from the sample, and it travels with the tasks. All languages are learned; a table of more than
``LANGUAGES`` is an error, and never a reason to leave some out. Spark counts; prediction covers every row.

Defined results: ``und`` with score 0 where the text is null or has no letter, or where nothing was learned; equal scores
go to the smaller name; very long texts are read whole; repeated rows are predicted each; an empty table gives an empty
one; columns besides id, text and (for learning) language are not read, and ``with_language`` passes all of them on.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import fold, give_back, materialise

FIT_DOCS, LANGUAGES = 3000, 1000
LEAST = 3
SIZES = (4, 3, 2, 1)
#: Words that count in full towards the posterior; evidence beyond grows no more certain.
CERTAIN = 20
REMEMBERED = 200_000
#: Words that a task gathers before it hands their counts on.
GATHER = 60_000
WORD = regex.compile(r"\p{L}+")


def _grams(word: str, size: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + size] for i in range(len(padded) - size + 1)]


def training_sample(docs: DataFrame, where) -> DataFrame:
    """(text, lang) of the sample. First ids alone are ranked, then the few chosen are sent to the texts."""
    rows = docs.where(where).where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "lang")
    top = materialise(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    if top.count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    # A hash that only about twice the wanted rows of a language pass, so that no language is ranked whole.
    passes = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40) < 2.0 * FIT_DOCS / F.col("n")
    order = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "doc_id")
    chosen = rows.join(F.broadcast(top), "lang").where(passes).withColumn("k", F.row_number().over(order)).where(F.col("k") <= FIT_DOCS)
    chosen = materialise(chosen.select("doc_id", "lang").distinct())
    return materialise(docs.where("text IS NOT NULL").select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text"))


class Model:
    """Log frequencies over the languages. Grams lie end to end by kind (0 for words, else the n-gram's size), a row of the matrix each."""

    def __init__(self, languages: list[str], grams: dict[int, list[str]], counts: dict[int, np.ndarray], totals: dict[tuple[str, int], int]) -> None:
        self.languages = languages
        self.place: dict[int, dict[str, int]] = {}
        self.logs: dict[int, np.ndarray] = {}
        for kind in (0, *SIZES):
            names = grams.get(kind, [])
            total = np.array([totals.get((lang, kind), 0) for lang in languages], float)
            table = counts.get(kind, np.zeros((0, len(languages))))
            self.place[kind] = dict(zip(names, range(len(names)), strict=True))
            self.logs[kind] = (np.log(table + 0.5) - np.log(total + len(names) + 1)).astype(np.float32)
        self.forget()

    @staticmethod
    def of_rows(languages: list[str], rows: list[tuple[str, int, str, int]], totals: dict[tuple[str, int], int]) -> Model:
        """From rows (language, kind, gram, count)."""
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        return Model.of_table(languages, pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["lang", "kind", "gram", "n"]), totals)

    @staticmethod
    def of_table(languages: list[str], rows: pa.Table, totals: dict[tuple[str, int], int]) -> Model:
        grams, counts, at = {}, {}, {lang: i for i, lang in enumerate(languages)}
        for kind in (0, *SIZES):
            own = rows.filter(pc.equal(rows["kind"], kind))
            coded = pc.dictionary_encode(own["gram"].combine_chunks())
            grams[kind] = coded.dictionary.to_pylist()
            counts[kind] = np.zeros((len(grams[kind]), len(languages)), np.float32)
            column = [at[x] for x in own["lang"].to_pylist()]
            counts[kind][coded.indices.to_numpy(), column] = own["n"].to_numpy()
        return Model(languages, grams, counts, totals)

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.matrix = np.zeros((0, len(self.languages)), np.float32)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "matrix": np.zeros((0, len(self.languages)), np.float32)}

    def vector(self, word: str) -> np.ndarray:
        found = self.place[0].get(word)
        if found is not None:
            return self.logs[0][found]
        for size in SIZES:
            table = self.place[size]
            hits = [table[g] for g in _grams(word, size) if g in table]
            if hits:
                return self.logs[size][hits].mean(axis=0)
        return np.zeros(len(self.languages), np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        words = WORD.findall(text.lower()) if text else []
        if not words or not self.languages:
            return "und", 0.0
        known = self.known
        new = {w for w in words if w not in known}
        if new:
            if len(known) > REMEMBERED:
                self.forget()
                known, new = self.known, set(words)
            fresh = sorted(new)
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
            need = len(known)
            if need > len(self.matrix):
                self.matrix = np.concatenate([self.matrix, np.zeros((max(4096, need), len(self.languages)), np.float32)])[: 2 * need + 4096]
            self.matrix[need - len(fresh) : need] = [self.vector(w) for w in fresh]
        total = self.matrix[[known[w] for w in words]].sum(axis=0, dtype=np.float64)
        total *= min(1.0, CERTAIN / len(words))
        likely = np.exp(total - total.max())
        best = int(np.argmax(likely))
        return self.languages[best], float(likely[best] / likely.sum())


def fit(sample: DataFrame) -> Model:
    """Count words and n-grams per language over the sample; keep those that it holds often enough."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            rows: list[tuple[str, int, str, int]] = []
            for lang, counter in words.items():
                rows += [(lang, 0, w, n) for w, n in counter.items()]
                for size in SIZES:
                    grams: Counter = Counter()
                    for w, n in counter.items():
                        for g in _grams(w, size):
                            grams[g] += n
                    rows += [(lang, size, g, n) for g, n in grams.items()]
            words.clear()
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["lang", "kind", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words.setdefault(lang, Counter()).update(WORD.findall(text.as_py().lower()))
                if sum(map(len, words.values())) > GATHER:
                    yield out()
        yield out()
        give_back()

    counts = materialise(sample.mapInArrow(count, "lang string, kind int, gram string, n long").groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n")))
    totals = {(r["lang"], r["kind"]): r["n"] for r in counts.groupBy("lang", "kind").agg(F.sum("n").alias("n")).collect()}
    kept = counts.groupBy("kind", "gram").agg(F.sum("n").alias("all")).where(F.col("all") >= LEAST).select("kind", "gram")
    rows = counts.join(kept, ["kind", "gram"]).select("lang", "kind", "gram", "n").toArrow()
    return Model.of_table(sorted({lang for lang, _ in totals}), rows, totals)


def with_language(docs: DataFrame, model: Model, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct (lang, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for column in columns:
            found = [own.predict(t.as_py()) for t in column]
            give_back()
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], ["lang", "score"])

    return docs.withColumn(into, arrow_udf(run, "lang string, score double")(F.col(text)))


def held_out_predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; held-out rows are never learned from."""
    model = fit(training_sample(docs.select("doc_id", "text", "lang"), fold(F.col("doc_id"), 4) != 2))
    found = with_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
