"""Toxicity by a weighted finite-state grammar over clauses.

A clause is read once, word by word. A lexical transducer turns words, and pairs of adjacent words, into token
classes with weights; five transducers read these classes side by side:

- insult: a slur matches; so do two half slurs with at most one token between them;
- threat: a verb of harm within reach of a word of intent, or followed by a target within reach;
- target: somebody is addressed anywhere in the clause;
- negation: a negation within the ``REACH`` tokens before;
- report: a verb of saying earlier in the clause.

Their composition is one machine whose state is the tuple of theirs. Where its insult or threat part matches, the
state also names the mark of the match (aimed, negated, reported). What counts is matched clauses and not words: a
clause is worth its best match, weakened by its mark, and a text is judged by its clauses of each kind.

Function words of the grammar are fixed lists. Slurs are learned from labelled texts: whole words, families of words
(a common start with any end, or with a short one) and pairs of half slurs. A word is known by its most special
entry, also if that speaks against toxicity. The weights of the kinds come from a logistic regression. Learning takes
a bounded sample, ``FIT_DOCS`` labelled rows of smallest hash, so the model is bounded by what that many texts hold
and travels with the tasks; scoring covers every row.

Defined results: null and empty texts get the score of no match; very long texts are read whole, and a clause without
sentence marks ends after ``CLAUSE_WORDS`` words; repeated rows are scored each; of labels that disagree on an id or
a text, toxic wins; without usable labels the lexicon is empty and every score is the prior; an empty table gives an
empty one; equal scores need no order; extra columns stay in ``keep_clean`` and are not read otherwise.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import fold, fresh, give_back, materialise

#: Labelled rows that a fit takes at most.
FIT_DOCS = 20_000
#: A slur is learned if so many toxic texts hold it, its log odds reach this, and their product this.
LEAST_DOCS, LEAST_ODDS, LEAST_EVIDENCE = 6, 1.5, 20.0
#: Log odds from which a word is half a slur, and what they times the toxic texts must reach.
HALF_ODDS, HALF_EVIDENCE = 0.7, 8.0
#: Lengths of word starts that may stand for a family of words, and letters that a short end has at most.
STARTS, SHORT_END = (3, 4, 5, 6, 7, 8), 4
HEAD = min(STARTS)
#: Words in a clause.
CLAUSE_WORDS = 40
THRESHOLD = 0.7
#: Terms that a task counts before it hands them on.
GATHER = 200_000
#: Words that a worker remembers before it starts anew.
REMEMBERED = 300_000

CLAUSE = regex.compile(r"[.!?;:\n]+")
WORD = regex.compile(r"\p{L}[\p{L}\p{M}']*")
#: Fixed word lists of the grammar.
NEGATION = frozenset("not no never nobody nothing isn't don't nicht kein keine nie niemals ne pas jamais aucun sin nunca nadie ningún".split())
REPORTED = frozenset("said says wrote writes claimed quoted called sagte sagt schrieb behauptete dit disait écrit dijo dice escribió".split())
TARGET = frozenset("you your you're they them people du ihr dich euch sie tu vous toi ils tú usted ustedes vosotros ellos te os".split())
INTENT = frozenset("will i'll we'll gonna going shall should must werde werden wirst soll vais allons veux voy vamos quiero".split())
FUNCTION = NEGATION | REPORTED | TARGET | INTENT
#: Starts of verbs of harm, with any ending of up to four letters.
HARM = frozenset("kill hurt destroy burn shoot punch töte verletz tuer frapper matar golpear".split())
HARM_END = 4

CLASSES = 8
OTHER, SLUR, HALF, INTEND, HURT, AIM, NEGATE, REPORT = range(CLASSES)
PLAIN = (OTHER, 0.0)
#: Tokens for which a negation or an intent holds, and in which a target must follow a verb of harm.
REACH = 3
#: Kinds of match: insult or threat, times aimed, negated, reported.
KINDS = 16
#: What a match is worth by its mark (aimed 1, negated 2, reported 4), before its kind's weight is learned.
WORTH = np.array([(1.25 if m & 1 else 1.0) * (0.4 if m & 2 else 1.0) * (0.6 if m & 4 else 1.0) for m in range(8)])


@dataclass(frozen=True)
class Transducer:
    """step[state][class] is the next state, out[state][class] whether the arc matches, mark[state] what it tells of a match read in that state."""

    step: tuple[tuple[int, ...], ...]
    out: tuple[tuple[int, ...], ...]
    mark: tuple[int, ...]


def _machine(states: int, step, out=lambda s, c: 0, mark=lambda s: 0) -> Transducer:
    table = lambda f: tuple(tuple(int(f(s, c)) for c in range(CLASSES)) for s in range(states))
    return Transducer(table(step), table(out), tuple(int(mark(s)) for s in range(states)))


#: States: tokens left in which a second half slur matches.
INSULT = _machine(3, lambda s, c: 2 if c == HALF else max(0, s - 1), lambda s, c: c == SLUR or (c == HALF and s > 0))


def _threat_step(s: int, c: int) -> int:
    intent, harm = divmod(s, REACH + 1)
    return (REACH if c == INTEND else max(0, intent - 1)) * (REACH + 1) + (REACH if c == HURT else max(0, harm - 1))


#: States: tokens left for an intent, and tokens left in which a target completes a verb of harm.
THREAT = _machine((REACH + 1) ** 2, _threat_step, lambda s, c: (c == HURT and s // (REACH + 1) > 0) or (c == AIM and s % (REACH + 1) > 0))
TARGETED = _machine(2, lambda s, c: s or c == AIM, mark=lambda s: s)
NEGATED = _machine(REACH + 1, lambda s, c: REACH if c == NEGATE else max(0, s - 1), mark=lambda s: s > 0)
SAID = _machine(2, lambda s, c: s or c == REPORT, mark=lambda s: s)


def compose(insult: Transducer, threat: Transducer, *marks: Transducer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One machine: next state and match (1 insult, 2 threat) by (state, class), and the marks of each state as a number."""
    parts = (insult, threat, *marks)
    states = list(product(*[range(len(t.mark)) for t in parts]))
    number = {s: i for i, s in enumerate(states)}
    step = np.array([[number[tuple(t.step[x][c] for t, x in zip(parts, s, strict=True))] for c in range(CLASSES)] for s in states])
    out = np.array([[insult.out[s[0]][c] or 2 * threat.out[s[1]][c] for c in range(CLASSES)] for s in states])
    mark = np.array([sum(t.mark[x] << k for k, (t, x) in enumerate(zip(marks, s[2:], strict=True))) for s in states])
    return step, out, mark


STEP, OUT, MARK = (x.tolist() for x in compose(INSULT, THREAT, TARGETED, NEGATED, SAID))


def read_clause(tokens: list[tuple[int, float]]) -> list[tuple[int, float]]:
    """The matches of a clause of (class, weight): (kind, weight). A target counts wherever it stands, so marks are final at the end."""
    state, found = 0, []
    for c, weight in tokens:
        if OUT[state][c]:
            found.append((8 * (OUT[state][c] - 1) + MARK[state], weight))
        state = STEP[state][c]
    aimed = MARK[state] & 1
    return [(kind | aimed, weight) for kind, weight in found]


def word_entries(word: str) -> list[str]:
    """The lexicon entries that a word falls under, the most special first."""
    out = [word]
    for n in reversed(STARTS):
        if len(word) >= n:
            if 0 < len(word) - n <= SHORT_END:
                out.append(word[:n] + "+")
            out.append(word[:n] + "*")
    return out


def is_harm(word: str) -> bool:
    return any(word[: len(word) - n] in HARM for n in range(HARM_END + 1))


#: Features of a text besides the kinds: worth of all clauses, of the best, and of all in proportion to the words.
EXTRAS = 3


@dataclass
class Model:
    """lexicon: word or family to log odds; pairs: two half slurs to theirs; weights: bias, kinds, extras."""

    lexicon: dict[str, float]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 + KINDS + EXTRAS))
    pairs: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.known: dict[str, tuple[int, float]] = {}
        self.heads = {e[:HEAD] for e in (*HARM, *(e for e in self.lexicon if e[-1] in "*+"))}  # of words that may be of a family, or harm
        self.dull: set[str] = set()  # runs between white space without a word that can match

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "dull": set()}

    def odds(self, word: str) -> float:
        """Of the strongest entry that the word falls under, unless the word itself is an entry."""
        own = self.lexicon.get(word)
        return own if own is not None else max((self.lexicon[e] for e in word_entries(word)[1:] if e in self.lexicon), default=0.0)

    def token(self, word: str) -> tuple[int, float]:
        """Class and weight of a word; those of words in texts that may match are remembered."""
        if word[:HEAD] not in self.heads and word not in self.lexicon and word not in FUNCTION:
            return PLAIN
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            odds = self.odds(word)
            if odds >= LEAST_ODDS:
                found = (SLUR, odds)
            elif word in TARGET:
                found = (AIM, 0.0)
            elif word in NEGATION:
                found = (NEGATE, 0.0)
            elif word in REPORTED:
                found = (REPORT, 0.0)
            elif word in INTENT:
                found = (INTEND, 0.0)
            elif is_harm(word):
                found = (HURT, 2.0)
            else:
                found = (HALF, odds) if odds >= HALF_ODDS else PLAIN
            self.known[word] = found
        return found

    def tokens(self, words: list[str]) -> list[tuple[int, float]]:
        """The lexical transducer: classes of the words; a learned pair of half slurs is a slur at its second word."""
        out = [self.token(w) for w in words]
        if self.pairs:
            for i in range(1, len(out)):
                if out[i][0] == HALF and out[i - 1][0] == HALF and (odds := self.pairs.get(f"{words[i - 1]} {words[i]}")) is not None:
                    out[i] = (SLUR, odds)
        return out

    def features(self, text: str | None) -> np.ndarray:
        """Matched clauses by kind (logarithmically), and what they are worth."""
        out = np.zeros(KINDS + EXTRAS)
        if not text:
            return out
        low = text.lower()
        if not self.may_match(low):
            return out
        n_words, total, best = 0, 0.0, 0.0
        for clause in CLAUSE.split(low):
            words = WORD.findall(clause)
            n_words += len(words)
            for i in range(0, len(words), CLAUSE_WORDS):
                found = read_clause(self.tokens(words[i : i + CLAUSE_WORDS]))
                if found:
                    worth, kind = max((weight * WORTH[kind & 7], kind) for kind, weight in found)
                    out[kind] += 1
                    total += worth
                    best = max(best, worth)
        out[:KINDS] = np.log1p(out[:KINDS])
        out[KINDS:] = np.log1p(total), best / 4, np.log1p(100 * total / (n_words + 20))
        return out

    def may_match(self, low: str) -> bool:
        """Whether the text holds a slur, half a slur or a verb of harm. Runs between white space that hold none are remembered, so most texts are split and no more."""
        if len(self.dull) >= REMEMBERED:
            self.dull.clear()
        matter = False
        for run in set(low.split()) - self.dull:
            bare = run.rstrip(".,;:!?")
            if any(self.token(word)[0] in (SLUR, HALF, HURT) for word in ((bare,) if bare.isalpha() else WORD.findall(run))):
                matter = True
            else:
                self.dull.add(run)
        return matter

    def score(self, text: str | None) -> float:
        z = self.weights[0] + self.features(text) @ self.weights[1:]
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _terms(text: str) -> set[str]:
    return set(chain.from_iterable(map(_entries, set(WORD.findall(text.lower())))))


@lru_cache(maxsize=50_000)
def _entries(word: str) -> tuple[str, ...]:
    return tuple(word_entries(word))


def _half_pairs(text: str, model: Model) -> set[str]:
    words = WORD.findall(text.lower())
    half = [model.token(w)[0] == HALF for w in words]
    return {f"{words[i - 1]} {words[i]}" for i in range(1, len(words)) if half[i] and half[i - 1]}


def labelled_sample(docs: DataFrame, labels: DataFrame, where=None) -> DataFrame:
    """(text, toxic) of at most ``FIT_DOCS`` labelled rows. The sampled ids are few, so they are sent to the texts."""
    rows = labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    if where is not None:
        rows = rows.where(where)
    chosen = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS)
    chosen = materialise(chosen)
    texts = docs.select("doc_id", "text").where("text IS NOT NULL")
    return materialise(texts.join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")))


def _holding(texts: DataFrame, terms_of, only=None) -> DataFrame:
    """(term, n): how many of the texts hold each term, of all or of ``only``. A task hands its counts on whenever it has many."""
    only = None if only is None else frozenset(only)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["term", "n"])
            held.clear()
            return rows

        for batch in batches:
            for text in batch.column(0):
                held.update(terms_of(text.as_py()) if only is None else terms_of(text.as_py()) & only)
                if len(held) > GATHER:
                    yield out()
        yield out()
        give_back()

    return texts.mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _log_odds(sample: DataFrame, terms_of, n_bad: int, n_good: int) -> dict[str, tuple[int, int, float]]:
    """Term to toxic texts, other texts, and log odds, for terms of ``LEAST_DOCS`` toxic texts or more. Others are looked for in the other texts at no time."""
    bad = {r["term"]: r["n"] for r in _holding(sample.where("toxic = 1").select("text"), terms_of).where(F.col("n") >= LEAST_DOCS).collect()}
    good = {r["term"]: r["n"] for r in _holding(sample.where("toxic = 0").select("text"), terms_of, bad.keys()).collect()} if bad else {}
    return {t: (b, g := good.get(t, 0), math.log((b + 0.5) / (n_bad + 1)) - math.log((g + 0.5) / (n_good + 1))) for t, b in bad.items()}


def _is_slur(bad: int, odds: float) -> bool:
    return odds >= LEAST_ODDS and bad * odds >= LEAST_EVIDENCE


def fit(sample: DataFrame) -> Model:
    """Learn the lexicon from document frequencies that Spark counts, then the weights from the matched clauses. sample: (text, toxic), each text once."""
    sizes = {int(r["toxic"]): int(r["n"]) for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_bad, n_good = sizes.get(1, 0), sizes.get(0, 0)
    if not n_bad or not n_good:
        rate = (n_bad + 1) / (n_bad + n_good + 2) if n_bad + n_good else 0.05
        return Model({}, np.concatenate([[np.log(rate / (1 - rate))], np.zeros(KINDS + EXTRAS)]))
    found = _log_odds(sample, _terms, n_bad, n_good)
    slurs = {t: odds for t, (bad, _, odds) in found.items() if _is_slur(bad, odds)}
    # A whole word that many texts hold stays with lower odds too: as half a slur, or to speak against a family.
    whole = {t: (good, odds) for t, (_, good, odds) in found.items() if t not in slurs and t[-1] not in "*+"}
    half = {t: odds for t, (good, odds) in whole.items() if (odds >= HALF_ODDS and found[t][0] * odds >= HALF_EVIDENCE) or (good >= LEAST_DOCS and any(e in slurs for e in word_entries(t)))}
    model = Model(slurs | half)
    pairs = _log_odds(sample, lambda text: _half_pairs(text, model), n_bad, n_good)
    model = Model(model.lexicon, pairs={t: odds for t, (bad, _, odds) in pairs.items() if _is_slur(bad, odds)})

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*model.features(t).round(4).tolist(), float(y)) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64()))], names=["row"])

    # Rows with the same matches count once with their number.
    rows = sample.mapInArrow(features, "row array<double>").groupBy("row").agg(F.count(F.lit(1)).alias("n")).orderBy("row").collect()
    table = np.array([r["row"] for r in rows])
    return Model(model.lexicon, logistic(table[:, :-1], table[:, -1], np.array([r["n"] for r in rows], float)), model.pairs)


#: What a kind of match weighs before anything is learned: plain and aimed more than negated or reported.
PRIOR = np.array([0.0, *[(0.5 if not k & 8 else 0.3) + 0.3 * (k & 1) - 0.2 * (k >> 1 & 1) - 0.2 * (k >> 2 & 1) for k in range(KINDS)], 0.5, 0.5, 0.5])


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, pull: float = 0.5, rounds: int = 100) -> np.ndarray:
    """A logistic regression with a Gaussian prior around ``PRIOR``: Newton steps, each halved until the loss falls, so it settles on separable rows too."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    ridge = np.full(x.shape[1], pull)
    ridge[0] = 1e-3

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(n @ (np.logaddexp(0, z) - y * z) + 0.5 * ridge @ (w - PRIOR) ** 2)

    w = PRIOR.copy()
    w[0] = -2.0
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (n * (p - y)) + ridge * (w - PRIOR)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(ridge), gradient)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        after = loss(w - size * step)
        if not after < now - 1e-9 * abs(now):
            break
        w, now = w - size * step, after
    return w


def with_score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    def run(column: pa.Array) -> pa.Array:
        out = [model.score(t.as_py()) for t in column]
        give_back()
        return pa.array(out, pa.float64())

    return docs.withColumn(into, arrow_udf(run, "double")(F.col(text)))


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of held-out rows are never used."""
    model = fit(labelled_sample(docs, labels, fold(F.col("doc_id"), 3) != 1))
    scored = with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with their own columns."""
    model = fit(labelled_sample(docs, labels, fold(F.col("doc_id"), 3) != 1))
    into = fresh(docs, "toxic_score")
    return with_score(docs, model, into=into).where(F.col(into) < THRESHOLD).drop(into)
