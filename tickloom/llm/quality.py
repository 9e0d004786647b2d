"""Quality rules at host level.

Every document is measured once. Rule failures are counted per host, host rates are shrunk towards an
empirical beta prior (method of moments over all hosts), and the verdict of the host is joined back.

Defined results: a null text has no words, so it fails the base rule; a null host is a host of its own;
repeated rows are measured each; a table without rows gives one without rows; further columns pass through.
Words and windows of words are told apart inside one text by 64-bit hashes, so that two different ones count as one
about once in 10^19 / n^2 texts of n windows; lines are compared whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import as_bytes, fresh, materialise, word_steps

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: A host is rejected when its shrunk failure rate is above this.
HOST_RATE = 0.5
#: The prior weighs at least and at most so many documents (bounds of the moment estimate).
PRIOR_WEIGHT = (2.0, 1000.0)

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True


def _counts(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _dup_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(lines) == len(set(lines)):
        return 0
    seen: set[bytes] = set()
    again = 0
    for line in lines:
        if line in seen:
            again += 1
        elif line.strip(b" \t\r\x0b\x0c"):
            seen.add(line)
    return again


def _repeated(words) -> np.ndarray:
    """Per text, the words that lie in a window found twice or more in it."""
    n_docs = len(words.first) - 1
    keys, at = words.windows(WINDOW)
    if not len(keys):
        return np.zeros(n_docs, np.int64)
    doc = words.doc[at]
    order = np.lexsort((keys, doc))
    keys, doc, at = keys[order], doc[order], at[order]
    same = (keys[1:] == keys[:-1]) & (doc[1:] == doc[:-1])
    twice = np.zeros(len(keys), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + WINDOW, -1)
    return _counts(np.cumsum(edge[:-1]) > 0, words.first)


def _measure(text: pa.Array) -> pa.Array:
    out: list[np.ndarray] = []
    for _, _, w in word_steps(text, fold_case=False):
        letters = (w.data & 0xC0) != 0x80
        solid = np.zeros(len(w.data) + 1, np.int64)
        np.add.at(solid, w.starts, 1)
        np.add.at(solid, w.starts + w.lengths, -1)
        inside = np.cumsum(solid[:-1]) > 0
        raw = w.data.tobytes()
        dup = [_dup_lines(raw[a:b]) for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True)]
        out.append(np.stack([np.diff(w.first), _counts(letters & inside, w.offsets), _counts(_SYMBOL[w.data], w.offsets), np.array(dup, np.int64), _repeated(w)]))
    table = np.concatenate(out, axis=1) if out else np.zeros((5, 0), np.int64)
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in table], ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > REPEAT_PERCENT * n_words)


def measure(docs: DataFrame, text: str = "text", into: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``into`` of the measures and ``base_failed``."""
    out = docs.withColumn(into, arrow_udf(_measure, MEASURES)(as_bytes(F.col(text))))
    return out.withColumn(into, F.col(into).withField("base_failed", base_failed(F.col(f"{into}.n_words"), F.col(f"{into}.n_repeat_words"))))


def host_rates(measured: DataFrame, host: str = "host", failed: str = "base_failed") -> DataFrame:
    """One row per host: documents, failures, shrunk rate and verdict.

    The prior Beta(a, b) comes from the hosts' own rates: mean m and variance v weighted by documents, with
    the sampling part taken off v; a + b = m(1 - m)/v - 1 inside ``PRIOR_WEIGHT``.
    """
    hosts = measured.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("host_docs"), F.count_if(F.col(failed)).alias("host_failed"))
    n, k = F.col("host_docs").cast("double"), F.col("host_failed").cast("double")
    moments = hosts.agg(F.sum(n).alias("n"), F.sum(k).alias("k"), F.sum(k * k / n).alias("kk"), F.count(F.lit(1)).alias("h"))
    m = F.try_divide(F.col("k"), F.col("n"))
    between = F.greatest(F.col("kk") / F.col("n") - m * m - F.col("h") / F.col("n") * m * (1 - m), F.lit(0.0))
    weight = F.when(between > 0, F.least(F.greatest(m * (1 - m) / between - 1, F.lit(PRIOR_WEIGHT[0])), F.lit(PRIOR_WEIGHT[1]))).otherwise(PRIOR_WEIGHT[1])
    prior = moments.where(F.col("n") > 0).select(m.alias("prior_mean"), weight.alias("prior_weight"))
    rate = (k + F.col("prior_mean") * F.col("prior_weight")) / (n + F.col("prior_weight"))
    # The prior is one row, so this join adds two columns to each host.
    return hosts.crossJoin(F.broadcast(prior)).select("host", "host_docs", "host_failed", rate.alias("host_rate"), (rate <= HOST_RATE).alias("host_kept"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Measures, base rule and verdict for each row of ``docs``.

    Only ids, hosts and counts are written and joined, never texts. The host table joins by a null-safe key;
    Spark broadcasts it if it is small and splits the hot hosts of the other side if it isn't.
    """
    rows = materialise(measure(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(host).cast("string").alias("host")), "text").select("doc_id", "host", "quality.*"))
    hosts = host_rates(rows).withColumnRenamed("host", "of_host")
    joined = rows.join(hosts, F.col("host").eqNullSafe(F.col("of_host")), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("host_kept")).alias("kept"), "host", "host_docs", "host_failed", "host_rate",
    )


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass the base rule and whose host passes, with their own columns only."""
    into = fresh(docs, "quality")
    measured = measure(docs, text, into)
    rates = measured.select(F.col(host).cast("string").alias("host"), F.col(f"{into}.base_failed").alias("base_failed"))
    bad = materialise(host_rates(rates).where(~F.col("host_kept")).select(F.col("host").alias("of_host")))
    good = measured.where(~F.col(f"{into}.base_failed")).drop(into)
    return good.join(bad, good[host].cast("string").eqNullSafe(bad["of_host"]), "left_anti")


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source FROM documents),
w AS (SELECT doc_id, text, source, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM d),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
win AS (SELECT doc_id, i, word || {" || ".join(f"' ' || lead(word, {j}) OVER o" for j in range(1, WINDOW))} AS key FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, key) AS n FROM win WHERE key IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM k, range({WINDOW}) t(o) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, unnest(ls) AS line FROM w),
lc AS (SELECT doc_id, line, count(*) AS n FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY ALL),
ld AS (SELECT doc_id, sum(n - 1) AS n_dup_lines FROM lc GROUP BY doc_id),
b AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (doc_id) LEFT JOIN ld USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM b),
h AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (base_failed)::DOUBLE AS k FROM f GROUP BY source),
m AS (SELECT sum(k) / sum(n) AS m, sum(k * k / n) / sum(n) AS kk, count(*) / sum(n) AS hn FROM h),
p AS (SELECT m, greatest(kk - m * m - hn * m * (1 - m), 0) AS v FROM m),
q AS (SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, {PRIOR_WEIGHT[0]}), {PRIOR_WEIGHT[1]}) ELSE {PRIOR_WEIGHT[1]} END AS wt FROM p),
s AS (SELECT source, (k + m * wt) / (n + wt) <= {HOST_RATE} AS ok FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept
FROM f JOIN s ON f.source IS NOT DISTINCT FROM s.source
"""
