"""URL filter: all glob rules at once in a bit-parallel automaton (Shift-And).

Every position of every rule is one bit of a multiword mask. A character moves all rules by one shift and one
mask; a star is a bit that keeps itself. Many URLs are stepped side by side.

A glob speaks about the canonical URL ``.host/path``: ``*`` is any run of characters, ``~`` a run without
``/``. A plain rule ``net/es/`` of a host and the start of a path is the glob ``~.net/es/*``.

Of the plain rules that fit, the longest decides; if none fits, a URL that a blocking glob fits is blocked and
any other is allowed. The rules travel with the task; their size is that of the rule lists given.

Defined results: a null url, or one without ``://``, has an empty host and path and is allowed by default;
very long urls are read whole; repeated rows are judged each; of rules of equal length only one can fit; an empty table gives
an empty one; further columns are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import as_bytes, steps

#: (verdict, host and start of path); the longest that fits wins.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Globs that block a URL which no rule fits: advertising and tracking hosts, and feeds of ads by path.
BLOCK_GLOBS = ("~.ads-~/*", "~.ads.~/*", "~track.~/*", "~tracker.~/*", "~.doubleclick.~/*", "*/adserver/*")


@dataclass(frozen=True)
class Automaton:
    """start: bits that a URL begins with; step, stay: for each byte, bits that are entered and kept; final: bit of each rule's end."""

    start: np.ndarray
    step: np.ndarray
    stay: np.ndarray
    final: tuple[int, ...]

    @staticmethod
    def of(globs: list[str]) -> Automaton:
        """A rule has a bit for 'nothing read yet' and one after each character; a star belongs to the bit before it."""
        entered: list[tuple[int, int]] = []
        kept: list[tuple[int, str]] = []
        start, final, bit = [], [], 0
        for glob in globs:
            start.append(bit)
            for b in glob.encode():
                if b in b"*~":
                    kept.append((bit, chr(b)))
                else:
                    bit += 1
                    entered.append((bit, b))
            final.append(bit)
            bit += 1
        words = bit // 64 + 1
        step, stay = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
        for i, b in entered:
            step[b, i // 64] |= np.uint64(1 << i % 64)
        for i, star in kept:
            chars = [c for c in range(256) if star == "*" or c != ord("/")]
            stay[chars, i // 64] |= np.uint64(1 << i % 64)
        first = np.zeros(words, np.uint64)
        for i in start:
            first[i // 64] |= np.uint64(1 << i % 64)
        return Automaton(first, step, stay, tuple(final))

    def run(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each URL and rule, whether the rule fits the whole URL."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        begin, lengths = offsets[:-1][order], lengths[order]
        state = np.repeat(self.start[None, :], len(order), axis=0)
        for i in range(int(lengths[0]) if len(lengths) else 0):
            n = int(np.searchsorted(-lengths, -i, side="left"))  # those longer than i
            char, now = data[begin[:n] + i], state[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.step[char]) | (now & self.stay[char])
        fits = np.stack([(state[:, f // 64] >> np.uint64(f % 64)) & np.uint64(1) for f in self.final], axis=1).astype(bool) if self.final else np.zeros((len(order), 0), bool)
        out = np.empty_like(fits)
        out[order] = fits
        return out


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, block_globs=BLOCK_GLOBS) -> DataFrame:
    """page_id, host, path, the rule that decides and the verdict, for each row."""
    rules = sorted(rules, key=lambda r: -len(r[1]))
    names, verdicts = [r[1] for r in rules] + [None], [r[0] for r in rules]
    machine = Automaton.of([f"~.{r[1]}*" for r in rules] + list(block_globs))

    @arrow_udf("rule string, verdict string")
    def run(canonical: pa.Array) -> pa.Array:
        chosen, blocked = [np.empty(0, np.int64)], [np.empty(0, bool)]
        for _, _, data, offsets in steps(canonical):
            fits = machine.run(data, offsets)
            plain = np.concatenate([fits[:, : len(rules)], np.ones((len(fits), 1), bool)], axis=1)
            chosen.append(np.argmax(plain, axis=1))
            blocked.append(fits[:, len(rules) :].any(axis=1))
        k, bad = np.concatenate(chosen), np.concatenate(blocked)
        rule = pa.array(names, pa.string()).take(pa.array(k))
        says = np.array([*verdicts, ""], dtype=object)[k]
        says[k == len(rules)] = np.where(bad[k == len(rules)], "block", "allow")
        return pa.StructArray.from_arrays([rule, pa.array(says.tolist(), pa.string())], ["rule", "verdict"])

    parts = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    return parts.withColumn("judged", run(as_bytes(F.concat(F.lit("."), "host", "path")))).select("page_id", "host", "path", "judged.*")


def _glob_sql(glob: str) -> str:
    """The glob as a DuckDB condition on ``c``."""
    pattern = "".join({"*": "(?s:.)*", "~": "[^/]*"}.get(x, x if x.isalnum() else "[" + x + "]" if x not in "^\\" else "\\" + x) for x in glob)
    return f"regexp_full_match(c, '{pattern}')"


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
c AS (SELECT *, '.' || host || path AS c FROM p),
r AS (SELECT *, CASE {" ".join(f"WHEN {_glob_sql('~.' + r + '*')} THEN '{r}'" for _, r in sorted(RULES, key=lambda x: -len(x[1])))} END AS rule FROM c)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in RULES)}
  WHEN {" OR ".join(_glob_sql(g) for g in BLOCK_GLOBS)} THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
