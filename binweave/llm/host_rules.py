"""Host-level quality rules.

Every document is measured; rule failures are summed by host; each host's failure rate is
shrunk towards the corpus by a beta prior fitted by moments (see shrink.py); the host
verdict joins back to the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, documents, guarded, lean, materialise
from .hashing import byte_steps, byte_values, fold, is_white, mix64, span_hashes
from .shrink import LEAST_WEIGHT, MOST_WEIGHT, posterior, prior_weight

MIN_WORDS = 50
MAX_REPEAT = 50  # percent of the words in repeated 3-word windows
MAX_SYMBOLS = 50  # symbols per 100 words
MAX_DUP_LINES = 50  # repeated lines per 100 lines with a word
MAX_HOST_RATE = 0.5

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeats(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of hashes that belong to owners: whether each comes twice or more with its owner, and
    whether it is one that its owner had before."""
    key = mix64(hashes ^ mix64(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.concatenate([[False], same])
    twice, later = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
    twice[order], later[order] = again | np.concatenate([same, [False]]), again
    return twice, later


def measure(texts: list[bytes]) -> np.ndarray:
    """A row of STATS for each text: words, code points in words, symbols, lines with a
    word, those equal to an earlier line, words in 3-word windows found twice or more."""
    if not texts:
        return np.zeros((0, len(STATS)), dtype=np.int64)
    a = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    n = len(texts)
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts = np.concatenate([[0], ends[:-1]])
    white = is_white(a)
    spans = span_hashes(byte_values()[a])

    def counted(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[ends] - total[starts]

    flips = np.flatnonzero(np.diff(white, prepend=True))
    word_at, word_end = flips[::2], flips[1::2]
    owner = np.searchsorted(ends, word_at, side="right")
    words = np.bincount(owner, minlength=n)
    chars = counted(~white & ((a & 0xC0) != 0x80))
    symbols = counted(np.isin(a, np.frombuffer(SYMBOLS.encode(), dtype=np.uint8)))
    repeated = np.zeros(n, dtype=np.int64)
    if len(word_at) > 2:
        h = spans(word_at, word_end)
        at = np.flatnonzero(owner[:-2] == owner[2:])
        twice, _ = repeats(owner[at], fold([h[:-2], h[1:-1], h[2:]])[at])
        hit = at[twice]
        inside = np.zeros(len(h), dtype=bool)
        for k in range(3):
            inside[hit + k] = True
        repeated = np.bincount(owner[inside], minlength=n)
    line_end = np.flatnonzero(a == 10)
    line_at = np.concatenate([[0], line_end[:-1] + 1])
    solid = np.concatenate([[0], np.cumsum(~white)])
    full = solid[line_end] > solid[line_at]
    line_at, line_end = line_at[full], line_end[full]
    owner = np.searchsorted(ends, line_at, side="right")
    _, later = repeats(owner, spans(line_at, line_end))
    return np.stack([words, chars, symbols, np.bincount(owner, minlength=n), np.bincount(owner[later], minlength=n), repeated], axis=1)


def text_stats(text: Column) -> Column:
    """A struct of the measures of a text column; null counts as the empty text. Lines and
    windows are compared by 64-bit hashes, long texts whole."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [measure(group) for _, group in byte_steps(texts.tolist())]
            yield pd.DataFrame(np.concatenate([np.zeros((0, len(STATS)), dtype=np.int64), *found]), columns=STATS)

    return F.pandas_udf(lean(run), ", ".join(f"{c} long" for c in STATS))(text)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT * s["n_words"])


def soft_failed(s: Column) -> Column:
    return (100 * s["n_symbols"] > MAX_SYMBOLS * s["n_words"]) | (100 * s["n_dup_lines"] > MAX_DUP_LINES * s["n_lines"])


def host_rates(hosts: DataFrame, host: str = "__host") -> DataFrame:
    """Rows (host, n, failed) with the posterior mean of the failure rate: the prior's mean
    is the failure rate of all documents, its weight comes from the spread of the hosts' rates
    less the noise within hosts, large hosts counting more. Hosts that differ by no more than
    chance, or a single host, get the common rate; ties don't matter."""
    weight = prior_weight(hosts, "n", "failed", "failed")
    failed, n = hosts.agg(F.sum("failed"), F.sum("n")).first()
    mean = F.lit(failed / n if n else 0.0)
    return hosts.select(host, "n", "failed", posterior(F.col("failed"), F.col("n"), mean, weight).alias("rate"))


def judged(rows: DataFrame, measured: DataFrame | None = None, host: str = "source") -> DataFrame:
    """rows, which hold the measures in a struct column __stats, with the struct __rules in its
    place. measured: a table of just (__host, __stats) for all rows; without it rows
    themselves, which then are read twice, should be a written table."""
    stats, s = "__stats", F.col("__stats")
    failed = base_failed(s) | soft_failed(s)
    hosts = rows.select(F.col(f"`{host}`").alias("__host"), s) if measured is None else measured
    hosts = hosts.groupBy("__host").agg(F.count("*").alias("n"), F.sum(failed.cast("long")).alias("failed"))
    rates = host_rates(materialise(hosts, "hosts")).select(F.col("__host").alias("__h"), F.col("rate").alias("__rate"))
    rows = rows.join(rates, F.col(f"`{host}`").eqNullSafe(F.col("__h")), "left")
    kept = ~failed & (F.coalesce(F.col("__rate"), F.lit(0.0)) <= MAX_HOST_RATE)
    rules = F.struct(f"{stats}.*", base_failed(s).alias("base_failed"), F.col("__rate").alias("host_rate"), kept.alias("kept"))
    return rows.withColumn("__rules", rules).drop(stats, "__h", "__rate")


@guarded
def judge(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """docs with a struct column __rules: the measures, base_failed, host_rate and kept.

    A document is rejected if it fails a base rule (fewer than 50 words, or over half of
    its words in 3-word windows found twice or more), if it is mostly symbols or repeated
    lines, or if its host's shrunk failure rate is over one half. A null host is a host of
    its own; null and empty texts have no words and fail; very long texts are measured
    whole; an empty table stays empty; rows that repeat are judged alike and count as often
    as they come; columns whose names clash with internal ones pass unchanged. Rows of any
    width pass, so texts are measured once for the hosts and once for the result rather than
    written; who needs the measures alone writes these and calls ``judged``."""
    stats = text_stats(F.col(text)).alias("__stats")
    measured = materialise(docs.select(F.col(f"`{host}`").alias("__host"), stats), "measured")
    return judged(docs.withColumn("__stats", text_stats(F.col(text))), measured=measured, host=host)


def op10_host_rules(spark, sf_dir) -> DataFrame:
    rules = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rate")
    rows = judged(materialise(documents(spark, sf_dir).select("doc_id", "source", text_stats(F.col("text")).alias("__stats")), "measured"))
    return rows.select("doc_id", *[F.round("__rules.host_rate", 9).alias(c) if c == "host_rate" else F.col(f"__rules.{c}") for c in rules])


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
g AS (SELECT r, p, w AS a, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY r ORDER BY p)),
h AS (SELECT r, p, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g WHERE c IS NOT NULL),
k AS (SELECT r, count(DISTINCT p + o.x) AS n_repeat_words FROM h, (VALUES (0), (1), (2)) o(x) WHERE n > 1 GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '{WORD}') GROUP BY r),
s AS (SELECT d.r, doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN k ON k.r = d.r LEFT JOIN m ON m.r = d.r),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed,
  100 * n_symbols > {MAX_SYMBOLS} * n_words OR 100 * n_dup_lines > {MAX_DUP_LINES} * n_lines AS soft_failed FROM s),
t AS (SELECT source, count(*)::DOUBLE AS n, sum((base_failed OR soft_failed)::INT)::DOUBLE AS failed FROM b GROUP BY source),
q AS (SELECT count(*) AS hosts, sum(n) AS docs, sum(failed) AS failed, sum(n * n) AS n2, sum(failed * failed / n) AS sq FROM t),
v AS (SELECT *, docs - n2 / docs AS spread, greatest(0.0::DOUBLE, failed - sq) / nullif(docs - hosts, 0) AS sigma2 FROM q),
x AS (SELECT *, (sq - failed * failed / docs - (hosts - 1) * sigma2) / nullif(spread, 0) AS tau2 FROM v),
z AS (SELECT failed / docs AS m, CASE WHEN docs <= hosts OR hosts < 2 OR spread <= 0 OR tau2 * {MOST_WEIGHT}::DOUBLE <= sigma2 THEN {MOST_WEIGHT}::DOUBLE
  ELSE least({MOST_WEIGHT}::DOUBLE, greatest({LEAST_WEIGHT}::DOUBLE, sigma2 / tau2)) END AS w FROM x),
y AS (SELECT source, (failed + m * w) / (n + w) AS rate FROM t, z)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT soft_failed AND rate <= {MAX_HOST_RATE} AS kept, round(rate, 9) AS host_rate
FROM b JOIN y ON b.source IS NOT DISTINCT FROM y.source
"""
