"""Secret scans: fixed patterns, and the guessing cost of values in a credential's context.

A value that follows a credential's name (``pwd = ...``, ``"client_secret": "..."``) is cut
into segments of least total cost, in bits: words by their rank in the corpus, also
capitalised or with figures for letters, dates, repeats of a unit, keyboard walks, and
single characters by brute force. A placeholder or a phrase costs little whatever its length;
a value that costs GUESS bits or more is a secret.

The dictionary's ranks come from the counts of all words of all documents; tasks count first,
Spark adds, and only the DICTIONARY most frequent ones are sent to the tasks.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, lean

#: The patterns of the base kinds, in the order of their names, and the least
#: length of what counts (of the group, where there is one).
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}
#: A hex run shorter than that never counts, so it is not looked for.
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
KINDS = (*BASE, "guess")
#: A credential's name, and the value that follows it.
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|auth)[_-]?key|credentials?)["'\]]?\x20*(?::=|=>|[:=])\x20*["']?([^\s"'`,;<>(){}\[\]]{6,})""", re.IGNORECASE | re.ASCII)
#: Bits from which a value counts as a secret.
GUESS = 40.0
#: Words sent to the tasks at most, and a word's letters.
DICTIONARY, SHORTEST, LONGEST = 50_000, 3, 20
#: Bits that each segment costs for its kind.
SWITCH = 2.0
#: Units of repeats have up to so many characters.
UNIT = 8
YEARS = 120
#: Rows of keys: fixed values.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
#: Figures and signs that stand for letters.
FIGURES = str.maketrans("@4310$57!", "aaeiossti")
DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._])(?:0?[1-9]|1[0-2])\2(?:19|20)?\d\d|(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])(?:19|20)\d\d|(?:19|20)\d\d)", re.ASCII)


def dictionary(docs: DataFrame, text: str = "text", size: int = DICTIONARY) -> dict[str, float]:
    """Bits of the most frequent words (runs of a-z after A-Z are lowered) of all texts: log2 of
    the rank, frequent ones first, equal ones by word. Null texts have none."""
    words = F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"[a-z]{{{SHORTEST},{LONGEST}}}"), F.lit(0))).alias("word")
    counts = docs.where(F.col(text).isNotNull()).select(words).groupBy("word").count()
    top = counts.orderBy(F.desc("count"), "word").limit(size).select("word").toArrow()  # ``size`` words at most
    return {w: math.log2(k + 1) for k, w in enumerate(top["word"].to_pylist(), 1)}


@lru_cache(1)
def places() -> dict[str, tuple[float, float]]:
    """Keys on a board whose rows are half a key apart."""
    return {c: (y, x + y / 2) for y, row in enumerate(ROWS) for x, c in enumerate(row)}


@lru_cache(1)
def neighbours() -> dict[str, frozenset[str]]:
    """Keys that touch."""
    at = places()
    return {c: frozenset(d for d, (v, u) in at.items() if d != c and abs(v - y) <= 1 and abs(u - x) <= 1) for c, (y, x) in at.items()}


def turns(walk: str) -> list[int]:
    """How often a walk has changed its direction, up to each of its keys."""
    at, out, last = places(), [0], None
    for a, b in zip(walk, walk[1:]):
        way = (at[b][0] - at[a][0], at[b][1] - at[a][1])
        out.append(out[-1] + (last is not None and way != last))
        last = way
    return out


def pool(value: str) -> float:
    """Bits of one character by brute force: of all classes that the value has."""
    size = 26 * any("a" <= c <= "z" for c in value) + 26 * any("A" <= c <= "Z" for c in value) + 10 * any("0" <= c <= "9" for c in value)
    size += 33 * any(" " <= c <= "~" and not c.isalnum() for c in value) + 100 * any(c > "~" for c in value)
    return math.log2(max(2, size))


def case_bits(word: str) -> float:
    """Bits of a word's capitals: none, one for the first or all, else the ways to choose them."""
    upper = sum(c.isupper() for c in word)
    if not upper:
        return 0.0
    if upper == len(word) or (upper == 1 and word[0].isupper()):
        return 1.0
    return math.log2(math.comb(len(word), upper)) + 1


def walks(lower: str) -> Iterator[tuple[int, int]]:
    """Longest stretches of three or more neighbouring keys."""
    near, begin = neighbours(), 0
    for k in range(1, len(lower) + 1):
        if k == len(lower) or lower[k] not in near.get(lower[k - 1], ()):
            if k - begin >= 3:
                yield begin, k
            begin = k


def guess_bits(value: str, ranks: dict[str, float]) -> float:
    """The least cost of any segmentation of the value: characters by brute force, words,
    dates, walks from the start of a longest stretch, and repeats of what lies up to UNIT before.
    The time is its length times the longest word; nothing of it is cut off."""
    n, each = len(value), pool(value)
    lower = value.lower() if len(value.lower()) == n else value
    plain = lower.translate(FIGURES)
    ends: dict[int, float] = {}  # walks: a stretch's start for each place in it
    start, turned = [n] * (n + 1), [0] * (n + 1)
    for a, b in walks(lower):
        for k, t in zip(range(a + 1, b + 1), turns(lower[a:b])):
            if k >= a + 3:
                start[k], turned[k] = a, t
    dates = [(m.start(), m.end()) for k in range(n) if value[k].isdigit() and (m := DATE.match(value, k))]
    for a, b in dates:
        ends.setdefault(b, a)
    # how far back each place repeats what is ``unit`` before it
    run = [0] * (UNIT + 1)
    cost = [0.0] + [math.inf] * n
    for k in range(1, n + 1):
        best = cost[k - 1] + each  # brute force goes on, character by character
        for size in range(SHORTEST, min(LONGEST, k) + 1):
            a = k - size
            word, figures = lower[a:k], plain[a:k]
            bits = ranks.get(word)
            if bits is None and figures != word and (bits := ranks.get(figures)) is not None:
                bits += 1 + sum(x != y for x, y in zip(word, figures))
            if bits is not None:
                best = min(best, cost[a] + bits + SWITCH + case_bits(value[a:k]))
        if k in ends:
            size = k - ends[k]
            best = min(best, cost[ends[k]] + SWITCH + (math.log2(YEARS) if size <= 4 else math.log2(365 * YEARS) + 2 * (not value[ends[k] : k].isdigit())))
        if start[k] < n:
            size = k - start[k]
            best = min(best, cost[start[k]] + SWITCH + math.log2(36) + math.log2(size) + 1.5 * turned[k])
        for unit in range(1, min(UNIT, k - 1) + 1):
            run[unit] = run[unit] + 1 if value[k - 1] == value[k - 1 - unit] else 0
            if run[unit] >= max(2, unit):
                # the unit costs what it cost where it came first; the rest, how often
                first = k - run[unit]
                best = min(best, cost[first] + SWITCH + math.log2(run[unit] / unit + 1))
        cost[k] = best
    return cost[n]


def find(text: str | None, ranks: dict[str, float], limit: float = GUESS) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, bits) of all secrets of a text, in code points, by start and kind; bits
    are 0 for the base kinds."""
    if not text:
        return []
    found = []
    for kind, (pattern, group, least) in BASE.items():
        for m in (LONG_HEX if kind == "hex" else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((kind, m.start(), m.end(), 0.0))
    held = [(a, b) for _, a, b, _ in found]
    for m in CONTEXT.finditer(text):
        a, b = m.span(1)
        b -= len(m[1]) - len(m[1].rstrip(".:!?"))
        if b - a >= 6 and not any(x <= a and b <= y for x, y in held) and (bits := guess_bits(text[a:b], ranks)) >= limit:
            found.append(("guess", a, b, bits))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def secrets(docs: DataFrame, text: str = "text", limit: float = GUESS, ranks: dict[str, float] | None = None) -> Column:
    """A column of all secrets of a text: structs (kind, start, end, bits). Null and empty texts
    have none; very long ones are read whole; texts that repeat have the same."""
    held = docs.sparkSession.sparkContext.broadcast(dictionary(docs, text) if ranks is None else ranks)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(("kind", "start", "end", "bits"), x)) for x in find(t, held.value, limit)] for t in texts], dtype=object)

    return F.pandas_udf(lean(run), "array<struct<kind:string,start:long,end:long,bits:double>>")(F.col(text))


def op12_secret_scan(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = docs.select("doc_id", secrets(docs).alias("found"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["kind"] != "guess")
    return rows.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined("found").alias("spans"))
