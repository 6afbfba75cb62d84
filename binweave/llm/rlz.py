"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

Words covered by a window of 35 words that starts twice or more in the corpus are removed.
Reference blocks are keyed by the word gram that anchors a window (see runs.py), so a document
meets every block that shares one of its windows, and no other. A block holds the pieces of
documents around its grams, each different piece once, and indexes them: a suffix array
over words with classes of phrases of 1, 2, 4 ... words, by which the longest phrase that
starts at a place and also elsewhere in the block is found.

Each piece is parsed from left to right: a factor is the longest phrase at its place that
the block holds elsewhere, and the next starts behind it. Factors of 35 words or more are
duplicate spans. A window that isn't inside one factor straddles a factor's boundary; these
windows are looked up by themselves, and are duplicate spans if the block holds them
elsewhere. So a word goes if and only if a window that repeats covers it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, guarded, lean, unpack
from .hashing import word_hashes
from .runs import Passages, pair_ranks, ranks, repeated_spans, span_array, windows_to_spans, with_rows, with_spans

WINDOW = 35
GRAM = 6


def cut(text: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    words = text.split()
    return [b" ".join(words[a:b]) for a, b in spans]


class Block:
    """The index of a reference block: pieces one after the other, each closed by a symbol of
    its own, so that no phrase crosses an end and all suffixes differ."""

    def __init__(self, pieces: list[bytes], twice: np.ndarray):
        w, at = word_hashes(pieces)
        n, lengths = len(pieces), np.diff(at)
        self.starts = at[:-1] + np.arange(n)
        self.ends = self.starts + lengths
        symbols = np.empty(len(w) + n, dtype=np.int64)
        inside = np.ones(len(symbols), dtype=bool)
        inside[self.ends] = False
        symbols[inside] = ranks(w)
        symbols[self.ends] = len(w) + np.arange(n)
        #: which pieces the corpus holds twice or more: the whole of such a piece is elsewhere
        self.twice = twice
        #: classes of phrases of 2 ** k symbols, until all suffixes differ
        self.classes = [ranks(symbols)]
        while self.classes[-1].max(initial=0) < len(symbols) - 1:
            c, k = self.classes[-1], 1 << (len(self.classes) - 1)
            behind = np.zeros(len(c), dtype=np.int64)
            behind[:-k] = c[k:] + 1
            self.classes.append(pair_ranks(c, behind))
        self.rank = self.classes[-1]
        self.order = np.argsort(self.rank)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at a and b have in common."""
        n, length = len(self.rank), np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.classes) - 1, -1, -1):
            x, y = a + length, b + length
            inside = (x < n) & (y < n)
            same = np.zeros(len(a), dtype=bool)
            same[inside] = self.classes[k][x[inside]] == self.classes[k][y[inside]]
            length[same] += 1 << k
        return length

    def longest(self, at: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """The length of the longest phrase that starts at each place and also elsewhere."""
        r, last = self.rank[at], len(self.order) - 1
        before = np.where(r > 0, self.common(at, self.order[np.maximum(r - 1, 0)]), 0)
        after = np.where(r < last, self.common(at, self.order[np.minimum(r + 1, last)]), 0)
        return np.maximum(np.maximum(before, after), np.where(self.twice[piece], self.ends[piece] - at, 0))

    def factors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, start, end) of all factors of the greedy parse, pieces side by side."""
        piece, at = np.arange(len(self.starts)), self.starts.copy()
        out = []
        while len(piece := piece[at[piece] < self.ends[piece]]):
            length = np.maximum(self.longest(at[piece], piece), 1)
            out.append((piece, at[piece], at[piece] + length))
            at[piece] += length
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (piece, piece, piece)


def parse(pieces: list[bytes], twice: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Duplicate spans (piece, start, end), in words, of a block's pieces."""
    block = Block(pieces, twice)
    piece, start, end = block.factors()
    long = end - start >= WINDOW
    # windows inside long factors, as a difference array; all others straddle a boundary
    steps = np.zeros(len(block.rank) + 1, dtype=np.int64)
    np.add.at(steps, start[long], 1)
    np.add.at(steps, end[long] - WINDOW + 1, -1)
    held = np.cumsum(steps)[:-1] > 0
    owner = np.repeat(np.arange(len(pieces)), block.ends - block.starts + 1)
    at = np.flatnonzero(~held & (np.arange(len(owner)) + WINDOW <= block.ends[owner]))
    held[at[block.longest(at, owner[at]) >= WINDOW]] = True
    at = np.flatnonzero(held)
    return windows_to_spans(owner[at], at - block.starts[owner[at]], WINDOW)


PASSAGES = Passages(word_hashes, WINDOW, GRAM, cut, parse)


@guarded
def spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs, text packed in __packed, with __spans: the repeated word spans of each text."""
    rows = with_rows(docs, text, key)
    return with_spans(rows, repeated_spans(rows.select("__row", F.col(text).alias("text")), PASSAGES), text)


def kept_words(words: list[bytes], found: np.ndarray) -> list[bytes]:
    edges = [0, *found.ravel().tolist(), len(words)]
    return [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]


@guarded
def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with every repeated passage of 35 words or more taken out of the texts, its
    first place included; what stays of such a text is joined by single spaces, other texts
    stay as they are. Null texts become empty; rows that repeat lose their texts if these
    have 35 words; very long texts are searched whole, and a period is one row; other
    columns pass, whatever their names; an empty table stays empty."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for packed, found in batches:
            out = []
            for p, s in zip(packed, found):
                data, s = unpack(p), span_array(s)
                out.append((b" ".join(kept_words(data.split(), s)) if len(s) else data).decode())
            yield pd.Series(out, dtype=object)

    out = spans(docs, text, key)
    return out.withColumn(text, F.pandas_udf(lean(run), "string")("__packed", "__spans")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_rlz_dedup(spark, sf_dir) -> DataFrame:
    found = spans(documents(spark, sf_dir).select("doc_id", "text"))

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for packed, found in batches:
            out = []
            for p, s in zip(packed, found):
                words, s = unpack(p).split(), span_array(s)
                out.append((len(words), int((s[:, 1] - s[:, 0]).sum()), hashlib.sha256(b" ".join(kept_words(words, s))).hexdigest()))
            yield pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256"])

    return found.withColumn("x", F.pandas_udf(lean(run), "n_words long, n_removed long, kept_sha256 string")("__packed", "__spans")).select("doc_id", "x.*")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, unnest(range(1, len(ws) - 33)) AS p, ws FROM d WHERE len(ws) >= 35),
h AS (SELECT r, p, md5(array_to_string(ws[p:p + 34], ' ')) AS m FROM w),
g AS (SELECT m FROM h GROUP BY m HAVING count(*) > 1),
k AS (SELECT DISTINCT r, p + o AS p FROM h JOIN g USING (m), range(0, 35) t(o)),
x AS (SELECT r, doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
y AS (SELECT x.r, string_agg(w, ' ' ORDER BY x.p) FILTER (WHERE k.p IS NULL) AS kept, count(k.p) AS gone FROM x LEFT JOIN k ON k.r = x.r AND k.p = x.p GROUP BY x.r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN y ON y.r = d.r
"""
