"""Suffix-array dedup by difference-cover blockwise construction.

Bytes covered by a 200-byte string that starts twice or more in the corpus are removed.
Suffixes go to buckets by the gram that anchors their first 200 bytes (see runs.py): only
suffixes of one bucket can be equal so far. A block is some buckets' pieces of text, about
CHUNK bytes of them, and its suffix array is built as follows:

* classes of the 8, 16 and 32 bytes at each place, by doubling;
* first the cover: places whose position modulo 31 is in a difference cover, in the order of
  their suffixes;
* then one bucket of suffixes at a time: a bucket takes the suffixes of some neighbouring
  classes, SORTED at most unless one class has more. They are put in order by class, and
  those that tie in their first 32 bytes by the cover: for any two places i and j there is
  a d < 31 for which i + d and j + d are both in the cover, so their ranks, made
  beforehand, decide, however long the tie is;
* neighbours in that order that have their first 200 bytes in common come twice.

What a task holds is a block's text, its classes and ranks, and one bucket's order. Pieces
that the corpus holds twice or more are there once; all their suffixes come twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, guarded, lean, unpack
from .hashing import byte_values
from .runs import Passages, pair_ranks, ranks, repeated_spans, span_array, windows_to_spans, with_rows, with_spans

WINDOW = 200
GRAM = 40
PERIOD = 31
#: Differences of these take every value modulo 31 (a perfect difference set).
COVER = np.array([1, 5, 11, 24, 25, 27])
HEAD = 32
#: Suffixes that are sorted at a time.
SORTED = 1 << 16


def _shifts() -> np.ndarray:
    """For residues a and b the least d for which a + d and b + d are both in the cover."""
    held = np.zeros(PERIOD, dtype=bool)
    held[COVER] = True
    d = np.arange(PERIOD)
    both = held[(d[:, None, None] + d[None, None, :]) % PERIOD] & held[(d[None, :, None] + d[None, None, :]) % PERIOD]
    return both.argmax(axis=2)


SHIFTS = _shifts()


def byte_symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return byte_values()[np.frombuffer(b"".join(texts), dtype=np.uint8)], np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def cut(text: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    return [text[a:b] for a, b in spans]


class Suffixes:
    """The order of a block's suffixes."""

    def __init__(self, text: np.ndarray):
        # zeros behind the end, for places that look past it
        t = np.concatenate([text, np.zeros(WINDOW + 2 * HEAD, dtype=np.uint8)])
        n = len(t) - 7
        eight = np.zeros(n, dtype=np.uint64)
        for k in range(8):
            eight = (eight << np.uint64(8)) | t[k : n + k].astype(np.uint64)
        c = ranks(eight)
        c = pair_ranks(c[:-8], c[8:])
        #: classes of HEAD bytes, numbered in order
        self.head = pair_ranks(c[:-16], c[16:])
        cover = np.zeros(PERIOD, dtype=bool)
        cover[COVER] = True
        samples = np.flatnonzero(cover[np.arange(len(text) + PERIOD) % PERIOD])
        # by 256 bytes, then by twice as many: eight periods on there is a sample again
        whole = self.head[samples]
        for k in range(HEAD, 8 * HEAD, HEAD):
            whole = pair_ranks(whole, self.head[np.minimum(samples + k, len(self.head) - 1)])
        step = 8 * len(COVER)
        while step < len(samples) and whole.max(initial=0) < len(samples) - 1:
            behind = np.zeros(len(samples), dtype=np.int64)
            behind[: len(samples) - step] = whole[step:] + 1
            whole = pair_ranks(whole, behind)
            step *= 2
        #: ranks of the cover's places, as their suffixes are in order
        self.rank = np.zeros(len(text) + PERIOD, dtype=np.int64)
        self.rank[samples] = whole

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the suffixes at a come before those at b, which begin with the same class."""
        d = SHIFTS[a % PERIOD, b % PERIOD]
        return self.rank[a + d] < self.rank[b + d]

    def ordered(self, places: np.ndarray) -> np.ndarray:
        """One bucket: places in suffix order. Ties of one class are merge-sorted, all classes
        side by side: runs of 1, 2, 4 ... places merge as each place finds its rank in the
        neighbouring run by bisection."""
        places = places[np.argsort(self.head[places])]
        key = self.head[places]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(places)))
        start = np.repeat(first, size)
        count = np.repeat(size, size)
        width = 1
        while width < size.max(initial=0):
            at = np.flatnonzero(count > width)
            index = at - start[at]
            mine = index // width
            low = np.minimum((mine ^ 1) * width, count[at])
            high = np.minimum(low + width, count[at])
            base, left = low.copy(), (mine & 1) == 0
            while len(todo := np.flatnonzero(low < high)):
                mid = (low[todo] + high[todo]) >> 1
                x, y = places[at[todo]], places[start[at[todo]] + mid]
                # equal ones keep their order: the left run's come first
                behind = np.where(left[todo], self.before(y, x), ~self.before(x, y))
                low[todo] = np.where(behind, mid + 1, low[todo])
                high[todo] = np.where(behind, high[todo], mid)
            place = start[at] + (mine >> 1) * (2 * width) + (index - mine * width) + (low - base)
            moved = places[at].copy()
            places[place] = moved
            width *= 2
        return places

    def tied(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the suffixes at a and b have their first 200 bytes in common."""
        same = self.head[a] == self.head[b]
        for k in (WINDOW - HEAD, *range(HEAD, WINDOW - HEAD, HEAD)):
            at = np.flatnonzero(same)
            same[at] = self.head[a[at] + k] == self.head[b[at] + k]
        return same

    def buckets(self, places: np.ndarray) -> Iterator[np.ndarray]:
        """Places in buckets of neighbouring classes. A class of one place has no ties and is
        left out."""
        key = self.head[places]
        size = np.bincount(key)
        places = places[size[key] > 1]
        size[size < 2] = 0
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        bucket = (upto - size) // SORTED  # of a class
        if total <= SORTED:
            yield places
            return
        of = bucket[self.head[places]]
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.unique(of))
        for part in np.split(order, cuts[1:]):
            yield places[part]


def repeated_suffixes(pieces: list[bytes], twice: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (piece, start, end) covered by 200-byte strings that start twice or more: in the
    pieces, or in a piece that comes twice."""
    lengths = np.array([len(p) for p in pieces])
    ends = np.cumsum(lengths)
    begins = ends - lengths
    suffixes = Suffixes(np.frombuffer(b"".join(pieces), dtype=np.uint8))
    counts = np.maximum(lengths - WINDOW + 1, 0)
    owner = np.repeat(np.arange(len(pieces)), counts)
    at = begins[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    held = np.zeros(ends[-1] if len(ends) else 0, dtype=bool)
    held[at[twice[owner]]] = True
    for bucket in suffixes.buckets(at):
        order = suffixes.ordered(bucket)
        same = suffixes.tied(order[:-1], order[1:])
        held[order[:-1][same]] = held[order[1:][same]] = True
    found = held[at]
    return windows_to_spans(owner[found], (at - begins[owner])[found], WINDOW)


PASSAGES = Passages(byte_symbols, WINDOW, GRAM, cut, repeated_suffixes)


@guarded
def spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs, text packed in __packed, with __spans: the repeated byte spans of each text."""
    rows = with_rows(docs, text, key)
    return with_spans(rows, repeated_spans(rows.select("__row", F.col(text).alias("text")), PASSAGES), text)


def without(data: bytes, found: np.ndarray) -> bytes:
    if not len(found):
        return data
    edges = [0, *found.ravel().tolist(), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


@guarded
def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with every repeated passage of 200 bytes or more taken out of the texts, its
    first place included. Where a cut splits a character, its other bytes go too. Null
    texts become empty; texts under 200 bytes stay; rows that repeat lose their texts if
    these have 200 bytes or more; very long texts are searched whole, and a period is one
    row; other columns pass, whatever their names; an empty table stays empty."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for packed, found in batches:
            yield pd.Series([without(unpack(p), span_array(s)).decode("utf-8", "ignore") for p, s in zip(packed, found)], dtype=object)

    out = spans(docs, text, key)
    return out.withColumn(text, F.pandas_udf(lean(run), "string")("__packed", "__spans")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_suffix_dedup(spark, sf_dir) -> DataFrame:
    found = spans(documents(spark, sf_dir).select("doc_id", "text"))

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for packed, found in batches:
            out = []
            for p, s in zip(packed, found):
                data, s = unpack(p), span_array(s)
                out.append((len(data), int((s[:, 1] - s[:, 0]).sum()), len(s), hashlib.sha256(without(data, s)).hexdigest()))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.withColumn("x", F.pandas_udf(lean(run), "n_bytes long, n_removed long, n_spans long, kept_sha256 string")("__packed", "__spans")).select("doc_id", "x.*")
