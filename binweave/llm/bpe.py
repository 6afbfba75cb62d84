"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts of a batch are laid out as one array of code points. A table maps code points to
classes; together with two code points of look-ahead a class becomes one of ten symbols,
and each symbol is a function on the eight states of the pre-tokeniser. Functions compose
associatively, so an inclusive scan by doubling gives the state at every position: the
finite monoid of the functions is enumerated once, a composition is one table look-up for
the whole array, and the scan ends as soon as every prefix is a constant function (after
two or three doublings). Boundaries follow from state and symbol; no regular expression
runs over text.

The slices between boundaries are merged by rank, each distinct slice once per cache.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, lean, small_batches

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bytes, about, of slices and merges that a worker keeps, twice: a full generation becomes
#: the old one, and what is used again moves to the new one.
CACHE = 8 << 20
#: Bytes of a cached slice and its ids besides its characters and 8 for each id.
ENTRY = 250
#: Code points that one vectorised step takes. Longer texts are cut in front of a single space
#: between other characters, which always starts a slice.
STEP = 1 << 19

# classes of code points
LETTER, NUMBER, OTHER, SPACE, BLANK, QUOTE, BREAK = range(7)
# symbols: a class with its look-ahead
JOINER, LONE, INNER, SHORT, LONG, END = 3, 4, 5, 6, 7, 8  # and 0 letter, 1 number, 2 other
# states: within letters, numbers, others; after a joining space; in white space; closed; one or two code points left of a contraction
IN_L, IN_N, IN_O, JOIN, WHITE, CLOSED, ONE, TWO = range(8)

#: White space of the pattern: fixed values (the Unicode property White_Space).
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BLANKS = frozenset(map(chr, WHITE_SPACE))


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a slice starts at this code point."""
    if symbol == END:
        return CLOSED, True
    if state == TWO:
        return ONE, False
    if state == ONE:
        return CLOSED, False
    if symbol in (0, 1, 2):
        return symbol, not (state == symbol or state == JOIN)
    if symbol in (SHORT, LONG):
        if state in (JOIN, IN_O):
            return IN_O, False
        return (ONE if symbol == SHORT else TWO), True
    if symbol == JOINER:
        return JOIN, True
    if symbol == LONE:
        return CLOSED, True
    return WHITE, state != WHITE


@lru_cache(1)
def _tables():
    kind = np.full(0x110001, OTHER, dtype=np.uint8)
    for c in range(0x110000):
        g = unicodedata.category(chr(c))[0]
        if g == "L":
            kind[c] = LETTER
        elif g == "N":
            kind[c] = NUMBER
    kind[WHITE_SPACE] = BLANK
    kind[0x20] = SPACE
    kind[0x27] = QUOTE
    kind[0x110000] = BREAK
    # the monoid: functions on the states, closed under composition
    functions = [tuple(_step(s, a)[0] for s in range(8)) for a in range(9)]
    known = {}
    for f in functions:
        known.setdefault(f, len(known))
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in functions:
            if (h := tuple(g[x] for x in f)) not in known:
                known[h] = len(known)
                todo.append(h)
    ordered = list(known)
    after = np.array([[known[tuple(g[x] for x in f)] for g in ordered] for f in ordered], dtype=np.uint16)
    of_symbol = np.array([known[f] for f in functions], dtype=np.uint16)
    constant = np.array([len(set(f)) == 1 for f in ordered])
    value = np.array([f[CLOSED] for f in ordered], dtype=np.uint8)
    starts = np.array([[_step(s, a)[1] for a in range(9)] for s in range(8)]).ravel()
    return kind, after.ravel(), len(ordered), of_symbol, constant, value, starts


def boundaries(points: np.ndarray) -> np.ndarray:
    """Positions at which slices start, in an array of code points in which texts are
    separated by 0x110000; each separator is a slice of its own."""
    kind, after, m, of_symbol, constant, value, starts = _tables()
    c = kind[points]
    n = len(c)
    nxt = np.full(n, BREAK, dtype=np.uint8)
    nxt[:-1] = c[1:]
    symbol = c.copy()
    solid = (nxt <= OTHER) | (nxt == QUOTE)
    white = (c == SPACE) | (c == BLANK)
    symbol[white] = INNER
    symbol[(c == SPACE) & solid] = JOINER
    symbol[(c == BLANK) & solid] = LONE
    symbol[c == QUOTE] = OTHER
    symbol[c == BREAK] = END
    quotes = np.flatnonzero(c == QUOTE)
    if len(quotes):
        at = lambda k: np.where(quotes + k < n, points[np.minimum(quotes + k, n - 1)], 0)
        a, b = at(1), at(2)
        symbol[quotes[np.isin(a, [ord(x) for x in "std" "m"])]] = SHORT
        pair = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        symbol[quotes[pair]] = LONG
    scan = of_symbol[symbol]
    reach = 1
    while reach < n and not constant[scan].all():
        scan[reach:] = after[scan[:-reach].astype(np.int32) * m + scan[reach:]]
        if reach >= 8 and constant[scan[reach:]].all():
            break  # what is not constant starts the array: it begins closed
        reach *= 2
    before = np.empty(n, dtype=np.uint8)
    before[0] = CLOSED
    before[1:] = value[scan[:-1]]
    return np.flatnonzero(starts[before.astype(np.int32) * 9 + symbol])


def parts(text: str) -> Iterator[str]:
    """A text in parts of about STEP code points whose slices are the text's. Where a stretch
    has no place to cut, the part is longer."""
    begin = 0
    while len(text) - begin > STEP:
        at = text.find(" ", begin + STEP)
        while at >= 0 and (at + 1 >= len(text) or text[at - 1] in BLANKS or text[at + 1] in BLANKS):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        yield text[begin:at]
        begin = at
    yield text[begin:] if begin else text


def slices(texts: Iterable[str]) -> Iterator[tuple[list[str], list[tuple[int, int, int]]]]:
    """For some texts, or parts of long ones, at a time: all their slices, and (text, start,
    end) for each part's slices. A text's slices put together are the text."""
    group, owner, length = [], [], 0
    for i, t in enumerate(texts):
        for part in parts(t):
            group.append(part)
            owner.append(i)
            length += len(part)
            if length >= STEP:
                found, at = _slices(group)
                yield found, list(zip(owner, at, at[1:]))
                group, owner, length = [], [], 0
    if group:
        found, at = _slices(group)
        yield found, list(zip(owner, at, at[1:]))


def _slices(texts: list[str]) -> tuple[list[str], list[int]]:
    # surrogates can't come from Spark; a separator goes in front of each text
    lengths = np.array([len(t) for t in texts])
    joined = "\0".join(["", *texts])
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).copy()
    breaks = np.concatenate([[0], np.cumsum(lengths[:-1] + 1)])
    points[breaks] = 0x110000
    at = boundaries(points)
    ends = np.append(at[1:], len(points))
    own = np.ones(len(at), dtype=bool)
    own[first := np.searchsorted(at, breaks)] = False  # separators
    pieces = [joined[a:b] for a, b in zip(at[own].tolist(), ends[own].tolist())]
    return pieces, [*(first - np.arange(len(texts))).tolist(), len(pieces)]


def merge(piece: bytes, vocabulary: Vocabulary) -> tuple[int, ...]:
    """Merge neighbours of lowest rank, leftmost first, until no pair has a rank. Ids are
    ranks: what a pair merges to is its rank."""
    if (whole := vocabulary.ranks.get(piece)) is not None:
        return (whole,)
    ids = [*map(vocabulary.of_byte.__getitem__, piece)]
    if len(ids) > 200:
        return _merge_long(ids, vocabulary.pairs)
    get = vocabulary.pairs.get
    pairs = [get(a << 17 | b, NONE) for a, b in zip(ids, ids[1:])]
    while pairs:
        low = min(pairs)
        if low == NONE:
            break
        i = pairs.index(low)
        ids[i] = low
        del ids[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(low << 17 | ids[i + 1], NONE)
        if i:
            pairs[i - 1] = get(ids[i - 1] << 17 | low, NONE)
    return tuple(ids)


def _merge_long(ids: list[int], pairs: dict[int, int]) -> tuple[int, ...]:
    """The same with a heap and links, for slices such as thousands of equal signs."""
    n = len(ids)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get(ids[i] << 17 | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        merged, i, a, b = heapq.heappop(heap)
        j = right[i]
        if ids[i] != a or j < 0 or ids[j] != b:
            continue
        ids[i], ids[j] = merged, -1
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for x, y in ((left[i], i), (i, right[i])):
            if x >= 0 and y >= 0 and (r := pairs.get(ids[x] << 17 | ids[y])) is not None:
                heapq.heappush(heap, (r, x, ids[x], ids[y]))
    return tuple(i for i in ids if i >= 0)


NONE = 1 << 60
#: Longest slices, in bytes, that are merged many at a time.
SHORT_SLICE = 32
FREE = np.int32(2**31 - 1)


class PairTable:
    """Ranks of pairs of ids as an open-addressing table, for arrays of pairs."""

    def __init__(self, pairs: dict[int, int]):
        size = 1 << max(4, (4 * len(pairs)).bit_length())
        self.mask = np.int64(size - 1)
        self.keys, self.ranks = np.full(size, -1, dtype=np.int64), np.full(size, FREE, dtype=np.int32)
        keys, ranks = np.fromiter(pairs, dtype=np.int64, count=len(pairs)), np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))
        at = self.place(keys)
        while len(keys):
            # of those that want one free place, one gets it
            place, first = np.unique(at, return_index=True)
            first = first[self.keys[place] == -1]
            self.keys[at[first]], self.ranks[at[first]] = keys[first], ranks[first]
            rest = np.ones(len(keys), dtype=bool)
            rest[first] = False
            keys, ranks, at = keys[rest], ranks[rest], (at[rest] + 1) & self.mask

    def place(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.int64(-7046029254386353131) >> np.int64(20)) & self.mask

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (a, b); FREE where they have none."""
        keys = a.astype(np.int64) << 17 | b
        at = self.place(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], FREE)
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out


def merge_many(slices: list[bytes], vocabulary: Vocabulary) -> list[tuple[int, ...]]:
    """merge() of many slices: each round merges one pair of every slice that has one left."""
    out: list[tuple[int, ...] | None] = [None] * len(slices)
    by_length: dict[int, list[int]] = {}
    for k, s in enumerate(slices):
        if (whole := vocabulary.ranks.get(s)) is not None:
            out[k] = (whole,)
        elif len(s) > SHORT_SLICE:
            out[k] = merge(s, vocabulary)
        else:
            by_length.setdefault(len(s), []).append(k)
    of_byte, find = np.array(vocabulary.of_byte, dtype=np.int32), vocabulary.table.find
    for length, chosen in by_length.items():
        ids = of_byte[np.frombuffer(b"".join(slices[k] for k in chosen), dtype=np.uint8).reshape(-1, length)]
        ranks = find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(-1, length - 1)
        owner = np.array(chosen)
        for n in range(length, 0, -1):
            # all slices here have n ids and n - 1 pairs
            at = ranks.argmin(axis=1) if n > 1 else np.zeros(len(ids), dtype=np.int64)
            low = ranks[np.arange(len(ids)), at] if n > 1 else np.full(len(ids), FREE)
            done = low == FREE
            for k, row in zip(owner[done].tolist(), ids[done].tolist()):
                out[k] = tuple(row)
            if done.all():
                break
            ids, ranks, owner, at, low = ids[~done], ranks[~done], owner[~done], at[~done], low[~done]
            row = np.arange(len(ids))
            ids[row, at] = low
            keep = np.ones(ids.shape, dtype=bool)
            keep[row, at + 1] = False
            ids = ids[keep].reshape(-1, n - 1)
            keep = np.ones(ranks.shape, dtype=bool)
            keep[row, at] = False
            ranks = ranks[keep].reshape(-1, n - 2)
            right = np.flatnonzero(at < n - 2)
            ranks[right, at[right]] = find(ids[right, at[right]], ids[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = find(ids[left, at[left] - 1], ids[left, at[left]])
    return out


class Vocabulary:
    """Ranks of byte strings, and of pairs of ranks: the rank of what they merge to."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.of_byte = [self.ranks[bytes([b])] for b in range(256)]
        get = self.ranks.get
        self.pairs = {a << 17 | b: i for t, i in self.ranks.items() for k in range(1, len(t)) if (a := get(t[:k])) is not None and (b := get(t[k:])) is not None}
        self.table = PairTable(self.pairs)


class Encoder:
    def __init__(self, path: str):
        self.vocabulary = v = Vocabulary(path)
        self.ranks, self.bytes_of, self.text_of = v.ranks, v.bytes_of, v.text_of
        self.cache: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.held = 0
        self.own = dict(zip(v.bytes_of, v.bytes_of))  # one object for each id

    def _learn(self, pieces: list[str]) -> None:
        """Puts all pieces into the cache."""
        if self.held > CACHE:
            self.old, self.cache, self.held = self.cache, {}, 0
        cache, old, new, own = self.cache, self.old, [], self.own.__getitem__
        for p in set(pieces).difference(cache):
            if p in old:
                cache[p] = old[p]
                self.held += ENTRY + len(p) + 8 * len(cache[p])
            else:
                new.append(p)
        for p, ids in zip(new, merge_many([p.encode() for p in new], self.vocabulary)):
            cache[p] = tuple(map(own, ids))
            self.held += ENTRY + len(p) + 8 * len(ids)

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text."""
        ids: list[int] = []
        now = 0
        for pieces, spans in slices(texts):
            self._learn(pieces)
            cache = self.cache
            for i, a, b in spans:
                while now < i:
                    yield ids
                    ids, now = [], now + 1
                ids.extend(itertools.chain.from_iterable(map(cache.__getitem__, pieces[a:b])))
        for _ in range(now, len(texts)):
            yield ids
            ids = []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """A worker's encoder: its cache lasts from task to task."""
    return Encoder(path)


def default_path() -> str:
    """The vocabulary's place on this machine; asked for on the executor that reads it."""
    import public_tokenizers

    return public_tokenizers.path(RANKS)


def encode(docs: DataFrame, text: str = "text", path: str | None = None, out: str = "ids", offsets: str | None = "offsets") -> DataFrame:
    """docs with an array column of token ids and, unless None, one of the byte offsets at
    which each token ends in the text's UTF-8 form. Null and empty texts have no tokens;
    very long ones are encoded whole, part by part; rows that repeat are encoded alike;
    columns of docs with these names are replaced; an empty table stays empty."""

    small_batches(docs.sparkSession)
    kind = "struct<ids:array<int>,offsets:array<int>>" if offsets else "struct<ids:array<int>>"

    @F.pandas_udf(kind)
    @lean
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = encoder(path or default_path())
        length = np.zeros(max(coder.bytes_of) + 1, dtype=np.int32)
        length[list(coder.bytes_of)] = [len(b) for b in coder.bytes_of.values()]

        def close(rows: list[np.ndarray]) -> pd.DataFrame:
            found = pd.DataFrame({"ids": rows})
            if offsets:
                found["offsets"] = [np.cumsum(length[i], dtype=np.int32) for i in rows]
            return found

        for texts in batches:
            # rows go back as soon as they hold a step's ids
            rows, size = [], 0
            for ids in coder.encode([t or "" for t in texts]):
                rows.append(np.array(ids, dtype=np.int32))
                size += len(ids)
                if size >= STEP:
                    yield close(rows)
                    rows, size = [], 0
            if rows:
                yield close(rows)

    coded = docs.withColumn("__bpe", run(F.col(text))).withColumn(out, F.col("__bpe.ids"))
    if offsets:
        coded = coded.withColumn(offsets, F.col("__bpe.offsets"))
    return coded.drop("__bpe")


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None, out: str = "decoded") -> DataFrame:
    """rows with the bytes that the ids stand for; null ids give null."""

    @F.pandas_udf("binary")
    @lean
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = encoder(path or default_path())
        for x in batches:
            yield pd.Series([None if i is None else coder.decode(i.tolist()) for i in x], dtype=object)

    return rows.withColumn(out, run(F.col(ids)))


def digest(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """docs with a struct __bpe: n_tokens, ids_sha256, decoded_sha256 (of the bytes that
    the ids decode to), without sending ids and bytes through Spark. Null is empty."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    @lean
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = encoder(path or default_path())
        as_text = coder.text_of.__getitem__
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for texts in batches:
            rows = [(len(ids), sha(",".join(map(as_text, ids)).encode()), sha(coder.decode(ids))) for ids in coder.encode([t or "" for t in texts])]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.withColumn("__bpe", run(F.col(text)))


def op5_bpe(spark, sf_dir) -> DataFrame:
    return digest(documents(spark, sf_dir)).select("doc_id", "__bpe.*")
