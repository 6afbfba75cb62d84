"""Runs of windows around shared anchors, for exact search of repeated passages.

A text is a sequence of symbols (bytes or words). Among the grams of a window the one of
least hash is its anchor. Equal windows have equal anchors at equal places, so windows
whose anchor's gram is found nowhere else repeat nowhere. Neighbouring windows with one
anchor form a run; a text has about two runs for each window length, and neighbouring
runs of equal content, as periods make them, are one row. Runs whose gram comes again go to
that gram's bucket; equal contents (by fingerprint) go there once, with a mark that they
repeat. The operators resolve buckets, some of them in a block, by their own methods on
the content itself, and every repeated span comes from there.

A gram with too many contents for one task (a line found in many documents) has its
windows anchored anew, by the two least grams besides it, which part its bucket; what is
still too large is parted again, by the four next. In round LEVELS each window is a bucket of
its own. The buckets of all rounds are resolved together.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import last_table, lean, materialise, packed, scratch, unpack
from .hashing import U, byte_steps, fold, mix64, powers, span_hashes


class Runs(NamedTuple):
    text: np.ndarray  # index of the text
    first: np.ndarray  # first window's start, in symbols of the text
    last: np.ndarray  # last window's start
    anchor: np.ndarray  # place of the anchor's gram
    gram: np.ndarray  # hash of the gram
    content: np.ndarray  # hash of all symbols that the run's windows cover


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, len(a) - width + 1 of them."""
    have = 1
    while have * 2 <= width:
        a = np.minimum(a[:-have], a[have:])
        have *= 2
    return np.minimum(a[: len(a) - (width - have)], a[width - have :]) if width > have else a


def find_runs(values: np.ndarray, at: np.ndarray, window: int, gram: int, used: np.ndarray | None = None) -> Runs:
    """Runs of texts that lie one after the other in values (hashes of symbols); at has
    each text's start and the end of the last. used: for each text the grams (a row each)
    that can't be anchors; a window without another gram is a run, and a gram, of its own."""
    n = len(values)
    empty = np.zeros(0, dtype=np.int64)
    s, e = at[:-1], at[1:]
    long = np.flatnonzero(e - s >= window)
    if not len(long):
        return Runs(empty, empty, empty, empty, empty.view(U), empty.view(U))
    s, e = s[long], e[long]
    up, down = powers(n + 1)
    total = np.zeros(n + 1, dtype=U)
    np.cumsum(values * up[:n], out=total[1:])
    grams = mix64((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    bits = U(int(n).bit_length())
    low = U((1 << int(bits)) - 1)
    chosen = grams
    if used is not None:
        owner = np.searchsorted(at, np.arange(len(grams)), side="right") - 1
        banned = np.zeros(len(grams), dtype=bool)
        for k in range(used.shape[1]):
            banned |= grams == used[owner, k]
        chosen = np.where(banned, ~U(0), grams)
    place = sliding_min((chosen & ~low) | np.arange(len(grams), dtype=U), window - gram + 1) & low
    change = np.flatnonzero(place[1:] != place[:-1]) + 1
    if used is not None:
        alone = banned[place.astype(np.int64)]
        change = np.union1d(change, np.flatnonzero(alone))
    cuts = np.unique(np.concatenate([change, s, e - window + 1]))
    first, last = cuts[:-1], cuts[1:] - 1
    owner = np.searchsorted(s, first, side="right") - 1
    inside = (owner >= 0) & (first <= e[owner] - window)
    first, last, owner = first[inside], last[inside], owner[inside]
    anchor = place[first].astype(np.int64)
    end = last + window
    content = mix64((total[end] - total[first]) * down[first] + (end - first).astype(U))
    key = grams[anchor]
    if used is not None:
        key = np.where(banned[anchor], content, key)
    start = s[owner]
    return Runs(long[owner], first - start, last - start, anchor - start, key, content)


def joined_runs(r: Runs) -> tuple[Runs, np.ndarray]:
    """Neighbouring runs of one text with equal gram and content as one, and how far the
    first window of the last of them is from the first's: 0 for a run that is alone."""
    n = len(r.text)
    if not n:
        return r, r.first
    new = np.ones(n, dtype=bool)
    new[1:] = (r.text[1:] != r.text[:-1]) | (r.gram[1:] != r.gram[:-1]) | (r.content[1:] != r.content[:-1]) | (r.first[1:] != r.last[:-1] + 1)
    at = np.flatnonzero(new)
    return Runs(*(x[at] for x in r)), r.first[np.append(at[1:], n) - 1] - r.first[at]


#: What splits a run of texts into symbols: hashes of all symbols, and where each text's
#: symbols start (one more at the end).
Symbols = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def text_runs(texts: list[str | None], symbols: Symbols, window: int, gram: int) -> Iterator[tuple[int, int, Runs]]:
    """(index of the first text, number of texts, their runs), some texts at a time."""
    for begin, group in byte_steps(texts):
        yield begin, len(group), find_runs(*symbols(group), window, gram)


def with_rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    """docs with __row, a hash of key and text: rows that repeat have the same."""
    return docs.withColumn("__row", F.xxhash64(F.col(f"`{key}`").cast("string"), F.lit(":"), F.col(text)))


class Passages(NamedTuple):
    """How an operator looks for repeated passages."""

    symbols: Symbols
    window: int
    gram: int
    #: (UTF-8 bytes, [(first, end), ...]) -> the contents from symbol first up to end, as bytes
    cut: Callable[[bytes, list[tuple[int, int]]], list[bytes]]
    #: (contents, which of them come twice or more) -> (index of the content, start, end) of
    #: each span of windows that are found twice or more
    resolve: Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


#: Contents of one bucket that a task takes at once.
PART_CONTENTS = 1024
#: Bytes of contents after which a block is closed.
CHUNK = 1 << 18
#: Rounds in which hot grams' windows are anchored anew, by 2, 4 ... grams at once; in the
#: last each window is a bucket of its own.
LEVELS = 3
#: Contents that are anchored anew at once.
ANEW = 256


def repeated_spans(docs: DataFrame, how: Passages) -> DataFrame:
    """Rows (__row, spans) from rows (__row, text): the places, in symbols, that are covered
    by a window which also starts anywhere else in the texts. Spans may overlap."""
    with scratch(docs.sparkSession) as kept:
        spans = materialise(_repeated_spans(docs, how), "spans")
        kept.add(last_table())
    return spans


def _repeated_spans(docs: DataFrame, how: Passages) -> DataFrame:
    window = how.window

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = pdf["__row"].to_numpy()
            for begin, count, r in text_runs(pdf["text"].tolist(), how.symbols, window, how.gram):
                r, reach = joined_runs(r)
                cut = np.searchsorted(r.text, np.arange(count + 1))
                head = np.stack([r.first, r.last, reach], axis=1).astype(np.int32)
                out = []
                for i in range(count):
                    a, b = cut[i], cut[i + 1]
                    if a < b:
                        out.append((ids[begin + i], head[a:b].ravel(), r.gram[a:b].view(np.int64), r.content[a:b].view(np.int64)))
                yield pd.DataFrame(out, columns=["row", "head", "gram", "content"])

    found = materialise(docs.select("__row", "text").mapInPandas(lean(find), "row long, head array<int>, gram array<long>, content array<long>"), "runs")
    place = lambda k: F.col("head")[F.col("p") * 3 + k]
    at = found.select("row", "head", F.posexplode("gram").alias("p", "gram"))
    again = F.count("*") + F.count_if(place(2) > 0) > 1
    # a table of its own: a join of two plain exchanges can be split where a gram is hot
    seen = materialise(at.groupBy("gram").agg(again.alias("again")).where("again").select("gram"), "grams")
    at = found.select("row", "head", F.posexplode(F.arrays_zip("gram", "content")).alias("p", "x"))
    each = at.select("row", place(0).alias("first"), place(1).alias("last"), place(2).alias("reach"), "x.gram", "x.content")
    each = materialise(each.join(seen, "gram"), "repeated")

    # one content of each kind
    kinds = each.groupBy("gram", "content").agg((F.count("*") + F.count_if(F.expr("reach > 0")) > 1).alias("whole"), F.min(F.struct("row", "first", "last")).alias("at"))
    kinds = materialise(kinds.select("gram", "content", "whole", "at.*"), "contents")
    texts = docs.select(F.col("__row").alias("row"), packed(F.col("text")).alias("packed"))
    resolved = _resolved(_pieces(kinds, texts, how), how)
    spans = each.join(resolved, ["gram", "content"]).select("row", (F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("reach") + F.col("end")).alias("end"))
    return spans.groupBy(F.col("row").alias("__row")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))


PIECES = "gram long, content long, whole boolean, used array<long>, piece binary"


def _pieces(kinds: DataFrame, texts: DataFrame, how: Passages) -> DataFrame:
    """The contents of kinds, cut out of the texts: a written table."""
    hot = kinds.groupBy("gram").count().where(F.col("count") > PART_CONTENTS).select("gram", F.lit(True).alias("hot"))
    wanted = kinds.groupBy("row").agg(F.collect_list(F.struct("gram", "content", "whole", "first", "last")).alias("wanted"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for data, wanted in zip(pdf["packed"], pdf["wanted"]):
                pieces = how.cut(unpack(data), [(x["first"], x["last"] + how.window) for x in wanted])
                out += [(x["gram"], x["content"], x["whole"], [x["gram"]], piece) for x, piece in zip(wanted, pieces)]
            yield pd.DataFrame(out, columns=["gram", "content", "whole", "used", "piece"])

    pieces = materialise(texts.join(wanted, "row").select("packed", "wanted").mapInPandas(lean(cut), PIECES), "pieces")
    hot = materialise(hot, "hot")
    return pieces.join(hot, "gram", "left") if not hot.isEmpty() else pieces.withColumn("hot", F.lit(None).cast("boolean"))


def _resolved(pieces: DataFrame, how: Passages) -> DataFrame:
    """Rows (gram, content, start, end): the repeated spans of each content."""
    span = "level int, gram long, content long, start int, end int"

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come bucket by bucket; a block is some buckets, none of them in parts
        held: list[tuple] = []
        size = 0

        def close() -> pd.DataFrame:
            which, start, stop = how.resolve([x[3] for x in held], np.array([x[2] for x in held], dtype=bool))
            level = np.array([x[4] for x in held], dtype=np.int32)[which]
            ids = np.array([x[:2] for x in held], dtype=np.int64)[which]
            held.clear()
            return pd.DataFrame({"level": level, "gram": ids[:, 0], "content": ids[:, 1], "start": start.astype(np.int32), "end": stop.astype(np.int32)})

        for pdf in batches:
            for x in zip(pdf["gram"].tolist(), pdf["content"].tolist(), pdf["whole"].tolist(), pdf["piece"], pdf["level"].tolist()):
                if held and x[:2] == held[-1][:2]:
                    continue  # a document that repeats
                if size > CHUNK and x[0] != held[-1][0]:
                    yield close()
                    size = 0
                held.append(x)
                size += len(x[3])
        if held:
            yield close()

    def anchored(level: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for k in range(0, len(batch), ANEW):
                    yield anew(batch.iloc[k : k + ANEW])

        def anew(pdf: pd.DataFrame) -> pd.DataFrame:
            data = pdf["piece"].tolist()
            values, at = how.symbols(data)
            used = np.array(pdf["used"].tolist(), dtype=np.int64).reshape(len(pdf), -1).view(U)
            key = parents = pdf["gram"].to_numpy().view(U)
            if level < LEVELS:
                text, first = np.arange(len(pdf)), np.zeros(len(pdf), dtype=np.int64)
                for _ in range(1 << level):  # the runs are the next gram's texts
                    r = find_runs(values, at, how.window, how.gram, used)
                    key, used = fold([key[r.text], r.gram]), np.concatenate([used[r.text], r.gram[:, None]], axis=1)
                    text, first = text[r.text], first[r.text] + r.first
                    size = r.last - r.first + how.window
                    begin, at = at[r.text] + r.first, np.concatenate([[0], np.cumsum(size)])
                    values = values[np.repeat(begin - at[:-1], size) + np.arange(at[-1])]
                content, last = r.content, first + size - how.window
            else:  # each window by itself
                text = np.repeat(np.arange(len(pdf)), np.maximum(np.diff(at) - how.window + 1, 0))
                first = last = np.arange(len(text)) - np.searchsorted(text, text)
                content = span_hashes(values)(at[text] + first, at[text] + first + how.window)
                key, used = fold([key[text], content]), np.concatenate([used[text], content[:, None]], axis=1)
            out = {"parent": parents[text].view(np.int64), "of": pdf["content"].to_numpy()[text], "first": first, "gram": key.view(np.int64), "content": content.view(np.int64), "whole": pdf["whole"].to_numpy()[text]}
            cut = [how.cut(d, [(a, b + how.window) for a, b in zip(first[i:j].tolist(), last[i:j].tolist())]) for d, i, j in zip(data, *(np.searchsorted(text, np.arange(len(pdf)) + k) for k in (0, 1)))]
            return pd.DataFrame(out | {"used": list(used.view(np.int64)), "piece": [x for c in cut for x in c]})

        return run

    level, links, cold = 0, [], []
    while True:
        cold.append(pieces.where("hot IS NULL").select(F.lit(level).alias("level"), "gram", "content", "whole", "piece"))
        hot = pieces.where("hot")
        if hot.isEmpty():
            break
        level += 1
        subs = materialise(hot.mapInPandas(lean(anchored(level)), f"parent long, of long, first int, {PIECES}"), "anchored")
        links.append(subs.select("parent", "of", "first", "gram", "content"))
        kinds = subs.groupBy("gram", "content").agg((F.bool_or("whole") | (F.count("*") > 1)).alias("whole"), F.min("used").alias("used"), F.min("piece").alias("piece"))
        kinds = materialise(kinds, "pieces")
        sizes = kinds.groupBy("gram").agg(F.count("*").alias("n"), F.bool_or("whole").alias("any")).where("n > 1 OR any")
        sizes = materialise(sizes.select("gram", F.when(F.col("n") > PART_CONTENTS, True).alias("hot")), "sizes")
        pieces = kinds.join(sizes, "gram")
    blocks = functools.reduce(DataFrame.unionByName, cold).repartition("gram").sortWithinPartitions("gram", "content")
    resolved = materialise(blocks.mapInPandas(lean(resolve), span), "resolved")
    of = lambda level: resolved.where(F.col("level") == level).drop("level")
    spans = of(level)
    while links:
        # spans of the parts are spans of what they are parts of
        level -= 1
        link = links.pop().join(spans, ["gram", "content"])
        up = link.select(F.col("parent").alias("gram"), F.col("of").alias("content"), (F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("end")).alias("end"))
        spans = of(level).unionByName(up)
    return spans


def windows_to_spans(owner: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of windows, given in order: neighbours become one."""
    if not len(owner):
        return owner, at, at
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)
    i = np.flatnonzero(new)
    return owner[i], at[i], at[np.append(i[1:], len(owner)) - 1] + window


def with_spans(docs: DataFrame, spans: DataFrame, text: str) -> DataFrame:
    """docs, with __packed for the text and __spans (null: none). docs have __row."""
    rows = docs.withColumn("__packed", packed(F.col(text))).drop(text)
    return rows.join(spans.select(F.col("__row").alias("__r"), F.col("spans").alias("__spans")), F.col("__row") == F.col("__r"), "left").drop("__r", "__row")


def span_array(spans) -> np.ndarray:
    """Disjoint spans, in order, of a value of the column __spans."""
    if spans is None:
        return np.zeros((0, 2), dtype=np.int64)
    return union(np.array([(x["start"], x["end"]) for x in spans], dtype=np.int64).reshape(-1, 2))


def union(spans: np.ndarray) -> np.ndarray:
    """Disjoint, not touching spans that cover the same places."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), dtype=bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    at = np.flatnonzero(new)
    return np.stack([spans[at, 0], reach[np.append(at[1:], len(spans)) - 1]], axis=1)


def ranks(values: np.ndarray) -> np.ndarray:
    """The class of each value, numbered in order."""
    order = np.argsort(values)
    s = values[order]
    new = np.zeros(len(s), dtype=np.int64)
    new[1:] = s[1:] != s[:-1]
    out = np.empty(len(s), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def pair_ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The class of each pair of classes, numbered in order."""
    return ranks(a * (int(b.max(initial=0)) + 1) + b)
