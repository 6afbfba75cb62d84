"""N-gram Jaccard join: grouped prefix join and its connected components.

A document is the set of its distinct 5-word shingles, each a 64-bit hash. Shingles are
put in one global order: those found in many documents last, by frequency, the others by
hash. Two sets of Jaccard similarity t or more share one of the first
``n - ceil(t * n) + 1`` shingles (their prefixes). Documents with identical prefixes and
size form one group; postings of prefix shingles hold groups, pairs of groups are ruled out as
they meet, and only those that pass are expanded to members, which are verified by whole sets.

Groups of a large posting are not all paired with each other. In rounds, each posting picks
hubs, one and then GROWTH times as many, from its smaller components, and its groups of other
components whose size, places and bitmaps allow it are verified against them. Links merge
components; pairs within a component need no check, as they can't change it, and a hub
leaves its posting, as all its pairs there are done. It ends when no posting joins two
components, or when the pairs left are no more than a fixed multiple of the rows; these are
verified too, so no link between components is lost. Small postings, of which nearly all
are, give their pairs of groups at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, guarded, last_table, lean, materialise, packed, scratch, unpack
from .graph import components
from .hashing import BASE, U, byte_steps, fold, mix64, word_hashes

WORDS = 5
PERCENT = 80
#: A shingle that this many documents hold, as far as blocks of documents show, goes last.
FREQUENT = 32
#: Shingles at most that are ordered by frequency: the bound of what is broadcast (16 MB).
MOST_FREQUENT = 1 << 20
#: Shingles of a block of documents within which repeated ones are counted (8 MB).
BLOCK = 1 << 20

def shingle_sets(texts: list[str | None], words: int = WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of texts: sorted distinct shingle hashes, text after text, and each
    text's start in them (one more at the end)."""
    for _, group in byte_steps(texts):
        yield _sets([t.lower() for t in group], words)


def _sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    w, at = word_hashes(texts)
    counts = np.diff(at)
    text = np.repeat(np.arange(len(texts)), counts)
    hashes, owner = [], []
    if len(w) >= words:
        n = len(w) - words + 1
        inside = text[:n] == text[words - 1 :]
        hashes.append(fold([w[k : n + k] for k in range(words)])[inside])
        owner.append(text[:n][inside])
    for k in range(1, words):
        if len(short := np.flatnonzero(counts == k)):
            hashes.append(fold([w[at[short] + j] for j in range(k)]))
            owner.append(short)
    h = np.concatenate(hashes) if hashes else np.zeros(0, dtype=U)
    o = np.concatenate(owner) if owner else np.zeros(0, dtype=np.int64)
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(o[order], kind="stable")]
    h, o = h[order], o[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[new], o[new]
    return h, np.searchsorted(o, np.arange(len(texts) + 1))


def frequent_shingles(docs: DataFrame, text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, sorted, that many documents hold, and their rank by frequency. Counts are
    of shingles repeated within a block of documents. At most MOST_FREQUENT come back."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # one buffer, sorted in place: a worker holds it and what repeats in it
        held, size = np.empty(BLOCK, dtype=U), 0

        def close() -> pd.DataFrame:
            block = held[:size]
            block.sort()
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            n = np.diff(np.append(first, size))
            return pd.DataFrame({"token": block[first[n > 1]].view(np.int64), "n": n[n > 1]})

        for pdf in batches:
            for h, _ in shingle_sets(pdf["text"].tolist(), words):
                while len(h):
                    part, h = h[: BLOCK - size], h[BLOCK - size :]
                    held[size : size + len(part)] = part
                    size += len(part)
                    if size == BLOCK:
                        yield close()
                        size = 0
        if size:
            yield close()

    counts = docs.select(F.col(text).alias("text")).mapInPandas(lean(count), "token long, n long")
    counts = counts.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    top = counts.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).toArrow()
    tokens, n = top["token"].to_numpy().view(U), top["n"].to_numpy()
    order = np.argsort(tokens)
    return tokens[order], n[order]


def signatures(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: key, n_shingles, node (a hash of the whole set), grp (a hash of
    prefix and size), the prefix and a bitmap of the set, or of the prefix of one of more than
    WHOLE shingles (WORDS_OF_MAP longs, and in one more how many of the shingles fell on a bit
    that another one had). Null and empty texts have n_shingles 0 and no prefix."""
    held = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, text, words))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, counts = held.value
        for pdf in batches:
            sizes, nodes, groups, prefixes, maps = [], [], [], [], []
            for h, at in shingle_sets(pdf["text"].tolist(), words):
                n = np.diff(at)
                owner = np.repeat(np.arange(len(n)), n)
                rank = np.zeros(len(h), dtype=np.int64)
                if len(tokens) and len(h):
                    place = np.minimum(np.searchsorted(tokens, h), len(tokens) - 1)
                    rank = np.where(tokens[place] == h, counts[place], 0)
                if rank.any():
                    # texts with frequent shingles: those go last
                    order = np.lexsort((h, rank, owner))
                    h = h[order]
                p = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
                whole = np.zeros(len(h) + 1, dtype=U)
                np.cumsum(mix64(h ^ U(0x5851F42D4C957F2D)), out=whole[1:])
                ends = at[:-1] + p
                sizes.append(n)
                nodes.append(mix64(whole[at[1:]] - whole[at[:-1]] + n.astype(U)))
                groups.append(mix64((whole[ends] - whole[at[:-1]]) * BASE + n.astype(U)))
                signed = h.view(np.int64)
                prefixes += [signed[a:b] for a, b in zip(at[:-1].tolist(), ends.tolist())]
                maps += list(_bitmaps(h, at, np.where(n <= WHOLE, n, p)))
            if sizes:
                yield pd.DataFrame(
                    {
                        "key": pdf["key"],
                        "row": pdf["row"],
                        "n": np.concatenate(sizes),
                        "node": np.concatenate(nodes).view(np.int64),
                        "grp": np.concatenate(groups).view(np.int64),
                        "prefix": prefixes,
                        "map": maps,
                    }
                )

    rows = docs.select(F.col(f"`{key}`").alias("key"), row_hash(F.col(f"`{key}`"), F.col(text)).alias("row"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = materialise(rows.mapInPandas(lean(run), f"key {kind}, row long, n long, node long, grp long, prefix array<long>, map array<long>"), "signatures")
    held.destroy()
    return out


#: Longs of a bitmap.
WORDS_OF_MAP = 16
#: Shingles of a set up to which its bitmap is of all of them; larger ones' is of the prefix.
WHOLE = 64 * WORDS_OF_MAP


def _bitmaps(h: np.ndarray, at: np.ndarray, p: np.ndarray) -> np.ndarray:
    """A row for each text: the bitmap of its first p shingles, and p less the bits it has."""
    owner = np.repeat(np.arange(len(p)), p)
    first = np.repeat(at[:-1] - (np.cumsum(p) - p), p) + np.arange(len(owner))
    bit = h[first] & U(64 * WORDS_OF_MAP - 1)
    out = np.zeros((len(p), WORDS_OF_MAP + 1), dtype=U)
    np.bitwise_or.at(out, (owner, (bit >> U(6)).astype(np.int64)), U(1) << (bit & U(63)))
    held = np.unique(owner * (64 * WORDS_OF_MAP) + bit.astype(np.int64)) // (64 * WORDS_OF_MAP)
    out[:, -1] = (p - np.bincount(held, minlength=len(p))).astype(U)
    return out.view(np.int64)


def row_hash(key: Column, text: Column) -> Column:
    return F.xxhash64(key.cast("string"), F.lit(":"), text)


def whole_sets(docs: DataFrame, wanted: DataFrame, text: str, key: str, words: int, hint: str | None = None) -> DataFrame:
    """Rows (node, shingles) for wanted (row, node): the documents of these hashes of key and
    text, if their sets are the nodes'. Texts are packed for a shuffle; where wanted is sent to
    the texts there is none, and packing would give each task a second Python worker."""
    stay = hint == "broadcast"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            nodes, sets = [], []
            asked = pdf["node"].to_numpy().view(U)
            for h, at in shingle_sets(pdf["text"].tolist() if stay else [unpack(p).decode() for p in pdf["text"]], words):
                n = np.diff(at).astype(U)
                whole = np.zeros(len(h) + 1, dtype=U)
                np.cumsum(mix64(h ^ U(0x5851F42D4C957F2D)), out=whole[1:])
                found = mix64(whole[at[1:]] - whole[at[:-1]] + n)
                same = found == asked[len(nodes) : len(nodes) + len(found)]
                nodes += found.tolist()
                sets += [h[a:b].view(np.int64) if s else None for a, b, s in zip(at[:-1].tolist(), at[1:].tolist(), same.tolist())]
            out = pd.DataFrame({"node": np.array(nodes, dtype=U).view(np.int64), "shingles": sets})
            yield out[out["shingles"].notna()]

    # by a hash of key and text, of which no two different texts of one key have the same
    rows = docs.select(row_hash(F.col(f"`{key}`"), F.col(text)).alias("row"), (F.col(text) if stay else packed(F.col(text))).alias("text"))
    rows = rows.join(wanted.hint(hint) if hint else wanted, "row").select("text", "node")
    return rows.mapInPandas(lean(run), "node long, shingles array<long>")


#: Bits of the map of shingles that come twice: what is sent to all executors has this size.
BITS = 1 << 26


def shared_tokens(sig: DataFrame) -> DataFrame:
    """Rows (token, grp, n, place) of prefix shingles, without those that one document alone has
    in its prefix, as far as a bitmap of fixed size tells. Counting takes 31 bits of each
    shingle; where the bitmap fills up, more rows stay and none is lost."""
    each = sig.select(F.explode("prefix").alias("token")).select(F.col("token").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("low"))
    twice = each.groupBy("low").count().where("count > 1")
    bit = F.col("low").bitwiseAND(F.lit(BITS - 1))
    words = twice.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(low & 63 AS INT))")).alias("bits"))
    table = words.toArrow()
    bitmap = np.zeros(BITS // 64, dtype=U)
    bitmap[table["word"].to_numpy()] = table["bits"].to_numpy().view(U)
    held = sig.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            count = pdf["prefix"].map(len).to_numpy()
            token = np.concatenate(pdf["prefix"].to_numpy()).astype(np.int64) if count.sum() else np.zeros(0, dtype=np.int64)
            at = token.view(U) & U(BITS - 1)
            keep = (held.value[at >> U(6)] >> (at & U(63))) & U(1) == 1
            row = np.repeat(np.arange(len(pdf)), count)
            place = np.arange(1, len(row) + 1) - (np.cumsum(count) - count)[row]
            yield pd.DataFrame({"token": token[keep], "grp": pdf["grp"].to_numpy()[row[keep]], "n": pdf["n"].to_numpy()[row[keep]], "place": place[keep]})

    out = materialise(sig.select("grp", "n", "prefix").mapInPandas(lean(run), "token long, grp long, n long, place long").distinct(), "tokens")
    held.destroy()
    return out


def near_components(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, percent: int = PERCENT, hubs: int = 1) -> DataFrame:
    """One row per document: key, n_shingles, component_id, the smallest key that links
    reach. Documents without words are linked with nothing, not even with each other;
    equal sets are linked; rows that repeat are linked with each other; a null key never
    is a component_id unless no document of the component has another. Very long texts are
    compared whole. Only key and text are read of docs. No rows, no rows."""
    with scratch(docs.sparkSession) as kept:
        return _near_components(docs, text, key, words, percent, hubs, kept)


def _near_components(docs: DataFrame, text: str, key: str, words: int, percent: int, hubs: int, kept: set[str]) -> DataFrame:
    sig = signatures(docs, text, key, words, percent)
    kept.add(last_table())
    filled = sig.where("n > 0")
    members = materialise(filled.groupBy("grp", "node", "n").agg(F.min("key").alias("key"), F.min("row").alias("row")), "members")
    # postings that join groups
    postings = shared_tokens(filled)
    sizes = materialise(members.groupBy("grp", "n").agg(F.count("*").alias("members")), "sizes")
    # a posting's members; few groups have more than one, and only these are joined
    more = materialise(sizes.where("members > 1").select("grp", (F.col("members") - 1).alias("more")), "more")
    counted = postings.select("token", "grp").join(more, "grp", "left")
    shared = counted.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), (F.count("*") + F.sum(F.coalesce("more", F.lit(0)))).alias("size"))
    shared = materialise(shared.where("lo < hi").select("token", "size"), "shared")
    posted = materialise(postings.join(shared, "token").select("token", "grp", "n", "place", "size"), "postings")
    verifier = Verifier(docs, text, key, words, percent, members.select("row", "node"))
    nodes = members.select("node", F.col("node").alias("comp"), "key")
    maps = filled.select("grp", "prefix", "map")
    for label in Links(posted, members.select("grp", "node", "n"), sizes, maps, verifier, percent, hubs).labels:
        nodes = relabelled(nodes, label)
    least = materialise(nodes.groupBy("comp").agg(F.min("key").alias("component")), "least")
    nodes = nodes.select("node", "comp").distinct().join(least, "comp").select("node", "component")
    nodes = materialise(nodes, "components")
    kept.add(last_table())
    out = sig.select("key", "n", "node").join(nodes, "node", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "key")).otherwise(F.col("key")).alias("component_id"))


def relabelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with column comp replaced by its label (node, label), where it has one."""
    to = labels.select(F.col("node").alias("comp"), F.col("label").alias("__label"))
    return rows.join(to, "comp", "left").select(*[F.coalesce("__label", "comp").alias("comp") if c == "comp" else c for c in rows.columns])


#: Shingles of all sets together up to which these are sent to all executors (32 MB).
SENT_SHINGLES = 1 << 22


class Verifier:
    """Verifies pairs of nodes by their whole sets, which are made from the texts when a
    node is first met."""

    def __init__(self, docs, text, key, words, percent, rows):
        self.docs, self.text, self.key, self.words, self.percent, self.rows = docs, text, key, words, percent, rows
        self.sets = None

    def links(self, pairs: DataFrame) -> DataFrame:
        # the first round needs many nodes and always goes by shuffles, alike at every size;
        # later ones need few, and written tables, whose size is known, save the shuffles
        hint = "merge" if self.sets is None else None
        needed = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "needed")
        wanted = needed if self.sets is None else needed.join(self.sets.select("node"), "node", "left_anti")
        keys = materialise(self.rows.join(wanted, "node", "left_semi"), "keys")
        how = hint or ("broadcast" if keys.count() <= SENT else "merge")
        new = materialise(whole_sets(self.docs, keys, self.text, self.key, self.words, how), "sets")
        sets = new if self.sets is None else new.unionByName(self.sets.join(needed, "node", "left_semi"))
        self.sets = new if self.sets is None else self.sets.unionByName(new)
        a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
        b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        if hint:
            a, b = a.hint(hint), b.hint(hint)
        elif (sets.agg(F.sum(F.size("shingles"))).first()[0] or 0) <= SENT_SHINGLES:
            a, b = F.broadcast(a), F.broadcast(b)
        found = pairs.join(a, "a").join(b, "b").where(100 * both >= self.percent * (F.size("sa") + F.size("sb") - both))
        return materialise(found.select("a", "b"), "links")


#: Members of a posting or group that are paired with each other at once; larger ones go by hubs.
SMALL = 8
#: Times as many hubs a posting has in the next round.
GROWTH = 64
#: Rows of a few numbers, and of a bitmap more, up to which a table is sent to all executors
#: (some 50 MB); larger ones are shuffled.
SENT, SENT_MAPS = 1 << 20, 1 << 17
#: Pairs for each row of the open postings up to which all that are left are met at once.
LAST = 32


def sent(table: DataFrame, most: int) -> DataFrame:
    """The written table, to be broadcast if it has no more rows than that."""
    return F.broadcast(table) if table.count() <= most else table


class Links:
    """``labels``: tables (node, label), one for each round. A node's component is its label by
    the first, that label's label by the second, and so on; what has no label keeps its own.

    Small postings give all their pairs of groups, at most SMALL / 2 for each of their rows, with
    the number of postings that a pair shares: all common shingles of two prefixes are there, but
    for those with large postings, of which a group's number is known. With the set whose
    prefix ends first, what is common is in both prefixes or behind that prefix; pairs
    that can't reach the similarity by this go unexpanded.

    Of pairs from large postings the bitmaps are compared as they meet: bits in common, and
    shingles that share a bit with another one, bound what the sets, or the prefixes, have in
    common; behind prefixes, that and what follows the one that ends first bounds the rest.
    Only pairs that pass are rows; these are held against the prefixes themselves, expanded to
    members, and verified.

    Members of one group share prefix, size and all bounds; they are verified with each other
    before groups meet, in small groups all pairs, in large ones by hubs. A group whose members
    aren't one component then takes part once for each of its components, its parts."""

    def __init__(self, posted, members, sizes, maps, verifier: Verifier, percent: int, hubs: int):
        self.members, self.verifier, self.percent, self.hubs = members, verifier, percent, hubs
        self.checked: DataFrame | None = None
        self.labels: list[DataFrame] = []
        several = materialise(members.join(sizes.where("members > 1").select("grp", "members"), "grp"), "several")
        is_small = F.col("size") <= SMALL
        missing = materialise(posted.where(~is_small).groupBy("grp").agg(F.count("*").alias("large")), "missing")
        pairs = self.expanded(self.small_pairs(posted.where(is_small), missing)).unionByName(self.paired(several.where(F.col("members") <= SMALL), "grp"))
        self.verified(materialise(pairs.distinct(), "pairs"))
        crowds = several.where(F.col("members") > SMALL)
        if not crowds.isEmpty():
            # a group is a posting of its members
            rows = crowds.select(F.col("grp").alias("token"), F.col("node").alias("unit"), "n", F.lit(1).cast("long").alias("place"), F.lit(0).cast("long").alias("large"), F.col("node").alias("comp"))
            self.rounds(self.current(rows), None, lambda pairs: pairs.select("a", "b", "ca", "cb"))
        large = posted.where(~is_small).drop("size").join(sent(missing, SENT), "grp")
        if not missing.isEmpty():
            short, bits = self.prefixes(maps, missing)
            held = self.current(members.join(missing.select("grp"), "grp", "left_semi").withColumn("comp", F.col("node")))
            self.parts = materialise(held.select("grp", "node", "comp"), "parts")
            units = materialise(self.parts.select("grp", "comp").distinct(), "units")
            rows = large.join(sent(units, SENT), "grp").join(sent(bits, SENT_MAPS), "grp").withColumnRenamed("grp", "unit")
            self.rounds(rows, short, self.members_of)

    def current(self, rows: DataFrame) -> DataFrame:
        """rows with the components so far in comp, which holds nodes."""
        for label in self.labels:
            rows = relabelled(rows, label)
        return rows

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Links among the pairs (a, b) of nodes, which are remembered."""
        self.checked = pairs.select("a", "b") if self.checked is None else self.checked.unionByName(pairs.select("a", "b"))
        links = self.verifier.links(pairs.select("a", "b"))
        if not self.labels:
            self.labels.append(components(links))
        return links

    def behind(self, n: str) -> Column:
        """Shingles of a set behind its prefix."""
        return F.ceil(F.col(n) * self.percent / 100) - 1

    def enough(self, common: Column) -> Column:
        return (100 + self.percent) * common >= self.percent * (F.col("na") + F.col("nb"))

    @property
    def fits(self) -> Column:
        return 100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb")

    def small_pairs(self, small: DataFrame, missing: DataFrame) -> DataFrame:
        """Pairs of groups (a, b) that small postings don't rule out."""
        small = materialise(small.join(sent(missing, SENT), "grp", "left").select("token", "grp", "n", F.coalesce("large", F.lit(0)).alias("large")), "small")
        side = lambda x: small.select("token", F.col("grp").alias(x), F.col("n").alias(f"n{x}"), F.col("large").alias(f"l{x}"))
        together = side("a").join(side("b"), "token").where((F.col("a") < F.col("b")) & self.fits)
        together = together.groupBy("a", "b", "na", "nb", "la", "lb").agg(F.count("*").alias("count"))
        most = F.col("count") + F.least("la", "lb") + F.greatest(self.behind("na"), self.behind("nb"))
        return together.where(self.enough(most)).select("a", "b")

    def expanded(self, pairs: DataFrame) -> DataFrame:
        """Pairs of nodes of pairs of groups."""
        of = lambda x: self.members.select(F.col("grp").alias(x), F.col("node").alias(f"{x}{x}"))
        both = pairs.join(of("a"), "a").join(of("b"), "b")
        return both.select(F.least("aa", "bb").alias("a"), F.greatest("aa", "bb").alias("b"))

    def paired(self, rows: DataFrame, by: str) -> DataFrame:
        """Pairs of nodes that share ``by``."""
        both = rows.select(by, F.col("node").alias("a")).join(rows.select(by, F.col("node").alias("b")), by)
        return both.where("a < b").select("a", "b")

    def prefixes(self, maps: DataFrame, missing: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of each group that has large postings: 15 bits of each shingle of its prefix and how
        many of them are alike, enough for an upper bound; and the bitmap."""
        short = F.array_distinct(F.transform("prefix", lambda x: x.bitwiseAND(F.lit(0x7FFF)).cast("short")))
        maps = maps.select("grp", "map", F.struct(short.alias("short"), F.size("prefix").alias("p")).alias("of"))
        # members have one prefix, but each its own bitmap: bits of any count, as an upper bound
        maps = maps.join(sent(missing.select("grp"), SENT), "grp", "left_semi").groupBy("grp").agg(
            F.first("of").alias("of"),
            *[F.bit_or(F.col("map")[k]).alias(f"m{k}") for k in range(WORDS_OF_MAP)],
            F.max(F.col("map")[WORDS_OF_MAP]).alias(f"m{WORDS_OF_MAP}"),
        )
        bits = [f"m{k}" for k in range(WORDS_OF_MAP + 1)]
        maps = materialise(maps.select("grp", *bits, "of.*"), "maps")
        return maps.select("grp", "short", (F.col("p") - F.size("short")).alias("alike")), maps.select("grp", *bits)

    def near(self, pairs: DataFrame, short: DataFrame) -> DataFrame:
        """Pairs of groups that their prefixes don't rule out."""
        wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("grp")).distinct(), "wanted")
        held = materialise(short.join(wanted, "grp", "left_semi"), "compared")
        of = lambda x: held.select(F.col("grp").alias(x), F.col("short").alias(f"p{x}"), F.col("alike").alias(f"d{x}"))
        most = F.size(F.array_intersect("pa", "pb")) + F.least("da", "db") + F.greatest(self.behind("na"), self.behind("nb"))
        return pairs.join(of("a"), "a").join(of("b"), "b").where(self.enough(most)).select("a", "b", "ca", "cb")

    def members_of(self, pairs: DataFrame) -> DataFrame:
        """Pairs of nodes (a, b) with their components of pairs of parts of groups."""
        of = lambda x: self.parts.select(F.col("grp").alias(x), F.col("comp").alias(f"c{x}"), F.col("node").alias(f"{x}{x}"))
        both = pairs.join(of("a"), ["a", "ca"]).join(of("b"), ["b", "cb"])
        swap = F.col("aa") > F.col("bb")
        sides = (("aa", "bb", "a"), ("bb", "aa", "b"), ("ca", "cb", "ca"), ("cb", "ca", "cb"))
        return both.select(*[F.when(swap, F.col(y)).otherwise(F.col(x)).alias(c) for x, y, c in sides])

    def rounds(self, seen: DataFrame, short: DataFrame | None, members_of) -> None:
        """Rounds of hubs over rows (token, unit, comp, n, place, large), with bitmaps if there
        are prefixes. members_of gives the pairs of nodes of pairs of units."""
        bits = [f"m{k}" for k in range(WORDS_OF_MAP + 1)] if short is not None else []
        passes = F.lit(True)
        if bits:
            common = sum((F.bit_count(F.col(f"a{m}").bitwiseAND(F.col(f"b{m}"))) for m in bits[:-1]), F.least(f"a{bits[-1]}", f"b{bits[-1]}"))
            whole, part = (F.greatest("na", "nb") <= WHOLE), (F.least("na", "nb") > WHOLE)
            # a bitmap of a set and one of a prefix can't be compared
            alike = F.when(whole, self.enough(common)).when(part, self.enough(common + F.greatest(self.behind("na"), self.behind("nb")))).otherwise(True)
            # where a shingle is the first that two sets share, what follows it bounds the rest
            first = self.enough(1 + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")))
            passes = self.fits & first & alike
        hubs = self.hubs
        while True:
            # postings that join components, with the components so far
            seen = materialise(seen, "seen")
            per = seen.groupBy("token", "comp").count().groupBy("token")
            per = per.agg(F.sum("count").alias("m"), F.sum(F.col("count") * F.col("count")).alias("q"), F.max_by("comp", "count").alias("main"), F.count("*").alias("comps"))
            mixed = materialise(per.where("comps > 1").select("token", "main", "m", ((F.col("m") * F.col("m") - F.col("q")) / 2).alias("pairs")), "mixed")
            rows, open_pairs = mixed.agg(F.sum("m"), F.sum("pairs")).first()
            if not rows:
                return
            seen = seen.join(sent(mixed.select("token", "main"), SENT), "token")
            last = hubs > 1 and open_pairs <= LAST * rows  # a first hub merges most copies
            side = lambda x, y: seen.select("token", "main", F.col("unit").alias(x), *[F.col(c).alias(f"{a}{y}") for c, a in (("n", "n"), ("comp", "c"), ("place", "p"), ("large", "l"))], *[F.col(m).alias(f"{y}{m}") for m in bits])  # noqa: E731, B023
            left = side("x", "a").where("ca <> main")  # pairs of components have a member outside the largest
            if not last:
                # one hub for each share of a posting; first the unit that shares most, as the
                # original of many copies does, then units outside the largest component
                left = side("x", "a") if hubs == 1 else left
                rank = F.struct(-F.col("la"), "x", "ca") if hubs == 1 else F.struct(F.xxhash64("x", "ca", F.lit(hubs)), "x", "ca")
                hub = F.min_by(F.struct("x", "na", "ca", "pa", *[f"a{m}" for m in bits]), rank).alias("hub")
                left = left.withColumn("share", F.pmod(F.xxhash64("x", "ca"), F.lit(hubs))).groupBy("token", "share").agg(hub)
                left = materialise(left.select("token", "hub.*"), "hubs")
                hubs *= GROWTH
            # parts of one group have met in it
            met = left.drop("main", "la")
            pairs = (met if last else sent(met, SENT_MAPS)).join(side("y", "b").drop("lb"), "token").where((F.col("ca") != F.col("cb")) & (F.col("x") != F.col("y")) & passes)
            pairs = pairs.where("cb = main OR x < y") if last else pairs
            swap = F.col("x") > F.col("y")
            sides = (("x", "y", "a"), ("y", "x", "b"), *((f"{c}{y}", f"{c}{z}", f"{c}{y}") for c in "nc" for y, z in ("ab", "ba")))
            pairs = materialise(pairs.select(*[F.when(swap, F.col(q)).otherwise(F.col(p)).alias(c) for p, q, c in sides]).distinct(), "candidates")
            label = None
            if not pairs.isEmpty():
                found = members_of(pairs if short is None else self.near(pairs, short)).distinct()
                found = materialise(found.join(self.checked, ["a", "b"], "left_anti"), "pairs")
                # links between components merge them
                links = self.verified(found).join(found, ["a", "b"])
                label = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
                self.labels.append(label)
                if short is not None:
                    self.parts = materialise(relabelled(self.parts, label), "parts")
            if last:
                return
            # all pairs of a hub whose first common shingle this is are verified now: it leaves the
            # posting
            gone = left.select("token", F.col("x").alias("unit"), F.col("ca").alias("comp"))
            seen = seen.drop("main").join(sent(gone, SENT), ["token", "unit", "comp"], "left_anti")
            seen = seen if label is None else relabelled(seen, label)


@guarded
def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """docs without all but one document of each component: that with the smallest key, a
    null key last. Documents without words all stay. A row is its key and text: rows of one
    key with different texts are documents of their own, and rows that repeat the document
    that stays, stay too. Very long texts are compared whole; columns whose names clash with
    internal ones pass unchanged."""
    rows = docs.withColumn("__row", row_hash(F.col(f"`{key}`"), F.col(text)))
    with scratch(docs.sparkSession) as kept:
        gone = _surplus(rows, text, key, options)
        kept.add(last_table())
    return rows.join(gone, "__row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _surplus(rows: DataFrame, text: str, key: str, options: dict) -> DataFrame:
    """The __row of each row that another one of its component stands for."""
    found = near_components(rows.select("__row", F.col(text).alias("text")), "text", "__row", **options)
    # the components of more than one row, and the row of each that stays
    found = materialise(found.select("__row", F.col("component_id").alias("comp")).distinct(), "classes")
    several = found.groupBy("comp").count().where("count > 1").select("comp")
    keys = rows.select("__row", F.col(f"`{key}`").alias("key"))
    members = materialise(found.join(several, "comp").join(keys, "__row").distinct(), "copies")
    best = F.min(F.struct(F.col("key").isNull(), "key", "__row"))["__row"].alias("stays")
    stays = materialise(members.groupBy("comp").agg(best), "stays")
    return materialise(members.join(stays, "comp").where("__row <> stays").select("__row").distinct(), "gone")


def op2_prefix_join(spark, sf_dir) -> DataFrame:
    return near_components(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(r.b) FROM r WHERE r.a = d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""
