"""Repeated passages and near copies against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from binweave.llm import prefix_join, rlz, runs, suffix_dedup
from binweave.llm.graph import components


def covered(symbols, window, counts):
    mask = [False] * len(symbols)
    for p in range(len(symbols) - window + 1):
        if counts[tuple(symbols[p : p + window])] > 1:
            mask[p : p + window] = [True] * window
    return mask


def counted(texts, window):
    c = Counter()
    for s in texts:
        c.update(tuple(s[p : p + window]) for p in range(len(s) - window + 1))
    return c


def spans_of(rows, unit):
    return {r["doc_id"]: {p for a, b in runs.span_array(r["__spans"]) for p in range(a, b)} for r in rows}


def test_suffix_spans(make, corpus):
    texts = [(t or "").encode() for t in corpus]
    counts = counted(texts, 200)
    got = spans_of(suffix_dedup.spans(make(corpus)).collect(), "bytes")
    for i, t in enumerate(texts):
        assert got[i] == {p for p, m in enumerate(covered(t, 200, counts)) if m}, i


def test_rlz_spans(make, corpus):
    texts = [(t or "").encode().split() for t in corpus]
    counts = counted(texts, 35)
    got = spans_of(rlz.spans(make(corpus)).collect(), "words")
    for i, t in enumerate(texts):
        assert got[i] == {p for p, m in enumerate(covered(t, 35, counts)) if m}, i


def test_parts_of_a_hot_bucket_agree(make, corpus, monkeypatch):
    whole = {r["doc_id"]: r["text"] for r in suffix_dedup.dedup(make(corpus)).collect()}
    monkeypatch.setattr(runs, "PART_CONTENTS", 2)
    assert {r["doc_id"]: r["text"] for r in suffix_dedup.dedup(make(corpus)).collect()} == whole
    monkeypatch.setattr(runs, "LEVELS", 1)
    words = {r["doc_id"]: r["text"] for r in rlz.dedup(make(corpus)).collect()}
    monkeypatch.undo()
    assert {r["doc_id"]: r["text"] for r in rlz.dedup(make(corpus)).collect()} == words


@pytest.mark.parametrize("op,window", [(suffix_dedup, 200), (rlz, 35)])
def test_hot_gram_is_no_tasks_own(make, monkeypatch, op, window):
    """A line in more documents than a bucket may hold: no task takes all its contents."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    line = text(20)
    texts = [f"{text(25)} {line} {text(25)}" for _ in range(5000)]
    texts += [f"{text(9)} {t[20:]}" for t in texts[:30]] + [f"{t[:-20]} {text(9)}" for t in texts[15:45]] + texts[50:60]
    monkeypatch.setattr(runs, "PART_CONTENTS", 500)
    monkeypatch.setattr(runs, "CHUNK", 1 << 14)
    limit, resolve = 1000, op.PASSAGES.resolve

    def checked(pieces, *part):
        if len(pieces) > limit:
            raise ValueError(f"{len(pieces)} contents in one task")
        return resolve(pieces, *part)

    monkeypatch.setattr(op, "PASSAGES", op.PASSAGES._replace(resolve=checked))
    symbols = [t.encode() if op is suffix_dedup else tuple(t.split()) for t in texts]
    counts = Counter(hash(s[p : p + window]) for s in symbols for p in range(len(s) - window + 1))
    got = spans_of(op.spans(make(texts)).collect(), "")
    for i, s in enumerate(symbols):
        twice = [p for p in range(len(s) - window + 1) if counts[hash(s[p : p + window])] > 1]
        assert got[i] == {q for p in twice for q in range(p, p + window)}, i


@pytest.mark.parametrize("op,window", [(suffix_dedup, 200), (rlz, 35)])
def test_hot_grams_take_few_rounds(make, monkeypatch, op, window):
    """A long passage in many texts, cut anywhere: a few rounds of anchoring, and one job that
    resolves the buckets of all rounds."""
    rnd = random.Random(11)
    text = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 6))) for _ in range(n))
    line = text(60).split()
    texts = [f"{text(8)} {' '.join(line[rnd.randint(0, 20) : rnd.randint(40, 60)])} {text(8)}" for _ in range(150)]
    texts += [texts[3] + " " + text(3), texts[4]]
    monkeypatch.setattr(runs, "PART_CONTENTS", 8)
    written, write = Counter(), runs.materialise
    monkeypatch.setattr(runs, "materialise", lambda df, name, **options: (written.update([name]), write(df, name, **options))[1])
    symbols = [t.encode() if op is suffix_dedup else tuple(t.split()) for t in texts]
    counts = counted(symbols, window)
    got = spans_of(op.spans(make(texts)).collect(), "")
    for i, s in enumerate(symbols):
        assert got[i] == {p for p, m in enumerate(covered(s, window, counts)) if m}, i
    assert 2 <= written["anchored"] <= 3 and written["resolved"] == 1


@pytest.mark.parametrize("op", [suffix_dedup, rlz])
def test_dedup_keeps_columns_and_rows(make, corpus, op):
    docs = make(corpus)
    out = op.dedup(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert op.dedup(docs.limit(0)).count() == 0
    twice = op.dedup(make([(1, corpus[7]), (1, corpus[7]), (None, corpus[8]), (None, None), (3, "short")])).collect()
    assert sorted((r["text"] for r in twice), key=len)[:4] == ["", "", "", "short"]


def test_repeat_within_one_text(make):
    body = " ".join(f"w{k}" for k in range(60))
    out = {r["doc_id"]: r["text"] for r in suffix_dedup.dedup(make([body + " | " + body, "clean " * 3])).collect()}
    assert out[0] == " | " and out[1] == "clean " * 3


def test_cover_is_a_difference_cover():
    d = (suffix_dedup.COVER[:, None] - suffix_dedup.COVER[None, :]) % suffix_dedup.PERIOD
    assert set(d.ravel().tolist()) == set(range(suffix_dedup.PERIOD))


def test_sliding_min():
    a = np.random.default_rng(0).integers(0, 99, 400).astype(np.uint64)
    for w in (1, 2, 3, 7, 30, 161):
        assert np.array_equal(runs.sliding_min(a, w), [a[i : i + w].min() for i in range(len(a) - w + 1)])


def shingles(t):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(pairs):
    sets = [shingles(t) for _, t in pairs]
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(pairs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(pairs):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: (len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(pairs)}


@pytest.mark.parametrize("frequent,small", [(2, 16), (32, 16), (32, 2)])
def test_near_components(make, corpus, monkeypatch, frequent, small):
    monkeypatch.setattr(prefix_join, "SMALL", small)
    monkeypatch.setattr(prefix_join, "LAST", small // 4)
    monkeypatch.setattr(prefix_join, "FREQUENT", frequent)
    pairs = [(1000 - i, t) for i, t in enumerate(corpus)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in prefix_join.near_components(make(pairs)).collect()}
    assert got == brute_components(pairs)


def test_near_chain_in_rounds(make, monkeypatch):
    monkeypatch.setattr(prefix_join, "SMALL", 0)
    monkeypatch.setattr(prefix_join, "LAST", 0)
    # each text is near the next one only: the component needs links that hubs don't give
    w = [f"w{k}" for k in range(400)]
    pairs = [(k, " ".join(w[k * 6 : k * 6 + 110])) for k in range(40)]
    for hubs in (1, 16):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in prefix_join.near_components(make(pairs), hubs=hubs).collect()}
        assert got == brute_components(pairs)


def test_near_groups_of_two(make):
    # most pairs have equal prefixes and size, whose shingles no other group holds
    rnd = random.Random(3)
    pairs = []
    for k in range(40):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
        late = rnd.randrange(190, 200)
        pairs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:late], "other", *words[late + 1 :]]))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in prefix_join.near_components(make(pairs)).collect()}
    assert got == brute_components(pairs)
    assert {got[2 * k + 1][1] for k in range(40)} == {2 * k for k in range(40)}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_pairs_of_equal_size(make, seed):
    # 150 pairs that differ in one word: most have equal prefixes and size
    rnd = random.Random(seed)
    pairs = []
    for k in range(150):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
        at = rnd.randrange(200)
        pairs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:at], "other", *words[at + 1 :]]))]
    got = {r["doc_id"]: r["component_id"] for r in prefix_join.near_components(make(pairs)).collect()}
    assert all(got[2 * k] == got[2 * k + 1] == 2 * k for k in range(150))


@pytest.mark.parametrize("small,last", [(0, 0), (2, 0), (8, 32)])
def test_near_groups_that_are_not_one_component(make, monkeypatch, small, last):
    """Sets of equal prefix and size whose frequent rest differs, with near copies of some."""
    monkeypatch.setattr(prefix_join, "FREQUENT", 12)
    monkeypatch.setattr(prefix_join, "SMALL", small)
    monkeypatch.setattr(prefix_join, "LAST", last)
    rnd = random.Random(11)
    rest = [" ".join(f"r{k}x{m}" for m in range(40)) for k in range(5)]
    texts = []
    for u in range(25):
        own = " ".join(f"u{u}x{m}" for m in range(60))
        texts += [f"{own} {r}" for r in rest]
        for _ in range(3):
            words = f"{own} {rnd.choice(rest)}".split()
            words[rnd.randrange(60, 100)] = "edit"
            texts.append(" ".join(words))
    pairs = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in prefix_join.near_components(make(pairs)).collect()}
    assert got == brute_components(pairs)
    sig = prefix_join.signatures(make(pairs)).where("n > 0").toPandas()
    assert (sig.groupby("grp")["node"].nunique() > 1).sum() > 5


def test_near_crowds(make, monkeypatch):
    """Groups of many members, and sets on both sides of the size up to which bitmaps are of whole
    sets."""
    monkeypatch.setattr(prefix_join, "SMALL", 2)
    monkeypatch.setattr(prefix_join, "LAST", 1)
    rnd = random.Random(12)
    texts = []
    for u, size in enumerate((150, 150, 1010, 1040)):
        base = [f"u{u}x{m}" for m in range(size)]
        for _ in range(30):
            words = list(base)
            for _ in range(rnd.choice([1, 1, 2, size // 40])):
                words[rnd.randrange(size)] = f"e{rnd.randrange(10**6)}"
            texts.append(" ".join(words + ["tail"] * rnd.choice([0, 0, 1])))
    pairs = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in prefix_join.near_components(make(pairs)).collect()}
    assert got == brute_components(pairs)


def test_whole_sets_of_null_keys(make):
    """Rows of one key with different texts don't meet each other."""
    docs = make([(None, f"text number {k} of very many") for k in range(300)])
    sig = prefix_join.signatures(docs)
    assert prefix_join.whole_sets(docs, sig.select("row", "node"), "text", "doc_id", 5).count() == 300


def test_later_sets_take_one_worker(make, monkeypatch):
    """After the first round few sets are wanted: no task packs texts for another worker."""
    docs = make([(k, " ".join(f"w{k // 2} {j}" for j in range(20)) + " x" * (k % 2)) for k in range(8)])
    sig = prefix_join.signatures(docs)
    node = {r["key"]: r["node"] for r in sig.collect()}
    plans, write = [], prefix_join.materialise

    def written(df, name, **options):
        if name == "sets":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name, **options)

    monkeypatch.setattr(prefix_join, "materialise", written)
    with prefix_join.scratch(docs.sparkSession):
        verifier = prefix_join.Verifier(docs, "text", "doc_id", 5, 80, sig.select("row", "node"))
        for a, b, c in ((0, 1, 2), (4, 5, 6)):
            pairs = docs.sparkSession.createDataFrame([(node[a], node[b]), (node[b], node[c])], "a long, b long")
            assert [tuple(r) for r in verifier.links(pairs).collect()] == [(node[a], node[b])]
    assert ["ArrowEvalPython" in p for p in plans] == [True, False]
    assert all("MapInPandas" in p for p in plans)


def test_hubs_of_unlinked_copies(make, monkeypatch):
    # a passage that is most of each text, none of which are linked: hubs leave, all pairs are checked
    monkeypatch.setattr(prefix_join, "SMALL", 2)
    monkeypatch.setattr(prefix_join, "LAST", 2)
    monkeypatch.setattr(prefix_join, "FREQUENT", 2)
    shared = " ".join(f"s{k}" for k in range(100))
    pairs = [(k, shared + " " + " ".join(f"w{k}x{m}" for m in range(20 + k % 3))) for k in range(24)]
    pairs += [(100 + k, pairs[k][1] + " tail") for k in range(5)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in prefix_join.near_components(make(pairs)).collect()}
    assert got == brute_components(pairs)


def test_keep_one_is_by_row(make):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(3, a), (5, a + " end"), (5, b), (8, "other words here"), (None, b + " end"), (None, None), (9, None), (7, b + " last")]
    kept = prefix_join.keep_one(make(rows))
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect() if r["text"]) == sorted([("3", a), ("5", b), ("8", "other words here")])
    assert kept.where("text IS NULL").count() == 2


def test_near_odd_rows(make):
    t = " ".join(f"w{k}" for k in range(50))
    docs = make([(5, t), (5, t), (None, t), (7, None), (8, ""), (9, None), (3, t.upper())])
    got = [(r["doc_id"], r["component_id"]) for r in prefix_join.near_components(docs).collect()]
    assert sorted(got, key=str) == sorted([(5, 3), (5, 3), (None, 3), (7, 7), (8, 8), (9, 9), (3, 3)], key=str)
    kept = prefix_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == [3, 7, 8, 9]
    assert prefix_join.near_components(docs.limit(0)).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (3, 3), (10, 4), (4, 9), (2, 1)] + [(k, k + 1) for k in range(100, 140)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 8: 4, 9: 4, 10: 4} | {k: 100 for k in range(100, 141)}


@pytest.mark.parametrize("name,window", [("op6_rlz_dedup", 35), ("op7_suffix_dedup", 200)])
def test_digests(spark, data, name, window):
    """Every row of the queries, cut documents included, against brute force."""
    from binweave.llm.queries import queries

    words = name.startswith("op6")
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    symbols = {k: t.split() if words else t for k, t in docs.items()}
    part = (lambda s, p: hash(tuple(s[p : p + window]))) if words else (lambda s, p: hash(s[p : p + window]))
    counts = Counter(part(s, p) for s in symbols.values() for p in range(len(s) - window + 1))
    cut = 0
    for r in queries()[name](spark, data).collect():
        s = symbols[r["doc_id"]]
        gone = np.zeros(len(s) + window, dtype=bool)
        for p in range(len(s) - window + 1):
            if counts[part(s, p)] > 1:
                gone[p : p + window] = True
        gone = gone[: len(s)]
        kept = b" ".join(w for w, g in zip(s, gone) if not g) if words else bytes(b for b, g in zip(s, gone) if not g)
        assert r["n_words" if words else "n_bytes"] == len(s) and r["n_removed"] == gone.sum() and r["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        if not words:
            assert r["n_spans"] == (np.diff(gone.astype(int), prepend=0) == 1).sum()
        cut += bool(gone.any() and not gone.all())
    assert cut > 10


@pytest.mark.parametrize("op", [suffix_dedup, rlz])
def test_very_long_periodic_text(make, op):
    texts = ["ab " * 120_000, "x" + "ab " * 200 + "clean end", "lone words " * 3]
    docs = make(texts)
    rows = runs.with_rows(docs, "text", "doc_id").select("__row", "text")
    longest = max(len(r["spans"]) for r in runs.repeated_spans(rows, op.PASSAGES).collect())
    assert longest < 50  # a period is one row
    out = {r["doc_id"]: r["text"] for r in op.dedup(docs).collect()}
    assert out[0].strip() == "" and out[2] == texts[2] and out[1].endswith("clean end") and len(out[1]) < 40


def test_resolvers_on_random_blocks():
    rnd = random.Random(1)

    def brute(pieces, twice, window):
        c = Counter()
        for p, t in zip(pieces, twice):
            for i in range(len(p) - window + 1):
                c[p[i : i + window]] += 2 if t else 1
        return [{q for i in range(len(p) - window + 1) if c[p[i : i + window]] > 1 for q in range(i, i + window)} for p in pieces]

    def got(found, n):
        out = [set() for _ in range(n)]
        for w, a, b in zip(*found):
            out[w] |= set(range(a, b))
        return out

    for _ in range(15):
        base = bytes(rnd.choice(b"ab") for _ in range(700))
        pieces = set()
        for _ in range(rnd.randint(1, 30)):
            a = rnd.randrange(400)
            x = bytearray(base[a : a + rnd.randint(150, 400)])
            x[rnd.randrange(len(x))] = rnd.choice(b"abc")
            pieces.add(bytes(x) if rnd.random() < 0.8 else b"a" * rnd.randint(190, 400))
        pieces = sorted(pieces)
        twice = np.array([rnd.random() < 0.2 for _ in pieces])
        for most in (1 << 16, 50):
            suffix_dedup.SORTED, before = most, suffix_dedup.SORTED
            assert got(suffix_dedup.repeated_suffixes(pieces, twice), len(pieces)) == brute(pieces, twice, 200)
            suffix_dedup.SORTED = before
        words = {tuple(rnd.choice("ab") if rnd.random() < 0.03 else "xyz"[k % 3] for k in range(rnd.randint(20, 64))) for _ in range(rnd.randint(1, 12))}
        words = sorted(words)
        twice = np.array([rnd.random() < 0.2 for _ in words])
        assert got(rlz.parse([" ".join(x).encode() for x in words], twice), len(words)) == brute(words, twice, 35)


def test_suffix_order():
    rnd = random.Random(4)
    text = bytes(rnd.choice(b"ab") for _ in range(300)) * 2 + b"b" * 400 + bytes(rnd.choice(b"ab") for _ in range(500))
    found = suffix_dedup.Suffixes(np.frombuffer(text, dtype=np.uint8)).ordered(np.arange(len(text) - 40))
    padded = text + bytes(300)
    assert found.tolist() == sorted(range(len(text) - 40), key=lambda i: padded[i:])


def test_factors_are_greedy():
    pieces = [b"a b c d e f x y", b"q a b c d e z", b"d e f x q"]
    block = rlz.Block(pieces, np.zeros(3, dtype=bool))
    piece, start, end = block.factors()
    parsed = [[(s - block.starts[p], e - block.starts[p]) for p2, s, e in zip(piece, start, end) if p2 == p] for p in range(3)]
    assert parsed[0] == [(0, 5), (5, 7), (7, 8)] and parsed[1] == [(0, 1), (1, 6), (6, 7)] and parsed[2] == [(0, 4), (4, 5)]
