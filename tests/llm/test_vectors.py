"""Vector codes, whitening and secret scans."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from binweave.llm import secret_scan, vector_codes, whitening

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
        *[T.StructField(c, T.StringType()) for c in ("x0", "x1", "vector", "code", "error", "i", "keys", "y", "of")],
    ]
)


@pytest.fixture
def vectors(spark):
    def f(rows):
        return spark.createDataFrame([(k, v, c, *["x"] * 9) for k, v, c in rows], VECTORS)

    return f


def odd_rows(n=700, dims=8, seed=4):
    """Clustered vectors, ties, repeats, and rows that go."""
    rnd = np.random.default_rng(seed)
    middles = rnd.normal(size=(40, dims))
    out = [(k, [float(x) for x in np.float32(middles[k % 40] + 0.1 * rnd.normal(size=dims))], k % 5 or None) for k in range(n)]
    out += [out[3], out[3], (None, out[5][1], 1), (n, [0.0] * dims, 2), (n + 1, [0.0] * dims, 2)]
    bad = [None, [], [None] * dims, [float("nan")] * dims, [1.0] * (dims - 1) + [float("inf")], [1.0] * (dims - 4)]
    return out, out + [(n + 2 + k, v, 3) for k, v in enumerate(bad)]


def plain_codes(rows):
    """The contract, all distances computed."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.floor(1024 * np.array([r[1] for r in rows], dtype=float)).astype(np.int64).reshape(len(rows), 4, -1)
    books = x[:256].transpose(1, 0, 2).copy()
    far = lambda: ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
    for _ in range(4):
        near = far().argmin(axis=2)
        for p in range(4):
            for e in range(len(books[p])):
                if len(mine := x[near[:, p] == e, p]):
                    books[p, e] = mine.sum(axis=0) // len(mine)
    d = far()
    codes = ["".join(f"{c:02x}" for c in r) for r in d.argmin(axis=2)]
    errors = d.min(axis=2).sum(axis=1)
    labels = {c: sum(int(e) for e, r in zip(errors, rows) if r[2] == c) for c in {r[2] for r in rows}}
    digest = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    return sorted((str(r[0]), c, int(e), labels[r[2]], digest) for r, c, e in zip(rows, codes, errors))


def test_vector_codes_as_all_distances(spark, vectors, tmp_path):
    kept, rows = odd_rows()
    vectors(rows).select("vec_id", "embedding", "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vector_codes.op11_vector_codes(spark, str(tmp_path)).collect()
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got) == plain_codes(kept)


@pytest.mark.parametrize("spread", [1, 30, 4000])
def test_slices_find_the_nearest(spread):
    rnd = np.random.default_rng(spread)
    for n, dims in ((1, 1), (5, 2), (64, 3), (256, 16)):
        entries = rnd.integers(-spread, spread + 1, size=(n, dims))
        entries[n // 2] = entries[0]
        x = np.concatenate([rnd.integers(-3 * spread, 3 * spread, size=(200, dims)), entries])
        far = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        code, best = vector_codes.Slices(entries).nearest(x)
        assert (code == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


def test_vector_codes_clashing_names_and_decoding(vectors):
    kept, rows = odd_rows(300, 4)
    out, books = vector_codes.compress(vectors(rows))
    got = out.collect()
    assert len(got) == len(kept)
    codes = np.array([[int(r["code"][k : k + 2], 16) for k in range(0, 8, 2)] for r in got])
    by_key = {k: v for k, v, _ in kept}
    worst = max(np.abs(d - np.array(by_key[r["x0"]])).max() for r, d in zip(got, books.decode(codes)) if r["x0"] is not None)
    assert worst < 0.5


def test_no_vectors(vectors):
    for rows in ([], [(1, None, 2), (2, [], None), (3, [float("nan")], 1)]):
        assert vector_codes.compress(vectors(rows))[0].collect() == []
        assert whitening.whiten(vectors(rows))[0].collect() == []


def test_vectors_that_do_not_fit(vectors):
    with pytest.raises(ValueError):
        vector_codes.compress(vectors([(1, [1.0, 2.0, 3.0], 1)]))
    with pytest.raises(Exception, match="beyond"):
        vector_codes.compress(vectors([(1, [1e30] * 4, 1)]))


def plain_whitening(rows):
    x = np.floor(64 * np.array([r[1] for r in rows], dtype=float)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    c = (n * x - total) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:32], v[:, ::-1][:, :32]
    return ((n * x - total) ** 2).sum(axis=1), c @ v / np.sqrt(e), e / np.trace(c.T @ c / n)


@pytest.mark.parametrize("rows_of_a_block", [7, 1024])
def test_whitening_as_on_one_machine(spark, vectors, tmp_path, monkeypatch, rows_of_a_block):
    monkeypatch.setattr(whitening, "ROWS", rows_of_a_block)
    monkeypatch.setattr(whitening, "HELD", 4096)
    kept, rows = odd_rows(300, 8)
    kept = [(k, v, c) for k, v, c in kept if k is not None and k != 3]
    rows = [(k, v, c) for k, v, c in rows if k is not None and k != 3]
    vectors(rows).repartition(3).select("vec_id", "embedding", "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.op13_whitening(spark, str(tmp_path)).toPandas()
    deviation, y, explained = plain_whitening(kept)
    assert len(got) == len(kept) * 8 and (got["n"] == len(kept)).all() and got["identity_error"].max() < 1e-10
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[[r[0] for r in kept]].to_numpy()
    sign = np.sign((table * y).sum(axis=0))
    assert np.abs(table * sign - y).max() < 1e-8
    assert got.drop_duplicates("vec_id").set_index("vec_id")["deviation"].loc[[r[0] for r in kept]].tolist() == deviation.tolist()
    assert np.allclose(got.drop_duplicates("component").sort_values("component")["explained"], explained, rtol=1e-10)


def test_whitening_of_rows_without_variance(vectors):
    for rows in ([(1, [1.0, 2.0], 1)], [(1, [1.0, 2.0], 1), (None, [1.0, 2.0], None), (1, [1.0, 2.0], 1)]):
        got = whitening.whiten(vectors(rows))[0].collect()
        assert [r["deviation"] for r in got] == [0] * len(rows) and all(r["whitened"] == [] for r in got)
    # one dimension of two has variance
    got = whitening.whiten(vectors([(1, [1.0, 2.0], 1), (2, [3.0, 2.0], 1)]))[0].collect()
    assert sorted(abs(r["whitened"][0]) for r in got) == pytest.approx([1, 1]) and len(got[0]["whitened"]) == 1


def test_deviations_beyond_longs():
    x = np.array([[1_000_000, 2**45]])
    assert whitening.deviations(x, 1, np.array([0, 0])) == [None]
    assert whitening.deviations(np.array([[5, 2**33]]), 2, np.array([10, 2**34])) == [0]


RANKS = {w: math.log2(k + 1) for k, w in enumerate(["pass", "word", "horse", "correct", "change", "the"], 1)}
VALUES = ["password", "P@ssw0rd99", "qwertyuiop", "aaaaaaaa", "xyxyxyxyxy", "2019-12-31", "31.12.1999ab", "Tr0ub4dor&3", "hR7$kq2Lw9zT", "correcthorse", "é漢x9", "zxcvbn1990", "abcabcabcQ"]


def plain_bits(value):
    """All segmentations, tried one by one."""
    lower, plain = value.lower(), value.lower().translate(secret_scan.FIGURES)
    stretches = list(secret_scan.walks(lower))

    def segment(a, b):
        w, best = value[a:b], math.inf
        if b - a == 1:
            best = secret_scan.pool(value)
        for form, extra in ((lower[a:b], 0), (plain[a:b], 1 + sum(x != y for x, y in zip(lower[a:b], plain[a:b])))):
            if form in RANKS:
                best = min(best, RANKS[form] + extra + 2 + secret_scan.case_bits(w))
                break
        dates = {m.span() for k in range(len(value)) if (m := secret_scan.DATE.match(value, k))}
        if (a, b) in dates and a == min(x for x, y in dates if y == b):
            best = min(best, 2 + (math.log2(120) if b - a <= 4 else math.log2(365 * 120) + 2 * (not w.isdigit())))
        for x, y in stretches:
            if x == a and a + 3 <= b <= y:
                best = min(best, 2 + math.log2(36) + math.log2(b - a) + 1.5 * secret_scan.turns(lower[a:b])[-1])
        for unit in range(1, 9):
            longest = lambda k: next((n for n in range(k - unit + 1) if n == k - unit or value[k - 1 - n] != value[k - 1 - n - unit]), 0)  # noqa: B023, E731
            if a >= unit and longest(b) == b - a >= max(2, unit):
                best = min(best, 2 + math.log2((b - a) / unit + 1))
        return best

    def least(b):
        return 0.0 if b == 0 else min(least(a) + segment(a, b) for a in range(b))

    return least(len(value))


@pytest.mark.parametrize("value", VALUES)
def test_guess_bits_as_all_segmentations(value):
    assert secret_scan.guess_bits(value, RANKS) == pytest.approx(plain_bits(value))


def test_guess_bits_tell_phrases_from_secrets():
    cheap = ["passwordpassword", "changethepassword", "qwertyuiopqwertyuiop", "a" * 5000, "1990-12-31"]
    assert all(secret_scan.guess_bits(v, RANKS) < secret_scan.GUESS for v in cheap)
    assert all(secret_scan.guess_bits(v, RANKS) > secret_scan.GUESS for v in ["hR7$kq2Lw9", "xK9mPq2vRt", "0f8a6c1e9b7d"])


def plain_base(text):
    found = []
    for m in re.finditer(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 12:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [x for _, _, x in sorted(found)]


def test_secret_scan(spark, make, tmp_path, corpus):
    rnd = random.Random(9)
    hexes = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    texts = [
        None, "", "é漢 password = 'abcdefghijklm' x", 'API_KEY:"' + hexes(20) + '"', "apikey=short", "toKen = " + hexes(16) + hexes(16), "toKenK=" + "a" * 20, "ſecret=" + "b1c2d3e4f5g6",
        "AKIA" + "Z" * 14 + " AKIA" + "Q" * 13, hexes(15) + "g" + hexes(16), 'pwd => "hR7$kq2Lw9zT"', "pwd = changeme; passphrase: aaaaaaaaaaaa", "client_secret = 'x9#Kq!27pLz0'." + "y" * 50_000, "passwd=" + "Ab3/" * 40_000,
        *[f"token {rnd.choice(['=', ':', ''])} {hexes(rnd.randint(8, 24))} secret='{hexes(rnd.randint(8, 14))}'" for _ in range(40)],
        *corpus,
    ]
    make(texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in secret_scan.op12_secret_scan(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    guessed = set()
    for k, t in enumerate(texts):
        base, r = plain_base(t or ""), got[k]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r[f"n_{x}"] for x in ("assign", "access", "hex")] == [sum(b.startswith(x) for b in base) for x in ("assign", "access", "hex")]
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if not s.startswith("guess")] == base and r["n_guess"] == len(spans) - len(base)
        guessed |= {t[slice(*map(int, s.split(":")[1:]))] for s in spans if s.startswith("guess")}
    assert {"hR7$kq2Lw9zT", "x9#Kq!27pLz0"} <= guessed and not guessed & {"changeme", "aaaaaaaaaaaa"}


def test_dictionary_counts_all_texts(spark, make):
    docs = make(["the cat the", "The dog", None, "cats"])
    assert list(secret_scan.dictionary(docs)) == ["the", "cat", "cats", "dog"]
    assert list(secret_scan.dictionary(docs, size=2)) == ["the", "cat"]
