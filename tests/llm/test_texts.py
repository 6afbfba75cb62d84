"""Tokens, media, archives, mixing, shards, rules, the classifier, the pipeline."""

import base64
import concurrent.futures
import gzip
import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from binweave.llm import bpe, host_rules, media, mixing, prefix_join, quality_eb, rlz, sharding, suffix_dedup, warc
from binweave.llm.queries import oracle_sql, queries

from ..conftest import same


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, data, duck, name):
    same(queries()[name](spark, data).toPandas(), duck.sql(oracle_sql()[name]).df())


@pytest.fixture(scope="module")
def coders():
    import public_tokenizers
    import tiktoken

    own = bpe.Encoder(bpe.default_path())
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


PARTS = ["'", "'s", "'re", "'ll", "'d", "s", "ve", " ", "  ", "\n", "\t", "\x85", "　", "\x1c", "a", "Zé", "1", "½", "!", "#'", "漢", "🙂", "́", "\0"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS) | st.text(max_size=3), max_size=12).map("".join), max_size=5))
def test_bpe_as_the_library(coders, texts):
    own, library = coders
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got = list(own.encode(texts)) if texts else []
    assert got == [library.encode_ordinary(t) for t in texts]
    assert [own.decode(ids) for ids in got] == [t.encode() for t in texts]


def test_bpe_long_slices(coders):
    own, library = coders
    rnd = random.Random(3)
    texts = ["=" * 3001, "".join(rnd.choice("abcé") for _ in range(2500)), " " * 700 + "x", "don't " * 400]
    assert list(own.encode(texts)) == [library.encode_ordinary(t) for t in texts]


def test_bpe_long_texts_in_parts(coders, monkeypatch):
    own, library = coders
    monkeypatch.setattr(bpe, "STEP", 40)
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(400))) for _ in range(60)] + ["", "x" * 300, "it's we're " * 90, ""]
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert max(len(list(bpe.parts(t))) for t in texts) > 5
    assert list(own.encode(texts)) == [library.encode_ordinary(t) for t in texts]


def test_bpe_cache_is_bounded(coders, monkeypatch):
    own = bpe.Encoder(bpe.default_path())
    monkeypatch.setattr(bpe, "CACHE", 50_000)
    rnd = random.Random(6)
    for _ in range(30):
        texts = [" ".join("".join(rnd.choice("qxzvkjw") for _ in range(12)) for _ in range(40))]
        assert list(own.encode(texts)) == [coders[1].encode_ordinary(t) for t in texts]
        assert len(own.cache) + len(own.old) < 500


def test_bpe_columns(make, coders, corpus):
    docs = make(corpus)
    rows = bpe.decode(bpe.encode(docs)).collect()
    for r in rows:
        t = (corpus[r["doc_id"]] or "").encode()
        assert bytes(r["decoded"]) == t and (r["offsets"][-1:] == [len(t)] or not t) and len(r["ids"]) == len(r["offsets"])
        assert r["ids"] == coders[1].encode_ordinary(t.decode())
    d = {r["doc_id"]: r["__bpe"] for r in bpe.digest(docs).collect()}
    assert all(d[r["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest() for r in rows)
    assert bpe.encode(docs.limit(0)).count() == 0 and "lang" in bpe.encode(docs).columns


def test_media_round_trip(make, corpus):
    docs = make(corpus)
    rows = media.media_columns(media.store_media(docs)).collect()
    for r in rows:
        p = media.pad(corpus[r["doc_id"]])
        t = r["track"]
        assert (t["payload_bytes"], t["payload_sha256"], t["tail_crc32"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert t["codec"] == "raw " and t["duration"] == len(p) and t["samples"] == len(p) // 64
        for k in t["keyframes"]:
            assert k["end"] - k["start"] == 64
        assert len(t["keyframes"]) == -(-t["samples"] // 16)
    first = next(r for r in rows if r["doc_id"] == 7)
    assert bytes(first["media"][first["track"]["keyframes"][1]["start"] :])[:64] == media.pad(corpus[7])[16 * 64 : 17 * 64]
    assert media.store_media(docs.limit(0)).count() == 0


def test_media_other_files():
    assert media.read_media(b"") == ([], None) and media.read_media(b"\0\0\0\x08free") == ([], None)
    f = media.write_media(b"x" * 64 * 200)
    # a second container level, 64-bit sizes, unknown boxes in front
    tracks, error = media.read_media(media.box(b"free", b"abc") + f)
    assert tracks[0].samples.shape == (200, 2) and error is None
    paths = {p[-1] for p, *_ in media.walk(f)}
    assert {b"ftyp", b"moov", b"trak", b"mdia", b"minf", b"stbl", b"stsz", b"stss", b"mdat"} <= paths
    deep = b""
    for _ in range(3000):
        deep = media.box(b"moov", deep)
    assert media.read_media(deep) == ([], None)


def test_media_damaged_files(spark):
    f = media.write_media(bytes(range(256)) * 50)
    rnd = random.Random(3)
    broken = [f[:k] for k in range(0, len(f), 37)]
    for _ in range(600):
        g = bytearray(f)
        for _ in range(rnd.choice((1, 1, 3))):
            g[rnd.randrange(700)] = rnd.choice((0, 1, 0x7F, 0xFF, rnd.randrange(256)))
        broken.append(bytes(g))
    said = 0
    for g in broken:
        tracks, error = media.read_media(g)
        said += error is not None
        assert all(t.samples.min() >= 0 and t.samples.max() <= len(g) for t in tracks)
    assert said > 100
    rows = spark.createDataFrame([(k, g) for k, g in enumerate([*broken[::40], None, f])], "id long, media binary")
    got = {r["id"]: r["track"] for r in media.media_columns(rows).collect()}
    assert got[len(got) - 1]["error"] is None and got[len(got) - 1]["samples"] == 200 and got[len(got) - 2]["media_bytes"] is None
    assert any(t["error"] and t["tracks"] == [] and t["media_bytes"] for t in got.values() if t["media_bytes"])


def track_box(number, handler, tables, timescale=90):
    return media.box(
        b"trak",
        media.full(b"tkhd", struct.pack(">IIIII", 0, 0, number, 0, 0)),
        media.box(b"mdia", media.full(b"mdhd", struct.pack(">IIIIHH", 0, 0, timescale, 400, 0, 0)), media.full(b"hdlr", bytes(4), handler, bytes(13)), media.box(b"minf", media.box(b"stbl", *tables))),
    )


def test_media_tracks_and_compact_sizes(spark):
    def tables(codec, sizes, at, sync):
        stz2 = media.full(b"stz2", bytes([0, 0, 0, 4]), struct.pack(">I", len(sizes)), bytes((a << 4) | b for a, b in zip(sizes[::2], [*sizes[1::2], 0])))
        return [
            media.full(b"stsd", struct.pack(">I", 1), media.box(codec, bytes(70))), media.full(b"stts", struct.pack(">III", 1, len(sizes), 10)), media.full(b"stss", struct.pack(">I", len(sync)), *[struct.pack(">I", k) for k in sync]),
            media.full(b"stsc", struct.pack(">IIII", 1, 1, len(sizes), 1)), stz2, media.full(b"stco", struct.pack(">II", 1, at)),
        ]

    make = lambda at: media.box(b"moov", track_box(1, b"soun", tables(b"mp4a", [2, 2, 2], at, [1, 2, 3])), track_box(2, b"vide", tables(b"avc1", [3, 1, 4], at + 6, [2])))
    at = len(make(0)) + 8
    f = make(at) + media.box(b"mdat", bytes(range(14)))
    tracks, error = media.read_media(f)
    assert error is None and [(t.id, t.handler, t.codec, t.duration) for t in tracks] == [(1, "soun", "mp4a", 30), (2, "vide", "avc1", 30)]
    assert (tracks[1].samples - at).tolist() == [[6, 9], [9, 10], [10, 14]] and (tracks[1].keyframes - at).tolist() == [[9, 10]]
    row = media.media_columns(spark.createDataFrame([(f,)], "media binary")).first()["track"]
    assert row["codec"] == "avc1" and row["payload_sha256"] == hashlib.sha256(bytes(range(6, 14))).hexdigest() and [t["codec"] for t in row["tracks"]] == ["mp4a", "avc1"]


def test_media_fragments():
    empty = [media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(70))), media.full(b"stts", bytes(4)), media.full(b"stsc", bytes(4)), media.full(b"stsz", bytes(8)), media.full(b"stco", bytes(4))]
    moov = media.box(b"moov", track_box(7, b"vide", empty), media.box(b"mvex", media.full(b"trex", struct.pack(">5I", 7, 1, 20, 4, 0x10000))))

    def moof(offset):
        head = media.full(b"tfhd", struct.pack(">I", 7), flags=0x20000)
        runs = [media.full(b"trun", struct.pack(">IiIII", 2, offset, 0, 5, 6), flags=0x205), media.full(b"trun", struct.pack(">I", 3), flags=0)]
        return media.box(b"moof", media.full(b"mfhd", struct.pack(">I", 1)), media.box(b"traf", head, *runs))

    size = len(moof(0))
    f = moov + moof(size + 8) + media.box(b"mdat", bytes(23))
    tracks, error = media.read_media(f)
    at = len(moov) + size + 8
    assert error is None and tracks[0].codec == "avc1" and tracks[0].duration == 100
    assert (tracks[0].samples - at).tolist() == [[0, 5], [5, 11], [11, 15], [15, 19], [19, 23]] and (tracks[0].keyframes - at).tolist() == [[0, 5]]


def test_media_fragment_with_a_long_head():
    """A moof box whose size has 64 bits."""
    empty = [media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(70))), media.full(b"stts", bytes(4)), media.full(b"stsc", bytes(4)), media.full(b"stsz", bytes(8)), media.full(b"stco", bytes(4))]
    moov = media.box(b"moov", track_box(7, b"vide", empty), media.box(b"mvex", media.full(b"trex", struct.pack(">5I", 7, 1, 20, 4, 0x10000))))

    def moof(offset):
        body = media.box(b"traf", media.full(b"tfhd", struct.pack(">I", 7), flags=0x20000), media.full(b"trun", struct.pack(">IiII", 2, offset, 5, 6), flags=0x201))
        return struct.pack(">I4sQ", 1, b"moof", len(body) + 16) + body

    size = len(moof(0))
    part = moof(size + 8) + media.box(b"mdat", bytes(11))
    tracks, error = media.read_media(moov + part * 50)
    at = len(moov) + size + 8
    assert error is None and len(tracks[0].samples) == 100 and tracks[0].duration == 2000
    assert (tracks[0].samples[:4] - at).tolist() == [[0, 5], [5, 11], [len(part), len(part) + 5], [len(part) + 5, len(part) + 11]]


def test_media_query(spark, data):
    rows = {r["doc_id"]: r for r in queries()["op3_media_columns"](spark, data).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert rows.keys() == docs.keys()
    for k, r in rows.items():
        p, f = media.pad(docs[k]), media.write_media(media.pad(docs[k]))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((docs[k] or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(f), hashlib.sha256(f).hexdigest())
        n = len(p) // 64
        assert r["feature"].startswith(f"raw ;rate=8000;duration={len(p)};samples={n};keyframes={-(-n // 16)};ranges=")
    by_text = {}
    for k, r in rows.items():
        assert by_text.setdefault(docs[k] or "", r["feature"]) == r["feature"]


def test_media_variable_samples():
    sizes, data = [3, 5, 2, 7], bytes(range(17))
    tables = lambda at: media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 90, 400, 0, 0)), media.box(b"minf", media.box(b"stbl",
        media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(70))), media.full(b"stts", struct.pack(">IIIII", 2, 3, 100, 1, 50)), media.full(b"stss", struct.pack(">III", 2, 1, 3)),
        media.full(b"stsc", struct.pack(">I", 2), struct.pack(">III", 1, 1, 1), struct.pack(">III", 2, 3, 1)), media.full(b"stsz", struct.pack(">II", 0, 4), struct.pack(">4I", *sizes)), media.full(b"co64", struct.pack(">I", 2), struct.pack(">2Q", at, at + 3)))))))
    at = len(tables(0)) + 8
    (t,), error = media.read_media(tables(at) + media.box(b"mdat", data))
    assert error is None and (t.codec, t.timescale, t.duration) == ("avc1", 90, 350)
    assert (t.samples - at).tolist() == [[0, 3], [3, 8], [8, 10], [10, 17]] and (t.keyframes - at).tolist() == [[0, 3], [8, 10]]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, key string")


def test_warc(spark):
    rows = [(5, "http://a/ b", "<p>é</p>" * 2000, "x"), (2, None, "same", "x"), (9, "u", "same", "x"), (2, None, "same", "x"), (7, "u", None, "x"), (1, "u", "", "x"), (None, "u", "same", "x"), (None, "u", "alone\r\n\r\nWARC/1.1\r\n", "x")]
    table = warc.write_archives(pages(spark, rows))
    raw = [bytes(r["content"]) for r in table.collect()]
    assert all(zlib.decompressobj(31).decompress(r) == gzip.decompress(r) for r in raw)  # one member each
    normal = warc.normalise(table)
    index = sorted(normal.index.collect(), key=lambda r: (r["archive"], r["offset"]))
    content = {r["archive"]: b"" for r in table.collect()}
    for r in sorted(normal.blocks.collect(), key=lambda r: (r["archive"], r["block"])):
        assert r["start"] == len(content[r["archive"]])
        content[r["archive"]] += bytes(r["content"])
    for r in table.collect():
        parts = [zlib.decompress(content[r["archive"]][x["offset"] : x["offset"] + x["length"]], 31) for x in index if x["archive"] == r["archive"]]
        assert b"".join(parts) == gzip.decompress(bytes(r["content"])) and all(p.startswith(b"WARC/1.1\r\n") for p in parts)
    assert normal.problems.count() == 0 and len(index) == len(rows)
    one = warc.read_records(normal.blocks, normal.index.where("record_id = '<urn:page:9>'")).collect()
    assert [(r["record_type"], r["refers_to"], r["payload"]) for r in one] == [("revisit", "<urn:page:2>", None)]
    got = sorted((r["record_id"][10:-1], r["record_type"], (r["refers_to"] or "")[10:-1], r["payload_bytes"], r["payload_digest"]) for r in warc.read_records(normal.blocks, normal.index).collect())
    sha = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    same4 = (4, sha("same"))
    long = rows[0][2]
    assert got == sorted([("5", "response", "", len(long.encode()), sha(long)), ("2", "response", "", *same4), ("2", "response", "", *same4), ("9", "revisit", "2", *same4), ("None", "revisit", "2", *same4), ("1", "response", "", 0, sha("")), ("7", "revisit", "1", 0, sha("")), ("None", "response", "", len(rows[7][2]), sha(rows[7][2]))])
    assert warc.write_archives(pages(spark, []).limit(0)).count() == 0
    small = warc.normalise(warc.write_archives(pages(spark, rows), least=10))
    assert {r["record_type"] for r in warc.read_records(small.blocks, small.index).collect()} == {"response"}


def records_of(data, size=None):
    pieces = [data] if size is None else [data[k : k + size] for k in range(0, len(data), size)]
    return [w for _, w in warc.split_records(warc.inflate(pieces))]


def test_warc_streams():
    r = [warc.record(k, "u", bytes([65 + k]) * n) for k, n in enumerate((0, 10, 200_000, 3, 3_000_000))]
    for data in (gzip.compress(b"".join(r)), b"".join(map(gzip.compress, r)), gzip.compress(r[0] + r[1]) + gzip.compress(b"".join(r[2:]))):
        for size in (None, 7, 1000):
            assert records_of(data, size) == r
    assert records_of(b"") == []


def test_warc_damaged(spark):
    r = [warc.record(k, "u", random.Random(k).randbytes(300)) for k in range(30)]
    sound = gzip.compress(b"".join(r))
    altered = bytearray(sound)
    altered[4000] ^= 0xFF
    wrong = b"".join(r[:2]) + r[2].replace(b"Content-Length: ", b"Content-Length: 9", 2) + r[3]
    archives = {
        "sound": sound, "cut": sound[:-2000], "no gzip": b"plain text, no archive", "altered": bytes(altered), "tail": sound + b"junk", "null": None, "empty": b"",
        "no warc": gzip.compress(b"HTTP/1.1 200\r\n\r\n"), "length": gzip.compress(wrong), "half": gzip.compress(b"".join(r)[:-10]),
    }
    normal = warc.normalise(spark.createDataFrame(list(archives.items()), "archive string, content binary"))
    problems = {r["archive"]: (r["error"], r["records"]) for r in normal.problems.collect()}
    assert problems.keys() == archives.keys() - {"sound", "null", "empty"}
    assert problems["tail"][1] == 30 and problems["no gzip"][1] == 0 and problems["half"] == ("record: cut off", 29) and 0 < problems["cut"][1] < 30
    held = {r["archive"]: r["n"] for r in normal.index.groupBy("archive").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert held["sound"] == 30 and all(held.get(a, 0) == n for a, (_, n) in problems.items())
    read = warc.read_records(normal.blocks, normal.index).collect()
    assert len(read) == sum(held.values()) and all(x["error"] is None and x["payload_bytes"] == 300 for x in read)
    # a member that is damaged after it was written
    blocks = normal.blocks.where("archive = 'sound'").selectExpr("archive", "block", "start", "cast(concat(substring(content, 1, 900), unhex('00000000'), substring(content, 905)) as binary) AS content")
    read = warc.read_records(blocks, normal.index.where("archive = 'sound'")).collect()
    assert len(read) == 30 and 1 <= sum(x["error"] is not None for x in read) <= 2


def test_warc_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 5000)
    r = [warc.record(k, "u", random.Random(k).randbytes(700)) for k in range(60)]
    whole = gzip.compress(b"".join(r))
    rows = [("a", k, whole[k * 999 : (k + 1) * 999]) for k in range(-(-len(whole) // 999))] + [("b", 0, gzip.compress(r[0]))]
    random.Random(1).shuffle(rows)
    normal = warc.normalise(spark.createDataFrame(rows, "archive string, seq long, content binary"))
    assert normal.problems.count() == 0 and normal.index.where("archive = 'a'").count() == 60 and normal.blocks.count() > 8
    assert {x["payload"] for x in warc.read_records(normal.blocks, normal.index).collect()} == {random.Random(k).randbytes(700) for k in range(60)}


def test_warc_query(spark, data):
    rows = spark.read.parquet(f"{data}/pages.parquet").collect()
    first = {}
    for r in rows:
        h = r["html"] or ""
        first[h] = min(first.get(h, r["page_id"]), r["page_id"])
    sha = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    want = sorted((r["page_id"], len(h.encode()), sha(h), "response" if first[h] == r["page_id"] else "revisit", -1 if first[h] == r["page_id"] else first[h]) for r in rows for h in [r["html"] or ""])
    got = queries()["op4_warc_normalise"](spark, data).collect()
    assert want == sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], -1 if r["refers_to"] is None else r["refers_to"]) for r in got)


def test_warc_query_keeps_long_heads(spark, tmp_path):
    rows = [(1, "http://a/", "<p>one</p>", "x"), (2, "http://b/" + "q" * 3_000_000, "<p>two</p>", "x"), (3, None, "<p>one</p>", "x"), (4, "http://c/", "z" * 3_000_000, "x")]
    pages(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries()["op4_warc_normalise"](spark, str(tmp_path)).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == [(1, 10, "response", None), (2, 10, "response", None), (3, 10, "revisit", 1), (4, 3_000_000, "response", None)]
    r = [warc.record(k, "http://a/" + "q" * n, b"p") for k, n in enumerate((0, 5_000_000, 3))]
    assert records_of(gzip.compress(b"".join(r))) == r and records_of(gzip.compress(r[1]), 50_000) == [r[1]]
    odd = warc.normalise(warc.write_archives(spark.createDataFrame([("a b\r\n\r\nc>", "u", "x"), ("a", "u", "x")], "page_id string, url string, html string")))
    assert sorted(x["record_id"] for x in warc.read_records(odd.blocks, odd.index).collect()) == ["<urn:page:a%20b%0D%0A%0D%0Ac%3E>", "<urn:page:a>"]


def test_warc_query_fails_rather_than_lose_rows(spark, tmp_path, monkeypatch):
    pages(spark, [(k, "u", "x" * k, "x") for k in range(40)]).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    write = warc.write_archives
    monkeypatch.setattr(warc, "write_archives", lambda *a, **o: write(*a, **o).selectExpr("archive", "substring(content, 1, length(content) - 30) AS content"))
    with pytest.raises(ValueError, match="damaged after"):
        queries()["op4_warc_normalise"](spark, str(tmp_path))
    monkeypatch.setattr(warc, "write_archives", lambda pages, **o: write(pages.where("page_id <> 3"), **o))
    with pytest.raises(ValueError, match="40 pages gave 39"):
        queries()["op4_warc_normalise"](spark, str(tmp_path))


CLASHING = ["__row", "__spans", "__packed", "__stats", "__rate", "__host", "__key", "__size", "__src", "__cell", "__s", "__h", "__post", "__n", "held0"]


@pytest.mark.parametrize(
    "operator",
    [
        lambda d: prefix_join.keep_one(d), lambda d: rlz.dedup(d), lambda d: suffix_dedup.dedup(d), lambda d: mixing.mix(d), lambda d: mixing.mix(d, F.length("__size").cast("long"), source="__src"),
        lambda d: mixing.copies(mixing.mix(d)), lambda d: host_rules.judge(d), lambda d: host_rules.judge(d, host="__host"), lambda d: quality_eb.classify(d, quality_eb.Model({h: {} for h in quality_eb.HEADS}, {h: np.zeros(12) for h in quality_eb.HEADS})),
    ],
)
def test_clashing_names_pass(make, corpus, operator):
    docs = make(corpus[:12]).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})
    out = operator(docs)
    assert set(docs.columns) - {"size"} <= set(out.columns)
    rows = out.select("doc_id", *CLASHING).collect()
    assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in CLASHING)


def test_two_threads_keep_their_tables(make, corpus):
    docs = make(corpus)
    want = sorted(map(tuple, prefix_join.near_components(docs).collect()))
    with concurrent.futures.ThreadPoolExecutor(2) as pool:
        found = list(pool.map(lambda _: sorted(map(tuple, prefix_join.near_components(docs).collect())), range(2)))
    assert found == [want, want]


def test_bpe_query(spark, data, coders):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries()["op5_bpe"](spark, data).collect()}
    assert got.keys() == docs.keys()
    for k, t in docs.items():
        ids = coders[1].encode_ordinary(t)
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        assert (got[k]["n_tokens"], got[k]["ids_sha256"], got[k]["decoded_sha256"]) == want


def test_shard_query(spark, data):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = queries()["op9_shard_kk"](spark, data).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    loads, slots, places = [0] * 24, [[] for _ in range(24)], {}
    for r in got:
        t = docs[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t.encode()) + 8, zlib.crc32(t.encode()), "bytes", None)
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert places.setdefault(t, r["shard"]) == r["shard"]
    assert all(sorted(x) == list(range(len(x))) for x in slots)
    groups = {}
    for t in docs.values():
        groups[t] = groups.get(t, 0) + len(t.encode()) + 8
    # no group may be cut, so the largest one bounds what is possible
    assert max(loads) - min(loads) <= max(0.02 * sum(loads) / 24, max(groups.values()) - min(loads))


def test_quality_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    got = queries()["op1_quality_eb"](spark, data).toPandas().set_index("doc_id")
    model = quality_eb.fit(docs, labels)
    own = docs.toPandas().set_index("doc_id").loc[got.index]
    z = model.score(own["text"])
    logit = lambda x: np.log(np.clip(x, 1e-6, 1 - 1e-6) / (1 - np.clip(x, 1e-6, 1 - 1e-6)))
    for h in quality_eb.HEADS:
        p = 1 / (1 + np.exp(-z[h]))
        assert np.allclose(got[f"doc_{h}"], p)
        assert np.allclose(got[h], 1 / (1 + np.exp(-(logit(p) + logit(got[f"path_{h}"]) - logit(p.mean())))), atol=1e-9)
        # a site has one posterior, between its own mean and that of what is above it
        sites = got.assign(p=p, source=own["source"].fillna("?"), lang=own["lang"].fillna("?")).groupby(["source", "lang"])
        assert (sites[f"path_{h}"].nunique() == 1).all()
        mean, post, host = sites["p"].mean(), sites[f"path_{h}"].first(), sites[f"host_{h}"].first()
        assert ((post >= np.minimum(mean, host) - 1e-9) & (post <= np.maximum(mean, host) + 1e-9)).all()


def brute_mix(pairs, sources):
    names = sorted({s for s in sources.values()}, key=lambda s: (s is None, s))
    size = {k: len((t or "").encode().split()) for k, (_, t) in enumerate(pairs)}
    total = {s: sum(size[k] for k in size if sources[k] == s) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    goal, capped = 1.5 * sum(total.values()), set()
    while True:
        rest = goal - sum(2 * total[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and rest * weight[s] / free > 2 * total[s]}
        if not over:
            return size, total, {s: 2.0 * total[s] if s in capped else rest * weight[s] / free for s in names}
        capped |= over


def test_mix(make, corpus):
    sources = {k: [None, "b", "a", "é", "big"][k % 5 if k % 2 else 4] for k in range(len(corpus))}
    pairs = list(enumerate(corpus))
    docs = make(pairs, sources=sources)
    size, total, target = brute_mix(pairs, sources)
    rows = mixing.mix(docs, buckets=3).collect()
    taken = {}
    for r in rows:
        s = sources[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[s] and np.isclose(r["target"], target[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}
    assert mixing.mix(docs.limit(0)).count() == 0
    out = mixing.copies(mixing.mix(docs)).groupBy("doc_id").agg({"text": "collect_list"}).collect()
    for r in out:
        assert sum(len(t.encode().split()) for t in r[1]) == again[r["doc_id"]]


def test_mix_ties_and_empty_texts(make):
    docs = make([(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "x y")], sources={k: "one" for k in range(5)})
    rows = mixing.mix(docs).collect()
    assert len(rows) == 5 and sum(r["taken"] for r in rows) == 12
    assert sum(r["taken"] for r in mixing.mix(make([(1, None), (2, "")])).collect()) == 0


def test_light_documents_share_no_range(make, monkeypatch):
    # two thirds weigh 1/21: their keys spread over the ranges as those of others do
    texts = [("### " * 30 if k % 3 else "word " * 30) for k in range(3000)]
    seen = {}
    monkeypatch.setattr(mixing, "materialise", lambda df, name, **o: seen.setdefault(name, df))
    mixing.mix(make(texts, sources={k: "s" for k in range(3000)}))
    assert max(r["count"] for r in seen["sizes"].groupBy("__cell").count().collect()) < 12


def test_mix_without_broadcast(make, corpus, monkeypatch):
    docs = make(corpus)
    want = sorted((r["doc_id"], r["taken"]) for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    assert want == sorted((r["doc_id"], r["taken"]) for r in mixing.mix(docs).collect())


def test_better_documents_are_taken_more(make):
    clean, dirty = "word " * 20, "word### " * 20
    docs = make([clean if k % 2 else dirty for k in range(600)], sources={k: "s" for k in range(600)})
    rows = mixing.mix(docs).collect()
    mean = lambda odd: np.mean([r["taken"] for r in rows if r["doc_id"] % 2 == odd])
    assert mean(1) > mean(0)


def test_shards(make, corpus):
    texts = [*corpus, *corpus[5:9], None, ""]
    rows = sharding.shard(make(texts)).collect()
    assert len(rows) == len(texts)
    loads, slots, where = {}, {}, {}
    for r in rows:
        t = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(t) + 8 and r["text_crc32"] == zlib.crc32(t) and r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 24
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert where.setdefault(t, r["shard"]) == r["shard"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard(make(texts).limit(0)).count() == 0


def test_shards_odd_rows(make):
    long = "long text " * 200_000
    rows = [(1, "same"), (1, "same"), (1, "other"), (None, "same"), (None, None), (7, long), (8, ""), (9, long)]
    got = sharding.shard(make(rows)).collect()
    assert len(got) == len(rows) and sorted(r["size"] for r in got) == sorted(len((t or "").encode()) + 8 for _, t in rows)
    where, slots = {}, {}
    for r in got:
        where.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(len(x) == 1 for x in where.values()) and len(where) == 4
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_very_long_texts_elsewhere(make, spark):
    long = "word " * 400_000
    docs = make([(1, long), (2, None), (1, long)])
    rows = media.media_columns(media.store_media(docs)).collect()
    assert {r["track"]["payload_bytes"] for r in rows} == {2_000_000, 64} and all(r["track"]["error"] is None for r in rows)
    table = warc.write_archives(docs.selectExpr("doc_id AS page_id", "source AS url", "text AS html"))
    normal = warc.normalise(table)
    assert sorted(r["payload_bytes"] for r in warc.read_records(normal.blocks, normal.index).collect()) == [0, 2_000_000, 2_000_000]
    mixed = {r["doc_id"]: r["size"] for r in mixing.mix(docs).collect()}
    assert mixed == {1: 400_000, 2: 0}


@pytest.mark.parametrize("block_rows,fan_in", [(10_000, 512), (50, 4), (20, 2)])
def test_differencing_levels(spark, block_rows, fan_in):
    rnd = random.Random(1)
    groups = [(bytes([k >> 8, k & 255]), rnd.randint(1, 10_000)) for k in range(600)]
    df = spark.createDataFrame(groups, "gkey binary, bytes long")
    got = sharding.shard_groups(df, 24, block_rows, fan_in).collect()
    assert len(got) == 600 and len({bytes(r["gkey"]) for r in got}) == 600
    size, loads = dict(groups), np.zeros(24)
    for r in got:
        loads[r["shard"]] += size[bytes(r["gkey"])]
    assert loads.max() - loads.min() <= (300 if block_rows >= 50 else 2500)


def test_difference_is_tight():
    rnd = random.Random(4)
    sizes = [rnd.randint(1, 10**6) for _ in range(500)]
    loads, members = sharding.difference([([s] + [0] * 3, [k] + [None] * 3) for k, s in enumerate(sizes)])
    assert sorted(x for m in members for x in sharding.leaves(m)) == list(range(500))
    assert all(sum(sizes[x] for x in sharding.leaves(m)) == v for m, v in zip(members, loads)) and loads[0] - loads[-1] < 500


def brute_measure(t):
    words = (t or "").encode().split()
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in (t or "")), len(lines), len(lines) - len(set(lines)), len(hit)


@settings(max_examples=200, deadline=None)
@given(st.none() | st.lists(st.sampled_from(["a", "b", " ", "\n", "#", "é", "\xa0", "\x1f", "\t", "a b a b"]), max_size=40).map("".join))
def test_measures(t):
    assert [tuple(x) for x in host_rules.measure([(t or "").encode()]).tolist()] == [brute_measure(t)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", " ", "\n", "#", "é", "a b a b\n"]), max_size=30).map("".join), max_size=8))
def test_measures_of_many_texts(texts):
    assert [tuple(x) for x in host_rules.measure([t.encode() for t in texts]).tolist()] == [brute_measure(t) for t in texts]


def test_host_verdicts(make):
    good = " ".join(f"w{k}" for k in range(60))
    texts = [good] * 40 + ["bad"] * 38 + [good] * 2
    sources = {k: f"g{k % 4}" if k < 40 else "junk" for k in range(80)}
    rows = {r["doc_id"]: r["__rules"] for r in host_rules.judge(make(texts, sources=sources)).collect()}
    assert all(rows[k]["kept"] for k in range(40))
    assert not any(rows[k]["kept"] for k in range(40, 80)) and not rows[79]["base_failed"] and rows[79]["host_rate"] > 0.5
    # a sparse host is pulled to the others: one bad document does not condemn it
    sources = {k: f"g{k}" for k in range(60)}
    rows = host_rules.judge(make([good] * 58 + ["bad", good], sources=sources | {58: "few", 59: "few"})).collect()
    assert {r["doc_id"] for r in rows if r["__rules"]["kept"]} == set(range(60)) - {58}


def brute_weight(sites):
    """Moments of (parent, n, s, q) rows, written out."""
    n = sum(x[1] for x in sites)
    sigma2 = sum(q - s * s / k for _, k, s, q in sites) / (n - len(sites))
    up = {p: (sum(x[1] for x in sites if x[0] == p), sum(x[2] for x in sites if x[0] == p)) for p in {x[0] for x in sites}}
    between = sum(k * (s / k - up[p][1] / up[p][0]) ** 2 for p, k, s, q in sites)
    tau2 = (between - (len(sites) - len(up)) * sigma2) / (n - sum(k * k / up[p][0] for p, k, _, _ in sites))
    return 1e6 if tau2 <= sigma2 / 1e6 else max(2.0, sigma2 / tau2)


def test_prior_weight(spark):
    from binweave.llm import shrink

    rnd = random.Random(2)
    sites = []
    for h in range(40):
        rate = rnd.betavariate(2, 3)
        n = rnd.randint(1, 200)
        x = sum(rnd.random() < rate for _ in range(n))
        sites.append((h % 7, n, float(x), float(x)))
    df = spark.createDataFrame(sites, "p int, n long, s double, q double")
    assert np.isclose(shrink.prior_weight(df, "n", "s", "q", ["p"]), brute_weight(sites))
    flat = shrink.prior_weight(df, "n", "s", "q")
    assert np.isclose(flat, brute_weight([(0, *x[1:]) for x in sites])) and 2 <= flat <= 12  # the true weight is 5
    same = spark.createDataFrame([(20, 10.0, 10.0)] * 9, "n long, s double, q double")
    assert shrink.prior_weight(same, "n", "s", "q") == 1e6
    ones = spark.createDataFrame([(1, float(k % 2), float(k % 2)) for k in range(9)], "n long, s double, q double")
    assert shrink.prior_weight(ones, "n", "s", "q") == 1e6 and shrink.prior_weight(ones.limit(0), "n", "s", "q") == 1e6


def test_one_document_hosts_are_drawn_to_the_prior(spark):
    # half of 1,000 hosts' only documents fail, as do half of a large host's: chance
    rows = [(f"h{k}", 1, k % 2) for k in range(1000)] + [("big", 1000, 500)]
    rates = {r["__host"]: r["rate"] for r in host_rules.host_rates(spark.createDataFrame(rows, "__host string, n long, failed long")).collect()}
    assert all(abs(v - 0.5) < 0.01 for v in rates.values())
    # where the large host is clean, one failure doesn't condemn a host
    rows = [(f"h{k}", 1, int(k < 100)) for k in range(1000)] + [("big", 5000, 0), ("bad", 400, 390)]
    rates = {r["__host"]: r["rate"] for r in host_rules.host_rates(spark.createDataFrame(rows, "__host string, n long, failed long")).collect()}
    assert rates["h0"] < 0.5 < rates["bad"] and rates["big"] < 0.01


def test_rules_odd_rows(make):
    docs = make([(1, None), (1, None), (None, ""), (2, "x " * 60_000)], sources={k: None for k in range(4)})
    rows = host_rules.judge(docs).collect()
    assert len(rows) == 4 and not any(r["__rules"]["kept"] for r in rows)
    assert host_rules.judge(docs.limit(0)).count() == 0


def test_classifier_on_held_out_rows(spark, data):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1").toPandas().set_index("doc_id")
    model = quality_eb.fit(docs, train)
    rows = quality_eb.classify(docs, model).where("doc_id % 2 = 1").select("doc_id", "__quality.*").toPandas().set_index("doc_id")
    both = test.join(rows, rsuffix="_p")
    assert ((both["quality_p"] >= 0.5) == (both["quality"] == 1)).mean() >= 0.95
    assert ((both["toxic_p"] >= 0.5) == (both["toxic"] == 1)).mean() >= 0.92
    clean = both[(both["quality"] == 1) & (both["toxic"] == 0)]
    assert clean["kept"].mean() >= 0.97


def test_classifier_odd_rows(spark, make):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, None, None), (None, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")
    docs = make(["good words here", "b### a###", None, "", "x"], sources={0: None})
    out = quality_eb.classify(docs, quality_eb.fit(docs, labels))
    assert out.count() == 5 and all(r["__quality"]["quality"] is not None for r in out.collect())
    empty = quality_eb.fit(docs, labels.limit(0))
    assert quality_eb.classify(docs, empty).count() == 5 and quality_eb.classify(docs.limit(0), empty).count() == 0


def test_site_posteriors_by_brute_force(spark):
    rnd = random.Random(8)
    rows = [(f"h{rnd.randrange(6)}" if rnd.random() < 0.9 else None, f"p{rnd.randrange(3)}", (rnd.random(), rnd.random() ** 3)) for _ in range(700)] + [("lone", None, (0.9, 0.1))]
    scored = spark.createDataFrame(rows, "source string, lang string, __s struct<quality:double,toxic:double>")
    posts, mean = quality_eb.site_posteriors(scored)
    got = {(r["__h"], r["__p"]): r for r in posts.collect()}
    for k, head in enumerate(quality_eb.HEADS):
        paths, hosts = {}, {}
        for h, p, s in rows:
            for table, key in ((paths, (h, p)), (hosts, h)):
                n, x, q = table.get(key, (0, 0.0, 0.0))
                table[key] = (n + 1, x + s[k], q + s[k] ** 2)
        m = sum(x[1] for x in hosts.values()) / len(rows)
        w, v = brute_weight([(0, *x) for x in hosts.values()]), brute_weight([(key[0], *x) for key, x in paths.items()])
        assert np.isclose(mean[head], m)
        for (h, p), (n, x, _) in paths.items():
            host = (hosts[h][1] + m * w) / (hosts[h][0] + w)
            assert np.isclose(got[h, p][f"host_{head}"], host) and np.isclose(got[h, p][f"path_{head}"], (x + host * v) / (n + v))


def test_classifier_very_long_text(spark, make):
    model = quality_eb.Model({h: {b"bad": -3.0} for h in quality_eb.HEADS}, {h: np.array([0.0] * 10 + [1.0, 0.0]) for h in quality_eb.HEADS})
    rows = {r["doc_id"]: r["__quality"] for r in quality_eb.classify(make(["good " * 300_000 + "bad", "good", "good"]), model).collect()}
    assert rows[0]["doc_quality"] < 0.1 and rows[1]["doc_quality"] == 0.5


def test_sites_shrink(spark, make):
    model = quality_eb.Model({"quality": {}, "toxic": {}}, {h: np.array([0.0, *[0.0] * 3, -8.0, *[0.0] * 7]) for h in quality_eb.HEADS})
    texts = ["a b c"] * 60 + ["a# b# c#"] * 60 + ["a b c"]
    sources = {k: f"g{k % 3}" if k < 60 else f"b{k % 3}" if k < 120 else "lone" for k in range(121)}
    rows = {r["doc_id"]: r["__quality"] for r in quality_eb.classify(make(texts, sources=sources), model).collect()}
    assert rows[0]["path_quality"] > rows[120]["host_quality"] > rows[60]["path_quality"]
    assert rows[0]["quality"] > rows[0]["doc_quality"] and rows[60]["quality"] < rows[60]["doc_quality"]


def test_pipeline(spark, data, coders):
    import corpus_pipeline

    from .test_dedup import brute_components, counted, covered

    rnd = random.Random(9)
    text = lambda n: " ".join("".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 6))) for _ in range(n))
    passage = text(80)
    texts = [text(90) for _ in range(12)] + [text(60) + " " + passage + " " + text(60) for _ in range(3)] + ["too short", None]
    texts += [texts[0], texts[1].replace(" ", "  ", 1), texts[2] + " extra"]
    import tempfile

    folder = tempfile.mkdtemp(prefix="spark-")
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    kept = [(i, t) for i, t in enumerate(texts) if len((t or "").split()) >= 50]
    comp = brute_components(kept)
    kept = [(i, t) for i, t in kept if comp[i][1] == i]
    counts = counted([t.encode() for _, t in kept], 200)
    cut = [(i, bytes(b for b, m in zip(t.encode(), covered(t.encode(), 200, counts)) if not m).decode()) for i, t in kept]
    sources = {k: f"s{i % 2}" for k, (i, _) in enumerate(cut)}
    assert any(len(a[1]) != len(b[1]) for a, b in zip(kept, cut))
    out = corpus_pipeline.run(spark, folder).collect()
    assert [n for n, _ in corpus_pipeline.STAGES] and {r["doc_id"] for r in out} <= {i for i, _ in cut}
    _, total, target = brute_mix(cut, sources)
    words = {}
    whole = dict(cut)
    for r in out:
        t = coders[0].decode(r["ids"]).decode()
        assert coders[1].encode_ordinary(t) == r["ids"] and r["n_tokens"] == len(r["ids"])
        assert t == whole[r["doc_id"]] or t.split() == whole[r["doc_id"]].split()[: len(t.split())]
        words[r["source"]] = words.get(r["source"], 0) + len(t.encode().split())
    assert all(abs(words[s] - target[s]) <= 1 for s in target)
