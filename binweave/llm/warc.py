"""WARC archives: writing, normalising whole-file gzip streams, indexed reading.

``write_archives`` writes a table of archives, each one gzip stream over many records, as
tools that pipe a WARC through gzip leave them. ``normalise`` inflates such a stream once,
piece by piece, and rewrites every record as a gzip member of its own; members go to blocks
of about BLOCK bytes, and a sidecar table holds each record's offset and length.
``read_records`` takes the offsets from the sidecar and inflates only the members.

An archive is one row, or, where it is too long for that, several in order of ``seq``. A gzip
stream has no places to start at, so one archive is one task's, in any engine; what the
task holds is a piece, a record and a block. Everything is Parquet below the shared
folder, so any executor can read what another one wrote.

Archives come from anywhere: one that isn't gzip, or is cut off or altered, gives the records
up to there and a row in ``problems``.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise, small_batches

#: Bytes of records after which an archive is closed; a longer record has one of its own.
ARCHIVE = 8 << 20
#: Bytes of members after which a block is closed; a longer member has one of its own.
BLOCK = 1 << 20
#: Bytes that are inflated at a time.
PIECE = 1 << 16
LEVEL = 1
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def name(key) -> str:
    """A key as part of a URN."""
    return quote(str(key), safe="")


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """A response record, or a revisit record: its HTTP head without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name(page_id)}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + " ".join((url or "urn:none").split()),
        "WARC-Payload-Digest: sha1:" + payload_digest(payload),
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{name(refers_to)}>"]
    block = http if revisit else http + payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    pairs = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs if k}


class Damaged(ValueError):
    """What follows in an archive can't be read."""


def inflate(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The content of a gzip file of one or many members, given and returned in pieces."""
    d, open_member = zlib.decompressobj(31), False
    for data in pieces:
        for at in range(0, len(data), PIECE):
            rest = data[at : at + PIECE]
            while rest:
                open_member = True
                try:
                    if out := d.decompress(rest, PIECE * 4):
                        yield out
                except zlib.error as e:
                    raise Damaged(f"gzip: {e}") from None
                rest = d.unconsumed_tail
                if d.eof:
                    rest, d, open_member = d.unused_data, zlib.decompressobj(31), False
    while open_member and (out := d.decompress(d.unconsumed_tail, PIECE * 4)):
        yield out
    if open_member and not d.eof:
        raise Damaged("gzip: the stream is cut off")


def split_records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and whole bytes of each record. What is held is one record, of whatever
    length its head and its block have, and one piece."""
    buffer = bytearray()
    need, head, seen = 0, None, 0
    for piece in pieces:
        buffer += piece
        while True:
            if head is None:
                if not buffer.startswith(b"WARC/"[: len(buffer)]):
                    raise Damaged("record: not a WARC head")
                if (cut := buffer.find(b"\r\n\r\n", seen)) < 0:
                    seen = max(0, len(buffer) - 3)  # a long head is searched once
                    break
                head = fields(bytes(buffer[:cut]))
                length = head.get("content-length", "")
                if not length.isdecimal():
                    raise Damaged("record: no length")
                need = cut + 4 + int(length) + 4
            if len(buffer) < need:
                break
            if buffer[need - 4 : need] != b"\r\n\r\n":
                raise Damaged("record: its length is wrong")
            yield head, bytes(buffer[:need])
            del buffer[:need]
            head, seen = None, 0
    if buffer:
        raise Damaged("record: cut off")


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Rows (archive, content): a record for each row of pages, payload the html as UTF-8,
    null an empty one. Of records with equal payloads of at least ``least`` bytes that with
    the smallest key is the response and the others revisit it; smaller payloads are all
    responses. Rows that repeat the smallest key are responses too; a null key comes last,
    and if a payload has no other it stays a response. A very long payload has an archive of
    its own; other columns aren't read; no pages, no archives."""
    rows = pages.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{key}`").alias("order"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")).withColumn("digest", F.unhex(F.sha1("html")))
    firsts = rows.groupBy("digest").agg(F.min("order").cast("string").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # a table of its own: the join can be split where one payload has many rows
    firsts = materialise(firsts, "firsts")
    rows = rows.join(firsts, "digest", "left").select("key", "url", "html", "first")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        deflate, out, size, name = None, [], 0, None

        def close() -> pd.DataFrame:
            out.append(deflate.flush())
            return pd.DataFrame({"archive": [name], "content": [b"".join(out)]})

        for pdf in batches:
            for k, u, h, f in zip(pdf["key"], pdf["url"], pdf["html"], pdf["first"]):
                payload = h.encode()
                again = isinstance(f, str) and k != f and len(payload) >= least
                r = record(k, u if isinstance(u, str) else None, payload, f, again)
                if deflate and size + len(r) > ARCHIVE:
                    yield close()
                    deflate = None
                if not deflate:
                    deflate, out, size, name = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), [], 0, f"page-{k}-{hashlib.sha1(r).hexdigest()[:12]}"
                out.append(deflate.compress(r))
                size += len(r)
        if deflate:
            yield close()

    return rows.mapInPandas(lean(run), "archive string, content binary")


class Normalised(NamedTuple):
    blocks: DataFrame  #: (archive, block, start, content): members, and where in the archive they start
    index: DataFrame  #: the sidecar: (archive, block, offset, length, record_id, record_type)
    problems: DataFrame  #: (archive, error, records): archives that can't be read to their end


ENTRY = "array<struct<offset:long,length:long,record_id:string,record_type:string>>"


def normalise(archives: DataFrame) -> Normalised:
    """Tables of the archives (archive, content), or (archive, seq, content) where one is
    several rows, rewritten so that each record is a gzip member of its own. An empty or null
    content has no records; a null name is a name; equal names without ``seq`` are archives of
    their own; records and heads of any length are kept whole; other columns go."""
    whole = "seq" not in archives.columns
    rows = archives.select("archive", "content", *([] if whole else ["seq"]))
    if not whole:
        rows = rows.repartition("archive").sortWithinPartitions("archive", "seq")
    small_batches(archives.sparkSession)

    def members(name, pieces: Iterable[bytes]) -> Iterator[pd.DataFrame]:
        out, index, at, block, start, count, error = [], [], 0, 0, 0, 0, None

        def close(error: str | None = None) -> pd.DataFrame:
            nonlocal out, index, block, start
            row = {"archive": [name], "block": [block], "start": [start], "content": [b"".join(out)], "index": [index], "error": [error], "records": [count]}
            out, index, block, start = [], [], block + 1, at
            return pd.DataFrame(row)

        try:
            for head, record in split_records(inflate(pieces)):
                c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = c.compress(record) + c.flush()
                if out and at - start + len(member) > BLOCK:
                    yield close()
                index.append({"offset": at, "length": len(member), "record_id": head.get("warc-record-id"), "record_type": head.get("warc-type")})
                out.append(member)
                at += len(member)
                count += 1
        except Damaged as e:
            error = str(e)
        if out or error:
            yield close(error)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = itertools.count()
        each = ((next(row) if whole else None, a, c) for pdf in batches for a, c in zip(pdf["archive"], pdf["content"]))
        for (_, name), group in itertools.groupby(each, lambda x: x[:2]):
            yield from members(name, (bytes(c) for _, _, c in group if c is not None))

    kind = f"archive string, block long, start long, content binary, index {ENTRY}, error string, records long"
    out = materialise(rows.mapInPandas(lean(run), kind), "warc-normal", compression="uncompressed")
    index = out.select("archive", "block", F.explode("index").alias("x")).select("archive", "block", "x.*")
    return Normalised(
        out.where("size(index) > 0").select("archive", "block", "start", "content"),
        materialise(index, "warc-index"),
        out.where("error IS NOT NULL").select("archive", "error", "records"),
    )


def read_records(blocks: DataFrame, index: DataFrame) -> DataFrame:
    """A row per entry of the sidecar, all or some: record_id, record_type, target_uri,
    refers_to, payload_bytes and payload_digest (of a revisit: of the payload it revisits,
    as its headers give them; of a response: counted and computed from the payload), payload
    (null for revisits) and error, null but for a member that can't be read. Blocks without
    wanted entries are not inflated."""
    kind = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary, error string"

    def read(member: bytes, entry: str | None, type_: str | None) -> tuple:
        try:
            whole = zlib.decompress(member, 31)
            head_end = whole.index(b"\r\n\r\n")
            head = fields(whole[:head_end])
            block = whole[head_end + 4 : head_end + 4 + int(head["content-length"])]
            http, _, body = block.partition(b"\r\n\r\n")
            if head["warc-type"] == "revisit":
                size, digest, body = int(fields(http)["content-length"]), head["warc-payload-digest"].removeprefix("sha1:"), None
            else:
                size, digest = len(body), payload_digest(body)
            return head["warc-record-id"], head["warc-type"], head.get("warc-target-uri"), head.get("warc-refers-to"), size, digest, body, None
        except (zlib.error, ValueError, KeyError) as e:
            return entry, type_, None, None, None, None, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content, start, wanted in zip(pdf["content"], pdf["start"], pdf["wanted"]):
                rows = [read(content[x["offset"] - start : x["offset"] - start + x["length"]], x["record_id"], x["record_type"]) for x in wanted]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in kind.split(", ")])

    wanted = index.groupBy(F.col("archive").alias("__a"), F.col("block").alias("__b")).agg(F.collect_list(F.struct("offset", "length", "record_id", "record_type")).alias("wanted"))
    both = blocks.join(wanted, F.col("archive").eqNullSafe(F.col("__a")) & (F.col("block") == F.col("__b")))
    return both.select("content", "start", "wanted").mapInPandas(lean(run), kind)


def op4_warc_normalise(spark, sf_dir) -> DataFrame:
    """Fails, rather than give fewer rows than pages, if an archive or a member can't be read."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    normal = normalise(materialise(write_archives(pages), "warc", compression="uncompressed"))
    if problem := normal.problems.first():
        raise ValueError(f"archive {problem['archive']} is damaged after {problem['records']} records: {problem['error']}")
    if (have := normal.index.count()) != (want := pages.count()):
        raise ValueError(f"{want} pages gave {have} records")
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(.*)>', 1) AS BIGINT)")
    whole = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("a member can't be read: "), "error"))).otherwise(F.col("record_type"))
    return read_records(normal.blocks, normal.index).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", whole.alias("record_type"), page("refers_to").alias("refers_to"))
