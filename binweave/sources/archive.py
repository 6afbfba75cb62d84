"""Members of zip and tar archives, and of compressed files, as lines."""

from __future__ import annotations

import bz2
import fnmatch
import gzip
import io
import tarfile
import warnings
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def members(content: bytes, wanted: list[str] | None) -> Iterator[tuple[str, bytes]]:
    """(name, bytes) of an archive's files; a name that isn't there gives a warning."""
    def inside(name: str) -> bool:
        return wanted is None or any(fnmatch.fnmatch(name, w) for w in wanted)

    seen: list[str] = []
    buffer = io.BytesIO(content)
    if zipfile.is_zipfile(buffer):
        with zipfile.ZipFile(buffer) as z:
            for info in z.infolist():
                if not info.is_dir() and inside(info.filename):
                    seen.append(info.filename)
                    yield info.filename, plain(info.filename, z.read(info))
    else:
        buffer.seek(0)
        with tarfile.open(fileobj=buffer, mode="r:*") as t:
            for info in t:
                if info.isfile() and inside(info.name):
                    seen.append(info.name)
                    yield info.name, plain(info.name, t.extractfile(info).read())
    for w in wanted or []:
        if not fnmatch.filter(seen, w):
            warnings.warn(f"{w} is not in the archive", stacklevel=2)


def plain(name: str, data: bytes) -> bytes:
    if name.endswith(".gz"):
        return gzip.decompress(data)
    return bz2.decompress(data) if name.endswith(".bz2") else data


def archive_lines(spark: SparkSession, path, wanted: list[str] | None = None) -> DataFrame:
    """(archive, member, value, seq) of the lines that aren't blank; archives are read side
    by side, each by one task (the formats can't be split)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"]):
                for name, data in members(content, wanted):
                    rows = [(k, x) for k, x in enumerate(data.decode().splitlines()) if x.strip()]
                    yield pd.DataFrame({"archive": file, "member": name, "value": [x for _, x in rows], "seq": [k for k, _ in rows]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "archive string, member string, value string, seq long")
