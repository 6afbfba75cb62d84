"""Vector code compression: product codes by slice-and-intersect search of the codebooks.

A vector is cut into equal parts; each part has a codebook, and a code is the index of the
nearest entry of each part. To find it, the entries' coordinates are sorted in each dimension,
and each place of that order carries the mask of the entries before it. A radius around a
part then is a range of places in each dimension, and the masks at the range's ends differ by
the entries inside it; the masks of all dimensions ANDed leave the entries within the cube,
the candidates. If their nearest lies within the radius it is the nearest of all; if not, its
distance is the next radius, and a cube without entries is doubled.

Codebooks start as the parts of the first vectors and are refined by rounds of assignment
and averages, all in integers. A round is one scan: tasks sum the parts of each entry, sums are
added by Spark, and the driver holds the codebooks alone, ENTRIES vectors at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise, small_batches
from .hashing import U
from .vectors import floors, matrix, of_one_length, slices, usable

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows that are compared with a codebook at once.
STEP = 1024


def root(n: np.ndarray) -> np.ndarray:
    """The least integers whose squares are at least n."""
    r = np.sqrt(n.astype(float)).astype(np.int64)
    r -= r * r > n
    return r + (r * r < n)


class Slices:
    """One part's codebook, indexed for exact nearest entries."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n, dims = entries.shape
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(entries, order, axis=0).T)
        bits = np.zeros((n, (n + 63) // 64), dtype=U)
        bits[np.arange(n), np.arange(n) // 64] = U(1) << (np.arange(n, dtype=U) & U(63))
        self.before = np.zeros((dims, n + 1, bits.shape[1]), dtype=U)
        for d in range(dims):
            np.bitwise_or.accumulate(bits[order[:, d]], axis=0, out=self.before[d, 1:])
        # half of the middle distance between the first entries that differ and their nearest
        self.radius = max(1, int(self._spacing()) // 2)

    def _spacing(self) -> float:
        far = ((self.entries[:, None, :] - self.entries[None, :, :]).astype(float) ** 2).sum(axis=2)
        far[far == 0] = np.inf
        nearest = far.min(axis=1)
        return float(np.sqrt(np.median(nearest))) if np.isfinite(nearest).all() else 2.0

    def within(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """For each row of x the mask of the entries whose coordinates all are within radius."""
        out = np.full((len(x), self.before.shape[2]), ~U(0), dtype=U)
        for d in range(x.shape[1]):
            lo = np.searchsorted(self.sorted[d], x[:, d] - radius, side="left")
            hi = np.searchsorted(self.sorted[d], x[:, d] + radius, side="right")
            out &= self.before[d, hi] ^ self.before[d, lo]
        return out

    def _best(self, x: np.ndarray, masks: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The candidates' nearest entry, the first of equals, and its squared distance (-1:
        none that near)."""
        bits = np.unpackbits(masks.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")
        row, entry = np.nonzero(bits)
        far, limit = np.zeros(len(row), dtype=np.int64), radius * radius
        code, best = np.zeros(len(x), dtype=np.int64), np.full(len(x), -1, dtype=np.int64)
        half = x.shape[1] // 2
        for d in range(x.shape[1]):
            if d == half and d:
                near = far <= limit[row]  # of the others the distance is beyond the radius already
                row, entry, far = row[near], entry[near], far[near]
            step = x[row, d] - self.entries[entry, d]
            far += step * step
        if len(row):
            first = np.flatnonzero(np.diff(row, prepend=-1))
            least = np.minimum.reduceat(far, first)
            found = row[first]
            best[found] = least
            place = np.flatnonzero(far == np.repeat(least, np.diff(np.append(first, len(row)))))
            code[row[place][::-1]] = entry[place][::-1]
        return code, best

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's nearest entry, the first of equals, and the squared distance."""
        code, best = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
        open_, radius = np.arange(len(x)), np.full(len(x), self.radius, dtype=np.int64)
        while len(open_):
            c, b = self._best(x[open_], self.within(x[open_], radius), radius)
            done = (b >= 0) & (b <= radius * radius)
            code[open_[done]], best[open_[done]] = c[done], b[done]
            radius = np.where(b >= 0, root(np.maximum(b, 0)), 2 * radius)[~done]
            open_ = open_[~done]
        return code, best


class Codebooks:
    """Entries (part, entry, position) of integers, and the search structures of the parts."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.parts = [Slices(e) for e in entries] if entries.size else []

    @property
    def dims(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (row, part) and squared distances of integer vectors."""
        width = self.entries.shape[2]
        found = [p.nearest(np.ascontiguousarray(x[:, k * width : (k + 1) * width])) for k, p in enumerate(self.parts)]
        return np.stack([c for c, _ in found], axis=1), np.stack([e for _, e in found], axis=1)

    def decode(self, codes: np.ndarray, scale: int = SCALE) -> np.ndarray:
        """The vectors that codes (row, part) stand for: the middles of the entries' steps."""
        return (self.entries[np.arange(len(self.parts)), codes].reshape(len(codes), -1) + 0.5) / scale

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def most(dims: int) -> int:
    """The largest integers whose squared distances in so many dimensions fit a long."""
    return int((2**62 // max(1, dims)) ** 0.5) // 2


def fit(rows: DataFrame, dims: int, parts: int = PARTS, size: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks of usable rows (vector, x0 the key) of that many dimensions. They start as the
    rows of the smallest keys, null ones last and equal ones by vector; an entry without parts
    stays. A length that the parts don't divide is refused."""
    if dims % parts:
        raise ValueError(f"{dims} dimensions can't be cut into {parts} equal parts")
    first = rows.orderBy(F.col("x0").isNull(), "x0", "vector").limit(size).toArrow()  # ``size`` rows at most
    width = dims // parts
    start = np.concatenate([np.zeros((0, dims), dtype=np.int64), *[floors(matrix(b, dims), scale, most(dims)) for b in first.combine_chunks().to_batches()]])
    books = Codebooks(start.reshape(-1, parts, width).transpose(1, 0, 2).copy())
    n = len(start)
    for _ in range(rounds if n else 0):

        def sums(batches: Iterator[pa.RecordBatch], books=books) -> Iterator[pa.RecordBatch]:
            count, total = np.zeros(parts * n, dtype=np.int64), np.zeros((parts * n, width), dtype=np.int64)
            for batch in slices(batches, STEP):
                x = floors(matrix(batch, dims), scale, most(dims))
                at = (books.assign(x)[0] + np.arange(parts) * n).ravel()
                np.add.at(count, at, 1)
                np.add.at(total, at, x.reshape(-1, width))
            held = np.flatnonzero(count)
            yield pa.RecordBatch.from_pydict({"entry": held, "n": count[held], "total": list(total[held])}, schema=pa.schema([("entry", pa.int64()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]))

        found = rows.select("vector").mapInArrow(lean(sums), "entry long, n long, total array<long>")
        found = found.select("entry", "n", F.posexplode("total").alias("at", "x")).groupBy("entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        found = found.toArrow()  # one row per entry and position at most
        flat = books.entries.reshape(-1, width).copy()
        flat[found["entry"].to_numpy(), found["at"].to_numpy()] = found["x"].to_numpy() // found["n"].to_numpy()
        books = Codebooks(flat.reshape(parts, n, width))
    return books


def encode(rows: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """Usable rows (vector, x0, ...) with code (two hex digits for each part; more where
    codebooks are larger) and error (squared distances summed over parts) for the vector."""
    rest = [f for f in rows.schema.fields if f.name != "vector"]
    kind = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in rest], "code string, error long"])
    dims, digits = books.dims, max(2, len(f"{max(0, books.entries.shape[1] - 1):x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([f"{k:0{digits}x}" for k in range(books.entries.shape[1])], dtype=object)
        for batch in slices(batches, STEP):
            codes, errors = books.assign(floors(matrix(batch, dims), scale, most(dims)))
            text = names[codes].sum(axis=1)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in rest], pa.array(text, pa.string()), pa.array(errors.sum(axis=1))], names=[*[f.name for f in rest], "code", "error"])

    return rows.select("vector", *[f.name for f in rest]).mapInArrow(lean(run), kind)


def compress(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", **options) -> tuple[DataFrame, Codebooks]:
    """Rows (key, label, code, error, label_error), as x0, x1 and these names, and the
    codebooks. Vectors that are null, empty or hold a null or a number that isn't finite go, and
    so do those of another length than most have. A null key is a key, a null label one of its
    own; rows that repeat are coded alike and all count; other columns aren't read; no rows, no
    rows. label_error: the errors of all rows of the label; a label's rows are summed before
    they are shuffled, and the sums come back as a table of their own, which Spark broadcasts if
    its size allows it and joins by shuffle, splitting hot labels, if not."""
    small_batches(rows.sparkSession)
    found, dims = of_one_length(usable(rows, vector, key, label))
    books = fit(found, dims, **options) if dims else Codebooks(np.zeros((PARTS, 0, 0), dtype=np.int64))
    coded = materialise(encode(found, books) if dims else found.select("x0", "x1", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), "codes")
    sums = materialise(coded.groupBy(F.col("x1").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.join(sums, F.col("x1").eqNullSafe(F.col("of"))).drop("of"), books


def op11_vector_codes(spark, sf_dir) -> DataFrame:
    rows, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.select(F.col("x0").alias("vec_id"), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _sql() -> str:
    """One statement: the rounds are written out, each from the one before."""
    far = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    pairs = lambda books: f"SELECT r, vec_id, label, part, entry, v.x, {far}::BIGINT AS d FROM p v JOIN {books} c USING (part)"
    pick = lambda books: f"SELECT r, vec_id, label, part, min_by(entry, d * 1000 + entry) AS entry, min(d) AS far, any_value(x) AS x FROM ({pairs(books)}) GROUP BY r, vec_id, label, part"
    steps = [
        f"k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT r, vec_id, label, t.part, x[t.part * (len(x) // {PARTS}) + 1:(t.part + 1) * (len(x) // {PARTS})] AS x FROM k, range({PARTS}) t(part))",
        f"c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x FROM p WHERE r <= {ENTRIES})",
    ]
    for n in range(ROUNDS):
        steps += [
            f"a{n} AS MATERIALIZED ({pick(f'c{n}')})",
            f"m{n} AS MATERIALIZED (SELECT part, entry, list(q ORDER BY pos) AS x FROM (SELECT part, entry, pos, floor(sum(y)::BIGINT / count(*))::BIGINT AS q FROM (SELECT part, entry, unnest(x) AS y, generate_subscripts(x, 1) AS pos FROM a{n}) GROUP BY part, entry, pos) GROUP BY part, entry)",
            f"c{n + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m USING (part, entry))",
        ]
    steps += [
        f"a AS MATERIALIZED ({pick(f'c{ROUNDS}')})",
        f"h AS (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(x) AS y, generate_subscripts(x, 1) AS pos FROM c{ROUNDS}))",
        "e AS (SELECT r, vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a GROUP BY r, vec_id, label)",
        "l AS (SELECT label, sum(error)::BIGINT AS label_error FROM e GROUP BY label)",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, label_error, codebooks_sha256 FROM e JOIN l ON e.label IS NOT DISTINCT FROM l.label, h"


SQL = _sql()
