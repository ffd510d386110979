"""Codes of vectors by parts, with integer codebooks; nearest entries are found as in a VA-file (Weber et al. 1998).

The coordinates of a codebook's entries are quantised to a few bits, axis by axis.  For a
vector's part two tables an axis, one value a cell, have the least and the largest squared distance to the cell; their
sums bound the distance to every entry from below and above.  Entries whose lower bound exceeds the least
upper bound are out, the others are measured exactly, in integers.

A round is one scan: tasks assign their vectors and send sums and counts for each entry, no vector is exchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, sliced
from .vectors import matrix

PARTS = 4
#: Entries of a codebook (a byte names one) and rounds of training.
ENTRIES, ROUNDS = 256, 4
#: Bits of a cell: sixteen cells an axis.
BITS = 4
#: Vectors whose bounds are held at a time.
AT_ONCE = 1024
#: Labels whose sums are sent to all tasks; more are joined through an exchange.
FEW_LABELS = 10_000


class Cells:
    """One part's codebook (entry, axis) with its coordinates as cells; low and high are what a cell's members span."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        n, axes = entries.shape
        self.entries, cells = entries, 1 << bits
        self.cell = np.zeros((axes, n), np.intp)
        self.low, self.high = np.zeros((axes, cells), np.int64), np.zeros((axes, cells), np.int64)
        for k in range(axes):
            own = entries[:, k]
            self.cell[k] = np.searchsorted(np.sort(own), own) * cells // n  # equal shares of the entries; equal values share a cell
            self.low[k], self.high[k] = own.max(), own.min()
            np.minimum.at(self.low[k], self.cell[k], own)
            np.maximum.at(self.high[k], self.cell[k], own)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of squared distances, (vector, entry)."""
        least, most = np.zeros((2, len(q), len(self.entries)), np.int64)
        for k, cell in enumerate(self.cell):
            under, over = self.low[k] - q[:, k, None], q[:, k, None] - self.high[k]
            least += (np.maximum(np.maximum(under, over), 0) ** 2)[:, cell]
            most += (np.maximum(-under, -over) ** 2)[:, cell]
        return least, most

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index (ties to the lower) and squared distance of each row's nearest entry, and how many entries were measured."""
        least, most = self.bounds(q)
        at, entry = np.nonzero(least <= most.min(axis=1, keepdims=True))
        off = q[at] - self.entries[entry]
        distance = np.einsum("ij,ij->i", off, off)
        best = np.minimum.reduceat(distance, np.searchsorted(at, np.arange(len(q))))
        hit = np.flatnonzero(distance == best[at])
        return entry[hit[np.searchsorted(at[hit], np.arange(len(q)))]], best, len(at)


def _parts(column: pa.Array) -> np.ndarray:
    """(vector, part, axis) integers of vectors of one length."""
    scaled = np.floor(1024 * matrix(column))
    width = scaled.shape[1] // PARTS
    if len(scaled) and np.abs(scaled).max(initial=0) >= isqrt(2**61 // max(1, PARTS * width)) // 2:
        raise ValueError("a component is too large for exact distances of 64 bits")
    return scaled.astype(np.int64).reshape(len(scaled), PARTS, width)


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches of vectors of one length, with it."""
    for batch in sliced(batches, AT_ONCE):
        sizes = batch.column("vec").value_lengths().to_numpy()
        for size in np.unique(sizes).tolist():
            yield size, batch if (sizes == size).all() else batch.filter(pa.array(sizes == size))


def _round(rows: DataFrame, books: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The codebooks, by length of the vectors, after one more round."""
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = {size: [Cells(part) for part in book] for size, book in sent.value.items()}
        total = {size: np.zeros(book.shape, np.int64) for size, book in sent.value.items()}
        count = {size: np.zeros(book.shape[:2], np.int64) for size, book in sent.value.items()}
        for size, batch in _by_length(batches):
            for p, q in enumerate(_parts(batch.column("vec")).swapaxes(0, 1)):
                entry = cells[size][p].nearest(q)[0]
                np.add.at(total[size][p], entry, q)
                count[size][p] += np.bincount(entry, minlength=count[size].shape[1])
        for size, n in count.items():
            part, entry = np.nonzero(n)
            sums = total[size][part, entry]
            ends = np.arange(len(part) + 1, dtype=np.int32) * sums.shape[1]
            columns = [pa.array(np.full(len(part), size)), pa.array(part), pa.array(entry), pa.array(n[part, entry]), pa.ListArray.from_arrays(pa.array(ends), pa.array(sums.ravel()))]
            yield pa.RecordBatch.from_arrays(columns, ["size", "part", "entry", "n", "sums"])

    found = rows.mapInArrow(run, "size bigint, part bigint, entry bigint, n bigint, sums array<bigint>")
    # one row for each coordinate of an entry: bounded by the codebooks
    whole = found.select("size", "part", "entry", "n", F.posexplode("sums").alias("axis", "value")).groupBy("size", "part", "entry", "axis").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
    out = {size: book.copy() for size, book in books.items()}
    for size, part, entry, axis, n, value in whole.collect():
        out[size][part, entry, axis] = value // n
    sent.unpersist()
    return out


def _digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def product_codes(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector.

    Components are floor(1024 * x).  A codebook starts as the parts of the 256 smallest ids (of rows that repeat an
    id, the lesser vectors first).  Each round assigns all parts to the nearest entries, ties to the
    lower index, and moves entries to the floored means of their parts; an unused entry stays.

    Rows whose vector is null or holds null or non-finite components are left out, and so are vectors whose
    length four does not divide; vectors of several lengths have codebooks of their own.  A null id is kept and comes last
    among the ids, null labels are one label, repeated rows are coded each, and an empty table gives an empty
    result.  Components beyond some 2**27 have no exact 64-bit distances and raise an error.  Other columns, of any names, are ignored.
    """
    vec = F.col(vector).cast("array<double>")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = rows.select(F.col(key).cast("bigint").alias("vec_id"), vec.alias("vec"), F.col(label).alias("label")).where(F.col("vec").isNotNull() & finite & (F.size("vec") % PARTS == 0))
    books = {}
    for size in sorted(r[0] for r in kept.select(F.size("vec")).distinct().collect()):
        first = kept.where(F.size("vec") == size).orderBy(F.asc_nulls_last("vec_id"), "vec").select("vec").limit(ENTRIES).collect()
        book = _parts(pa.array([r[0] for r in first], pa.list_(pa.float64()))).swapaxes(0, 1)
        books[size] = np.ascontiguousarray(book)
    for _ in range(rounds if books else 0):
        books = _round(kept.select("vec"), books)
    sent = rows.sparkSession.sparkContext.broadcast((books, {size: _digest(book) for size, book in books.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = {size: [Cells(part) for part in book] for size, book in sent.value[0].items()}
        for size, batch in _by_length(batches):
            found = [cells[size][p].nearest(q) for p, q in enumerate(_parts(batch.column("vec")).swapaxes(0, 1))]
            codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            code = [x.tobytes().hex() for x in codes]
            error = sum(f[1] for f in found)
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error), pa.array([sent.value[1][size]] * len(code), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error", "codebooks_sha256"])

    kind = kept.schema["label"].dataType.simpleString()
    coded = checkpointed(kept.mapInArrow(run, f"vec_id bigint, label {kind}, code string, error bigint, codebooks_sha256 string"))
    sums = checkpointed(coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error")))
    sums = F.broadcast(sums) if sums.count() <= FEW_LABELS else sums
    return coded.join(sums, F.col("label").eqNullSafe(F.col("__label"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
