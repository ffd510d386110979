"""Product codes against exhaustive integer distances."""

import hashlib

import numpy as np
import pytest
from meshweave.llm.product_codes import Cells, product_codes

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, rounds=4):
    """code, error of each usable row, in order, and the digest; rows have one length."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    x = np.floor(1024 * np.array([np.float32(r[1]).astype(float) for r in kept])).astype(np.int64).astype(object)
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, x[i].tolist()))
    parts = np.array(np.split(x, 4, axis=1))
    books = [p[order[:256]].copy() for p in parts]

    def nearest(p, book):
        d = ((p[:, None, :] - book[None]) ** 2).sum(axis=2)
        return [min(range(len(book)), key=lambda e: (row[e], e)) for row in d], d

    for _ in range(rounds):
        for p, book in zip(parts, books, strict=True):
            at = np.array(nearest(p, book)[0])
            for e in range(len(book)):
                if (at == e).any():
                    book[e] = [sum(c) // int((at == e).sum()) for c in p[at == e].T]
    found = [nearest(p, book) for p, book in zip(parts, books, strict=True)]
    codes = ["".join(f"{f[0][i]:02x}" for f in found) for i in range(len(kept))]
    errors = [int(sum(f[1][i, f[0][i]] for f in found)) for i in range(len(kept))]
    digest = hashlib.sha256(",".join(str(v) for b in books for row in b for v in row).encode()).hexdigest()
    sums = {}
    for r, e in zip(kept, errors, strict=True):
        sums[r[2]] = sums.get(r[2], 0) + e
    return sorted(((r[0], c, e, sums[r[2]], digest) for r, c, e in zip(kept, codes, errors, strict=True)), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def vectors(n, dims, seed, spread):
    draw = np.random.default_rng(seed)
    center = draw.normal(size=(9, dims)) * spread
    x = (center[draw.integers(0, 9, n)] + draw.normal(size=(n, dims))).astype(np.float32)
    return [(int(i) - 5, v.tolist(), int(i) % 7 if i % 11 else None) for i, v in enumerate(x)]


@pytest.mark.parametrize(("n", "dims", "spread"), [(700, 8, 3.0), (300, 16, 0.0), (40, 12, 1.0)])
def test_against_all_distances(spark, n, dims, spread):
    rows = vectors(n, dims, n, spread)
    got = product_codes(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert found(got) == plain(rows)


def test_ties_and_unused_entries(spark):
    """Few distinct values: most entries are equal, so all but the first of equals stay unused."""
    rows = [(i, [float(i % 3), -0.5, 0.25 * (i % 2), 2.0], 1) for i in range(600)]
    assert found(product_codes(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, -0.2, 0.3, 0.4], None), (1, [0.1, -0.2, 0.3, 0.4], None), (2, None, 3), (3, [nan, 0.0, 0.0, 0.0], 3), (4, [inf, 0.0, 0.0, 0.0], 3), (5, [None, 0.0, 0.0, 0.0], 3), (None, [1.0, 2.0, 3.0, 4.0], None), (7, [-1e-9, 0.0, -0.0, 5.0], 2)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", code bigint, error string")
    assert found(product_codes(docs)) == plain(rows)
    others = spark.createDataFrame([*rows, (9, [1.0] * 8, 5), (10, [1.0] * 3, 5), (11, [], 5)], SCHEMA)
    got = found(product_codes(others))
    assert [r[0] for r in got if r[0] in (9, 10, 11)] == [11, 9]  # three components cannot be cut in four; other lengths have their own codebooks
    assert [r for r in got if r[0] not in (9, 11)] == plain(rows)


def test_empty_table(spark):
    assert found(product_codes(spark.createDataFrame([], SCHEMA))) == []


def test_too_large_components(spark):
    with pytest.raises(Exception, match="too large"):
        product_codes(spark.createDataFrame([(1, [1e30, 0.0, 0.0, 0.0], 1)], SCHEMA)).collect()


def test_bounds_hold_and_exclude():
    draw = np.random.default_rng(3)
    book, q = draw.integers(-3000, 3000, (256, 16)), draw.integers(-3000, 3000, (500, 16))
    cells = Cells(book)
    least, most = cells.bounds(q)
    true = ((q[:, None] - book[None]) ** 2).sum(axis=2)
    assert (least <= true).all() and (true <= most).all()
    entry, distance, measured = cells.nearest(q)
    assert (entry == true.argmin(axis=1)).all() and (distance == true.min(axis=1)).all()
    assert measured < 0.2 * true.size
