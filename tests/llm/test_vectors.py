import numpy as np
import pytest
from meshweave.llm import exact_topk
from meshweave.llm.ann import hadamard, nearest_neighbours
from meshweave.llm.exact_topk import exact_top_k
from pyspark.sql import functions as F

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string"


@pytest.fixture(scope="module")
def odd_rows():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 12)) * rng.uniform(0.2, 3, (400, 1))
    rows = [(i, [float(v) for v in x[i].astype(np.float32)], 1, "s") for i in range(400)]
    rows += [(i, rows[7][1], None, None) for i in range(400, 600)]  # copies
    rows += [(20, rows[20][1], 1, "s")]  # a repeated row
    rows += [(600, None, 1, ""), (620, [], 1, ""), (640, [None] * 12, 1, ""), (660, [float("nan")] * 12, 1, ""), (680, [float("inf")] * 12, 1, ""), (700, [0.0] * 12, 1, ""), (None, rows[1][1], 1, ""), (720, [1.0, 2.0], 1, ""), (740, [1.0, 1.0], 1, "")]
    return rows


def brute(rows, every, k, integer):
    seen = {}
    for i, v, *_ in rows:
        if i is None or not v or any(c is None or not np.isfinite(c) for c in v):
            continue
        v = np.array(v, np.float32).astype(np.float64)
        if integer:
            v = np.floor(1024 * v)
        elif not v.any():
            continue
        seen[i] = v
    out = {}
    for q, v in seen.items():
        if q % every == 0:
            scored = sorted((-float(v @ x), i) for i, x in seen.items() if i != q and len(x) == len(v))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_hadamard_keeps_lengths_and_is_its_own_inverse():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(hadamard(hadamard(x)), x)


def test_exact_top_k_equals_brute_force(spark, odd_rows):
    got = exact_top_k(spark.createDataFrame(odd_rows, SCHEMA), F.pmod("vec_id", F.lit(10)) == 0).collect()
    want = brute(odd_rows, 10, 10, True)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found == {q: [(i, int(s)) for i, s in v] for q, v in want.items() if v}


def test_found_neighbours_are_exact_and_recalled(spark, odd_rows):
    got = nearest_neighbours(spark.createDataFrame(odd_rows, SCHEMA), F.pmod("vec_id", F.lit(20)) == 0).collect()
    want = brute(odd_rows, 20, 20, False)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    vectors = {i: np.array(v, np.float32).astype(float) for i, v, *_ in odd_rows if v and i is not None and v[0] is not None}
    hits = 0
    for q, v in found.items():
        assert [s for _, s in v] == sorted((s for _, s in v), reverse=True)
        assert all(i != q and np.isclose(s, vectors[q] @ vectors[i]) for i, s in v)
        kth = want[q][-1][1]
        hits += sum(s >= kth - 1e-9 for _, s in v)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_recall_on_the_test_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    data = rows.collect()
    want = brute([(r.vec_id, r.embedding) for r in data], 20, 20, False)
    got = {(r.query_id, r.vec_id) for r in nearest_neighbours(rows, F.pmod("vec_id", F.lit(20)) == 0).collect()}
    assert len(got & {(q, i) for q, v in want.items() for i, _ in v}) >= 0.9 * sum(map(len, want.values()))


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_top_k(none, F.col("vec_id") == 0).collect() == []
    assert nearest_neighbours(none, F.col("vec_id") == 0).collect() == []


@pytest.mark.parametrize("lengths", ["few", "long", "longest", "spread"])
def test_recall_with_unequal_norms_and_few_rows(spark, lengths):
    rng = np.random.default_rng(8)
    n = 15 if lengths == "few" else 3000
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if lengths == "spread":
        x *= rng.lognormal(0, 0.5, (n, 1))
    elif lengths != "few":
        x[7] *= 3 if lengths == "long" else 20
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    every = 3 if lengths == "few" else 20
    want = {(q, i) for q, v in brute(rows, every, 20, False).items() for i, _ in v}
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {(r.query_id, r.vec_id) for r in nearest_neighbours(docs, F.pmod("vec_id", F.lit(every)) == 0).collect()}
    assert len(got) == len(want)
    assert len(got & want) >= (len(want) if lengths == "few" else 0.9 * len(want))


def test_joint_bounds_hold_and_rule_out_rows():
    """Bounds of all pivots together are never below the product, and leave fewer rows than single pivots do."""
    rng = np.random.default_rng(5)
    x = rng.integers(-1000, 1000, (3000, 32)).astype(np.int64)
    norms = (x.astype(float) ** 2).sum(1)
    most = norms.max()
    pivots = x[:24].astype(float)
    span = exact_topk.span_of(np.vstack([pivots, pivots[:3]]), most)
    assert span.shape == (27, 24)
    span = exact_topk.span_of(pivots, most)
    far = exact_topk.pivot_distances(x.astype(float), norms, pivots, most, False)
    y, rest = exact_topk.projected(far, np.full(len(x), most), most, span)
    single = joint = 0
    for i in range(0, 3000, 100):
        d = exact_topk.pivot_distances(x[[i]].astype(float), norms[[i]], pivots, most, True)
        along, outside = exact_topk.projected(d, norms[[i]], most, span)
        true = x @ x[i]
        one = (norms[i] + most - np.abs(far - d).max(axis=1) ** 2) / 2 + 1e-6 * most
        both = y @ along[0] + rest * outside[0] + 1e-6
        assert (both >= true).all() and (one >= true).all()
        tenth = np.sort(np.delete(true, i))[-10]
        single, joint = single + (one >= tenth).sum(), joint + (both >= tenth).sum()
    assert joint < 0.7 * single


def test_more_rows_than_the_floor_samples(spark):
    """Above FLOOR_ROWS rows of a dimension, in more than one block of rows, results are those of brute force."""
    rng = np.random.default_rng(6)
    x = np.floor(rng.normal(size=(9000, 12)) * 1024).astype(np.int64)
    docs = spark.createDataFrame([(i, [v / 1024 for v in row]) for i, row in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = exact_top_k(docs, F.col("vec_id") % 500 == 0).collect()
    want = []
    for i in range(0, 9000, 500):
        true = x @ x[i]
        order = [j for j in np.lexsort((np.arange(9000), -true)).tolist() if j != i][:10]
        want += [(i, n + 1, j, int(true[j])) for n, j in enumerate(order)]
    assert sorted(map(tuple, got)) == want


def test_searches_beside_clashing_columns(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(v) for v in rng.normal(size=8)], "a", "b", 1.5) for i in range(60)]
    plain = spark.createDataFrame([r[:2] for r in rows], "vec_id long, embedding array<double>")
    clashing = spark.createDataFrame(rows, "vec_id long, embedding array<double>, dim string, far string, score double")
    for search in (lambda d: exact_top_k(d, F.col("vec_id") % 20 == 0), lambda d: nearest_neighbours(d, F.col("vec_id") % 20 == 0)):
        assert sorted(map(tuple, search(clashing).collect())) == sorted(map(tuple, search(plain).collect()))
