"""Sharding and mixing against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from meshweave.llm.mixing import mix_sources, mixed_documents, order_bucket, random_number
from meshweave.llm.queries import ORACLE_SQL, QUERIES
from meshweave.llm.sharding import jump_hash, shard_documents
from pyspark.sql import functions as F


def jump(key, n):
    """The published loop."""
    key %= 2**64
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 24, 25, 1000])
def test_jump_hash(spark, n):
    keys = [*range(300), -1, -(2**63), 2**63 - 1, 2**40]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", jump_hash(F.col("k"), n).alias("s")).collect()
    assert {r.k: r.s for r in rows} == {k: jump(k, n) for k in keys}


def test_a_key_with_many_jumps(spark, monkeypatch):
    from meshweave.llm import sharding

    monkeypatch.setattr(sharding, "FIRST_JUMPS", 2)
    rows = spark.range(200).select("id", jump_hash(F.col("id"), 500).alias("s")).collect()
    assert all(r.s == jump(r.id, 500) for r in rows)


@pytest.mark.parametrize("name", ["odd_docs", "small_docs"])
def test_shards(name, request):
    docs = request.getfixturevalue(name)
    want = Counter()
    for r in docs.collect():
        body = (r.text or "").encode()
        want[r.doc_id, len(body) + 8, zlib.crc32(body), jump(r.doc_id or 0, 24), jump(r.doc_id or 0, 25)] += 1
    got = shard_documents(docs, 24).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    assert all(r.law == "key" and r.grown_shard in (r.shard, 24) for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def plain_mix(rows, weights=(5, 2, 1)):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows]
    total = Counter()
    for r, n in zip(rows, size, strict=True):
        total[r.source] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        left, w = sum(total.values()) - sum(3 * total[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and w and left * weight[s] / w > 3 * total[s]}
        if not more:
            return size, total, {s: 3.0 * total[s] if s in capped else left * weight[s] / w for s in order}
        capped |= more


@pytest.mark.parametrize("name", ["odd_docs", "small_docs"])
def test_mix(name, request):
    docs = request.getfixturevalue(name)
    rows = docs.collect()
    size, total, target = plain_mix(rows)
    source = defaultdict(set)
    for r in rows:
        source[r.doc_id].add(r.source)
    got = mix_sources(docs, keep=("source",)).collect()
    assert sorted((r.doc_id or 0, r.size) for r in got) == sorted((r.doc_id or 0, n) for r, n in zip(rows, size, strict=True))
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == total[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in target)
    again = mix_sources(docs.repartition(5), keep=("source",)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_order_is_by_random_odds_over_inclusion_odds(spark):
    docs = spark.createDataFrame([(i, "one " * (1 + i % 40), "ab"[i % 2]) for i in range(800)], "doc_id long, text string, source string")
    rows = [r for r in mix_sources(docs).collect() if r.doc_id % 2]
    rest, total = rows[0].target / rows[0].source_size % 1, rows[0].source_size
    mean = -(-total // len(rows))
    grade = {r.doc_id: 1024 * r.size // (r.size + mean) for r in rows}
    middle = sum(r.size * grade[r.doc_id] for r in rows) / total
    u = {r.doc_id: (int(hashlib.md5(f"17:{r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13 for r in rows}
    p = {i: rest * (1 + (1 - rest) * (middle - g) / 1024) for i, g in grade.items()}
    assert sum(p[r.doc_id] * r.size for r in rows) == pytest.approx(rest * total) and max(p.values()) > 1.15 * min(p.values())
    odds = {i: x * (1 - p[i]) / ((1 - x) * p[i]) for i, x in u.items()}
    most = max(r.copies for r in rows)
    taken = [odds[r.doc_id] for r in rows if r.copies == most]
    assert len({r.copies for r in rows}) == 2 and max(taken) < min(odds[r.doc_id] for r in rows if r.copies < most)
    assert [r.doc_id for r in sorted(rows, key=lambda r: odds[r.doc_id])] != [r.doc_id for r in sorted(rows, key=lambda r: u[r.doc_id])]


def test_inclusion_frequencies_are_the_probabilities(spark):
    docs = spark.createDataFrame([(1000 * s + i, "one " * (1 + 6 * i), f"s{s:03d}") for s in range(600) for i in range(24)], "doc_id long, text string, source string")
    got = mix_sources(docs, keep=("source",)).toPandas()
    got["i"], got["kind"] = got.doc_id % 1000, got.source.str[1:].astype(int) % 3
    checked = 0
    for _, own in got.groupby("kind"):
        rest = own.target.iloc[0] / own.source_size.iloc[0] % 1
        if rest == 0:
            continue
        size = own.groupby("i")["size"].first()
        grade = 1024 * size // (size + -(-size.sum() // 24))
        p = rest * (1 + (1 - rest) * ((size * grade).sum() / size.sum() - grade) / 1024)
        often = own.groupby("i").copies.mean() - own.copies.min()
        assert (often - p).abs().max() < 0.12 and (often - p).abs().mean() < 0.04
        checked += 1
    assert checked >= 2


def test_rows_without_id_and_clashing_names(spark):
    docs = spark.createDataFrame([(None, f"word {i}", "a", i, str(i)) for i in range(60)] + [(1, "x", "a", 5, "k")], "doc_id long, text string, source string, copies long, id string")
    u = docs.select(random_number(F.col("doc_id"), F.col("text"), 17).alias("u")).distinct().count()
    got = mixed_documents(docs)
    assert u == 61 and got.dtypes == docs.dtypes and got.count() == 61 and {(r.text, r.copies, r.id) for r in got.collect()} == {(r.text, r.copies, r.id) for r in docs.collect()}


def test_no_rows(no_docs):
    assert mix_sources(no_docs).collect() == [] and shard_documents(no_docs, 24).collect() == []


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    columns = ", ".join(df.columns)
    assert sorted(map(tuple, df.collect())) == sorted(con.sql(f"SELECT {columns} FROM ({ORACLE_SQL[name]})").fetchall())


def test_buckets_of_a_source_hold_about_as_many_rows(spark):
    u = (F.col("id") + 0.5) / 40_000
    rows = spark.range(40_000).crossJoin(spark.createDataFrame([(1e-7,), (1e-4,), (0.5,), (0.9999,)], "r double"))
    rows = rows.withColumn("odds", u * (1 - F.col("r")) / ((1 - u) * F.col("r")))
    got = rows.groupBy("r", order_bucket(F.col("odds"), F.col("r"), 100).alias("bucket")).count().collect()
    assert len(got) == 400 and all(399 <= r["count"] <= 401 for r in got)
