"""SimHash classes against a plain loop over all pairs."""

import random

import xxhash
from meshweave.llm import simhash
from meshweave.llm.simhash import simhash_duplicates


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    """id -> (fingerprint, least reachable id) of (id, fingerprint) with distinct ids."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, x) in enumerate(rows):
        for j, y in rows[:k]:
            if (x ^ y).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (f"{x:016x}", find(i)) for i, x in rows}


def found(df):
    return {r.doc_id: (r.fingerprint, r.component_id) for r in df.collect()}


def test_test_documents(spark, small_docs):
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in small_docs.collect()]
    assert found(simhash_duplicates(small_docs)) == plain_components(rows)


def chosen(spark, monkeypatch, fps):
    """Documents whose texts are their fingerprints, in hex."""
    docs = spark.createDataFrame([(i, f"{x:016x}") for i, x in enumerate(fps)], "doc_id bigint, text string")

    def given(docs, key, text):
        from pyspark.sql import functions as F

        return docs.select(key, F.conv("text", 16, -10).cast("bigint").alias("fp"))

    monkeypatch.setattr(simhash, "fingerprints", given)
    return docs


def test_clusters_of_fingerprints(spark, monkeypatch):
    """Dense and sparse clusters and chains, with nodes that fit a task and nodes that must branch."""
    draw = random.Random(5)
    fps = []
    for radius, n in ((2, 60), (5, 90), (9, 60)):
        center = draw.getrandbits(64)
        for _ in range(n):
            fps.append(center ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, radius))))
    x = draw.getrandbits(64)
    for _ in range(20):  # a chain of links, and a far end
        fps.append(x)
        x ^= sum(1 << b for b in draw.sample(range(64), 3))
    fps += [draw.getrandbits(64) for _ in range(60)] + [0, 0, 7, 2**64 - 1]
    docs = chosen(spark, monkeypatch, fps)
    want = plain_components(list(enumerate(fps)))
    assert found(simhash_duplicates(docs)) == want
    assert found(simhash_duplicates(docs, chunk=8)) == want


def test_distance_three_is_a_link_four_is_not(spark, monkeypatch):
    draw = random.Random(9)
    fps = []
    for k in range(40):
        x = draw.getrandbits(64)
        fps += [x, x ^ sum(1 << b for b in draw.sample(range(64), 3 + k % 2))]
    want = plain_components(list(enumerate(fps)))
    assert found(simhash_duplicates(chosen(spark, monkeypatch, fps))) == want
    assert sum(i != c for i, (_, c) in want.items()) == 20


def test_odd_rows(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = simhash_duplicates(odd_docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    got = [tuple(r) for r in got.collect()]
    assert sorted(x[1] for x in got) == sorted(f"{plain_fingerprint(t):016x}" for _, t in rows)
    by_id = {x[0]: x for x in got}
    assert by_id[2][2] == by_id[3][2] == by_id[7][2] == 2  # null, empty and blank texts
    assert by_id[8][2] == by_id[9][2] == 8 and len([x for x in got if x[0] == 8]) == 2
    assert by_id[None][2] is None


def test_empty_table(spark, no_docs):
    assert simhash_duplicates(no_docs).count() == 0


def test_very_long_text():
    text = " ".join(f"w{i % 977} x{i % 31}" for i in range(300_000))
    words = text.split()
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    assert simhash.fingerprint(text.encode()) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
