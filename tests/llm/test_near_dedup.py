import random

import pytest
from meshweave.llm import near_dedup
from meshweave.llm.components import components
from meshweave.llm.near_dedup import near_duplicates


def word_sets(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows):
    sets = [(i, word_sets(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for n, (i, s) in enumerate(sets):
        if i is None:
            continue
        for t in s:
            index.setdefault(t, []).append(n)
    seen = set()
    for group in index.values():
        for a in group:
            for b in group:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    x, y = sets[a][1], sets[b][1]
                    if 100 * len(x & y) >= 75 * len(x | y):
                        parent[find(b)] = find(a)
    least = {}
    for n, (i, _) in enumerate(sets):
        if i is not None:
            least[find(n)] = min(least.get(find(n), i), i)
    return sorted((i if i is not None else -1, len(s), least[find(n)] if i is not None else -1) for n, (i, s) in enumerate(sets))


def found(docs):
    rows = near_duplicates(docs).collect()
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in rows)
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in rows)


def planted():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 300))]
        for _ in range(rng.choice([1, 2, 3, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    base = [rng.choice(vocabulary) for _ in range(120)]
    for _ in range(150):  # a node larger than SMALL
        copy = list(base)
        copy[rng.randrange(120)] = rng.choice(vocabulary)
        rows.append(" ".join(copy))
    chain = [rng.choice(vocabulary) for _ in range(200)]
    for i in range(12):  # neighbours are similar, the ends are not
        rows.append(" ".join(chain[i * 8 :] + [f"x{j}" for j in range(i * 8)]))
    rows += rows[:5] + ["one two three", "One  two\tthree", "one two", "a b c d e", "a b c d e f"]
    rng.shuffle(rows)
    return [(7 * i + 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("small", "chunk", "size"), [(32, 2048, 32 << 20), (4, 2048, 40_000), (8, 40, 32 << 20)])
def test_equals_brute_force(spark, monkeypatch, small, chunk, size):
    for name, value in (("SMALL", small), ("CHUNK", chunk), ("NODE_BYTES", size)):
        monkeypatch.setattr(near_dedup, name, value)
    rows = planted()
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def copies(number):
    """Copies of one text with few or many changed words: some are linked to it, some to others, some to none."""
    rng = random.Random(number)
    base = [rng.choice([f"w{i}" for i in range(400)]) for _ in range(150)]
    rows = [" ".join(base)]
    for i in range(number - 1):
        copy = list(base)
        for at in rng.sample(range(150), 1 + i % 9):
            copy[at] = f"x{rng.randrange(3000)}"
        rows.append(" ".join(copy))
    rng.shuffle(rows)
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


def test_a_large_group_of_near_copies(spark):
    rows = copies(700)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_candidates_of_near_copies_grow_in_proportion(spark):
    numbers = []
    for size in (1000, 4000):
        docs = spark.createDataFrame(copies(size), "doc_id long, text string")
        classes = near_dedup.sketch_documents(docs).where("class IS NOT NULL").persist()
        members = near_dedup._members(near_dedup._expand(classes, near_dedup.FIRST_DEPTH, near_dedup.TREES), size)
        numbers.append((members.count(), near_dedup._candidates(members, classes.select("class", "signature")).count()))
        classes.unpersist()
    assert numbers[1][0] < 4.5 * numbers[0][0] and numbers[1][1] < numbers[1][0]


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 777, "h", 5), (2, "a b c d e f", 778, "h", 6), (2, "other words of a text", 779, "i", 7), (2, "other words of a text", 779, "i", 7)], "doc_id long, text string, __id long, __hash string, id long")
    got = near_dedup.drop_near_duplicates(docs)
    assert got.dtypes == docs.dtypes
    assert sorted(map(tuple, got.collect())) == [(1, "a b c d e f", 777, "h", 5), (2, "other words of a text", 779, "i", 7)]


def test_equals_brute_force_on_the_test_table(spark, small_docs):
    assert found(small_docs) == brute([(r.doc_id, r.text) for r in small_docs.collect()])


def test_odd_rows(spark, odd_docs, no_docs):
    assert found(odd_docs) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert near_duplicates(no_docs).collect() == []


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 180)] + [(300, 301), (301, 300), (5, 5)]
    got = {r.member: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(2, 61)} | {i: 100 for i in range(101, 180)} | {301: 300}
