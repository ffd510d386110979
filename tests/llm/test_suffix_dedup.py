import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from meshweave.llm import suffix_dedup
from meshweave.llm.suffix_dedup import LENGTH, merge_transforms, repeat_digests, repeated_starts, shard_transform


def brute(rows):
    first = {}
    texts = [(-(2**63) if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for s in range(len(t) - LENGTH + 1):
            w = t[s : s + LENGTH]
            if w not in first or (i, s) < first[w]:
                first[w] = (i, s)
    out = []
    for (i, t), (own, _) in zip(texts, rows, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - LENGTH + 1):
            if first[t[s : s + LENGTH]] != (i, s):
                gone[s : s + LENGTH] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        left = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((own if own is not None else -1, len(t), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def found(docs):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeat_digests(docs).collect())


def planted():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [prose(k) for k in (14, 20, 25, 40, 80)]
    rows = []
    for _ in range(120):
        parts = [prose(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), prose(rng.randint(0, 10))]
        rows.append(" ".join(parts))
    rows += rows[:6] + ["a" * 400, "b" + "a" * 150, "ab" * 130, "abc" * 60 + "\0" * 130, "x" * 99, "x" * 100, "x" * 101]
    rng.shuffle(rows)
    return [(5 * i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("block", "hot", "shard"), [(8 << 20, 20_000, 1 << 19), (4000, 3, 700)])
def test_equals_brute_force(spark, monkeypatch, block, hot, shard):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffix_dedup, "MERGE_BYTES", 8 * shard)
    rows = planted()
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_equals_brute_force_on_the_test_table(spark, small_docs):
    assert found(small_docs) == brute([(r.doc_id, r.text) for r in small_docs.collect()])


def test_odd_rows(spark, odd_docs, no_docs):
    assert found(odd_docs) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert repeat_digests(no_docs).collect() == []


def test_merged_order_is_that_of_all_suffixes():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(100, 260))) for _ in range(30)]
    shards, transforms = [strings[:7], strings[7:8], strings[8:]], []
    for shard in shards:
        ends = np.cumsum([len(s) + 1 for s in shard]) - 1
        text = np.frombuffer(b"\0".join(shard) + b"\0", np.uint8).astype(np.uint16) + 1
        text[ends] = 0
        transforms.append(shard_transform(text, ends)[1])
    _, same = merge_transforms(transforms)
    turned = sorted((s + b"\0")[i:] + (s + b"\0")[:i] for s in strings for i in range(len(s) + 1))
    turned = [(t * 2)[:LENGTH] for t in turned]
    want = np.cumsum([True] + [a != b for a, b in zip(turned, turned[1:], strict=False)])
    assert sorted(turned) == turned and (same == want).all()
    counts = np.array([len(s) - LENGTH + 1 for s in strings])
    repeat = repeated_starts(strings, counts, np.arange(len(strings)), np.zeros(len(strings), int))
    seen, expected = set(), []
    for s in strings:
        for i in range(len(s) - LENGTH + 1):
            expected.append(s[i : i + LENGTH] in seen)
            seen.add(s[i : i + LENGTH])
    assert repeat.tolist() == expected


@pytest.mark.parametrize("period", [1, 2, 16, 33])
def test_periodic_runs_across_wrapped_places(spark, period):
    rng = random.Random(4)
    prose = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    rows = []
    for length in (101, 120, 130, 160):
        for border in (3904, 4096, 8192):
            for before in (20, 60, 75, 100):
                unit = chr(33 + len(rows)) + prose(period - 1)  # found in no other row
                rows.append((len(rows), prose(border - before) + (unit * length)[:length] + prose(200)))
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_no_task_gathers_the_repeats_within_all_blocks(spark, monkeypatch):
    plain = suffix_dedup._merge_bucket

    def merge(table):
        known = [b for b, s in zip(table.column("block").to_pylist(), table.column("strings").to_pylist(), strict=True) if s is None]
        assert len(known) < 2 and (not known or table.num_rows == 1)
        return plain(table)

    monkeypatch.setattr(suffix_dedup, "_merge_bucket", merge)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 4000)
    rows = planted()
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_a_block_names_a_minimiser_once(spark, monkeypatch):
    """A line that every document repeats sends its group a row's worth for each block, whatever the number of its occurrences."""
    sizes, plain = [], suffix_dedup._kinds

    def block(anchors, times):
        return suffix_dedup._packed(steps=np.diff(np.array(anchors), prepend=0), times=np.array(times))

    table = pa.table({"block": [0, 1, 2], "bucket": [0, 0, 0], "anchors": [block([5, 9, 12], [1, suffix_dedup.HOT, 1]), block([9, 30], [1, 2]), block([12], [1])]})
    kinds = [list(zlib.decompress(x.as_py())) for x in plain(table).column("kinds")]
    assert kinds == [[0, 2, 1], [2, 1], [1]]

    def counted(table):
        sizes.append([len(suffix_dedup._unpacked(x.as_py(), 2)[0]) for x in table.column("anchors")])
        assert all(len(np.unique(np.cumsum(suffix_dedup._unpacked(x.as_py(), 2)[0]))) == n for x, n in zip(table.column("anchors"), sizes[-1], strict=True))
        return plain(table)

    monkeypatch.setattr(suffix_dedup, "_kinds", counted)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 4000)
    line = "a line that stands in every document of this table, word for word, and is longer than a hundred bytes. "
    rows = [(i, line * 5 + f"document {i} " * 3) for i in range(60)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_a_string_of_every_block_meets_in_two_levels(spark, monkeypatch):
    plain = suffix_dedup._first_of_equals

    def thin(table):
        out = plain(table)
        assert table.num_rows < 30  # of 60 blocks and more
        assert sum(x.is_valid for x in out.column("strings")) == 1  # all of a group's first ones are in one block
        return out

    monkeypatch.setattr(suffix_dedup, "_first_of_equals", thin)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(suffix_dedup, "HOT", 20)
    line = "a line that stands in every document of this table, word for word, and is longer than a hundred bytes. "
    rows = [(i, line * 2 + f"{i} document {i} " * 80) for i in range(240)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
