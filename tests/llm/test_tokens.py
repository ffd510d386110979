import json
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from meshweave.llm import packing, tokens
from meshweave.llm.packing import laid_down, pack_documents, pieces_of, schedule
from meshweave.llm.token_counts import count_tokens
from meshweave.llm.tokens import RunEncoder, load_tokenizer, tokenizer_path


def ids_of(text):
    return load_tokenizer(tokenizer_path()).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["odd_docs", "small_docs"])
def test_counts_equal_the_library(name, request):
    docs = request.getfixturevalue(name)
    want = sorted(((r.doc_id or 0), len((r.text or "").encode()), len(ids_of(r.text)), len(ids_of(r.text)) > 2048) for r in docs.collect())
    got = sorted(((r.doc_id or 0), r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs).collect())
    assert got == want


def test_empty_tables(no_docs):
    assert count_tokens(no_docs).collect() == []
    assert pack_documents(no_docs).collect() == []


@pytest.mark.parametrize("name", ["odd_docs", "small_docs"])
def test_packing_is_a_round_trip(name, request):
    docs = request.getfixturevalue(name)
    pieces = pack_documents(docs, bucket_bytes=60_000).collect()
    full = defaultdict(list)
    for r in docs.collect():
        full[r.doc_id].append(ids_of(r.text) + [2])
    assert sum(p.length for p in pieces) == sum(len(x) for v in full.values() for x in v)
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert any(len(x) == p.doc_tokens and zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for x in full[p.doc_id])
        by_sequence[p.sequence_id].append((p.offset, p.length))
        by_doc[p.doc_id, p.doc_tokens].append((p.start, p.length))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for k, parts in by_sequence.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 4096 or k == len(by_sequence) - 1
    for (doc, n), parts in by_doc.items():
        times = sum(len(x) == n for x in full[doc])
        assert sum(length for _, length in parts) == n * times


def plain_round_robin(sizes, weights, quantum):
    """(queue, token) in the order in which deficit round-robin, token by token, lays them down."""
    served, deficit, out = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, Fraction(0)), []
    while left := sorted(q for q in sizes if served[q] < sizes[q]):
        active = [q for q in left if weights.get(q, 0) > 0] or left
        whole = sum(weights.get(q) or sizes[q] for q in active)
        for q in active:
            deficit[q] += Fraction((weights.get(q) or sizes[q]) * quantum, whole)
            n = min(int(deficit[q]), sizes[q] - served[q])
            deficit[q] -= n
            out += [(q, served[q] + i) for i in range(n)]
            served[q] += n
        if any(served[q] == sizes[q] for q in active):  # who shares a round has changed: deficits start again
            deficit = dict.fromkeys(sizes, Fraction(0))
    return out


@pytest.mark.parametrize("weights", [None, {"a": 3, "b": 2, "c": 1, "d": 7}, {"b": 5, "c": 1}])
def test_pieces_are_those_of_plain_round_robin(weights):
    rng = np.random.default_rng(3)
    lengths = {"a": [1, 300, 4, 90], "b": [70], "c": [1] * 40, "d": [2000, 1, 1]}
    sizes = {q: sum(v) for q, v in lengths.items()}
    weights = weights or sizes
    want = plain_round_robin(sizes, weights, 64)
    epochs, got = schedule(sizes, weights, 64), {}
    for q, v in lengths.items():
        cuts = sorted({0, len(v), *rng.integers(0, len(v), 2).tolist()})
        for x, y in zip(cuts, cuts[1:], strict=False):  # buckets of documents
            bounds = sum(v[:x]) + np.concatenate([[0], np.cumsum(v[x:y])])
            doc, start, length, place = pieces_of(*laid_down(epochs, q, int(bounds[0]), int(bounds[-1])), bounds, 64)
            assert (place // 64 == (place + length - 1) // 64).all()
            for d, s, n, p in zip(doc.tolist(), start.tolist(), length.tolist(), place.tolist(), strict=True):
                for i in range(n):
                    assert p + i not in got
                    got[p + i] = (q, int(bounds[d]) + s + i)
    assert [got[i] for i in range(len(got))] == want


def distances(pieces, share, window):
    by = pieces.groupby(["sequence_id", "source"], dropna=False).length.sum().unstack(fill_value=0) / window
    full = by[by.sum(axis=1) > 0.999]
    return (full - share).abs().sum(axis=1) / 2


def test_every_window_has_the_mixture(small_docs):
    pieces = pack_documents(small_docs, bucket_bytes=60_000, window=1024).toPandas()
    share = pieces.groupby("source", dropna=False).length.sum() / pieces.length.sum()
    far = distances(pieces, share, 1024)
    assert len(far) > 20 and far.max() < 0.05


def test_given_shares_hold_while_all_queues_last(spark):
    docs = spark.createDataFrame([(i, " ".join(["word"] * (1 + i % 700)), "abc"[i % 3]) for i in range(300)], "doc_id long, text string, source string")
    pieces = pack_documents(docs, bucket_bytes=60_000, window=512, shares={"a": 0.6, "b": 0.3}).toPandas()
    ends = pieces[pieces.source.isin(["a", "b"])].groupby("source").sequence_id.max()
    first = pieces[pieces.sequence_id < ends.min()]
    by = first.groupby(["sequence_id", "source"]).length.sum().unstack(fill_value=0)
    assert len(by) > 20 and (by["a"] / 512 - 2 / 3).abs().max() < 0.01 and "c" not in by
    assert pieces[pieces.source == "c"].sequence_id.min() >= ends.max()


def test_many_sources_share_queues(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_QUEUES", 3)
    docs = spark.createDataFrame([(i, f"some words {i}", f"s{i % 9}") for i in range(90)], "doc_id long, text string, source string")
    pieces = pack_documents(docs).toPandas()
    assert len(pieces) == 90 and pieces.source.nunique() == 9 and (pieces.sort_values("offset").offset.diff().dropna() == pieces.sort_values("offset").length.shift().dropna()).all()


@pytest.mark.parametrize("remembered", [0, 300, 10**6])
def test_an_encoder_that_forgets(small_docs, remembered):
    texts = [r.text or "" for r in small_docs.collect()]
    texts += ["It's 5 o'clock, he'LL go: \u00d7 \u0130stanbul \u00c9t\u00e9 e\u0301 \u017fo a\u00a0b <|endoftext|>x <| 12ab34 ...!!", "x\u001cy \u4f60\u597d \U0001f600 \u00f1\u00f7\u00d8"]
    own = RunEncoder(tokenizer_path(), remembered)
    for i in range(0, len(texts), 20):
        ids, lengths = own.encode([t.encode() for t in texts[i : i + 20]])
        for t, x in zip(texts[i : i + 20], np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
            assert x.tolist() == ids_of(t)


def test_pretokens_take_the_short_way_and_are_met_once(monkeypatch):
    path, asked, encoded = tokenizer_path(), [], tokens.encode_runs
    monkeypatch.setattr(tokens, "encode_runs", lambda path, clean, odd: asked.extend([*clean, *odd]) or encoded(path, clean, odd))
    texts = ["Word word, WORD! ŸÉtÉ 12", "", "it's\tword\x0bword", "<|x ÀLA WORD", " \x1c\x85 "] * 3
    ids, lengths = RunEncoder(path).encode([t.encode() for t in texts])
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [ids_of(t) for t in texts]
    assert len(asked) == len(set(asked)) and tokens.short_tokenizer(path) is not None
    assert RunEncoder(path).encode([])[1].tolist() == []
    assert RunEncoder(path).encode([b"", b" \n"])[1].tolist() == [0, 0]


def test_another_tokenizer_is_not_shortened(tmp_path):
    changed = json.loads(load_tokenizer(tokenizer_path()).to_str())
    changed["normalizer"] = None
    path = tmp_path / "other.json"
    path.write_text(json.dumps(changed))
    assert tokens.short_tokenizer(str(path)) is None
    text = "Words AND wOrds, 12 more"
    assert RunEncoder(str(path)).encode([text.lower().encode()])[0].tolist() == load_tokenizer(str(path)).encode(text.lower(), add_special_tokens=False).ids
