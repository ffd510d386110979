import tracemalloc
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from meshweave.llm import gru, lm
from meshweave.llm.lm import score_documents
from pyspark.sql import functions as F


def brute(rows):
    counts, docs = Counter(), []
    for i, t in rows:
        tokens = (t or "").encode().lower().split() + [None]
        out = zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
        docs.append((i, out, tokens))
        if not out:
            counts.update(tokens)
    n, v = sum(counts.values()), len(counts)
    key = lambda r: (r[0] is None, r)
    return sorted(((i or 0), out, len(t), sum(counts[x] > 0 for x in t), n, round(sum(log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), 6)) for i, out, t in docs)


@pytest.mark.parametrize("name", ["odd_docs", "small_docs"])
def test_base_scores_equal_brute_force(name, request):
    docs = request.getfixturevalue(name)
    got = score_documents(docs, rounds=1).collect()
    assert sorted(((r.doc_id or 0), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert all(np.isfinite(r.score) and r.score <= 0 for r in got)


def test_held_out_documents_gain(spark):
    got = score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    out = got[got.held_out]
    assert (out.score.sum() - out.base_score.sum()) / out.n_tokens.sum() >= 0.13  # log10 a token


def test_whole_scores_equal_a_plain_version(spark, odd_docs, monkeypatch):
    """Vocabulary, ties at its edge, shares of the other words and the order of rounds: all but learning, which is replaced by noise."""
    held = {}

    def noisy(coded, start, rounds):
        rng = np.random.default_rng(8)
        held["p"] = {k: (v + rng.normal(0, 0.2, v.shape)).astype(np.float32) for k, v in sorted(start.items())}
        return held["p"]

    monkeypatch.setattr(lm, "train", noisy)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(50)
    docs = docs.unionByName(odd_docs.select("doc_id", F.substring("text", 1, 4000).alias("text")))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    texts = [(t or "").encode().lower().split() for _, t in rows]
    learnt = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0 for i, _ in rows]
    counts = Counter(w for t, ok in zip(texts, learnt, strict=True) if ok for w in t)
    for most in (40, 150):
        got = score_documents(docs, words=most, rounds=3).collect()
        ranked = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
        least = ranked[most][1] if len(ranked) > most else 0
        frequent = [w for w, c in ranked[:most] if c > least]
        codes = {w: i + 2 for i, w in enumerate(frequent)}
        n_rest, v_rest = sum(counts.values()) - sum(counts[w] for w in frequent), len(counts) - len(frequent)
        want = []
        for (i, _), t in zip(rows, texts, strict=True):
            rest = sum(log10((counts[w] + 0.1) / (n_rest + 0.1 * (v_rest + 1))) for w in t if w not in codes)
            want.append((-1 if i is None else i, rest + plain_score(held["p"], [codes.get(w, 1) for w in t] + [0]) / np.log(10)))
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in got)
        assert [g[0] for g in got] == [w[0] for w in sorted(want)]
        assert np.allclose([g[1] for g in got], [w[1] for w in sorted(want)], rtol=1e-4, atol=1e-3)


def test_no_rows(no_docs):
    assert score_documents(no_docs).collect() == []


def small_model():
    rng = np.random.default_rng(0)
    p = gru.initial(np.array([5, 9, 8, 7, 4, 3, 2, 1, 1, 1.0]))
    for k in p:
        p[k] = (p[k] + rng.normal(0, 0.3, p[k].shape)).astype(np.float32)
    return p


def test_probabilities_add_up_and_state_is_carried():
    p = small_model()
    texts = [np.array([3, 4, 0]), np.array([2, 2, 5, 1, 0]), np.array([0])] * 30 + [np.tile([6, 2, 7, 3], 60)]
    lengths = np.array([len(t) for t in texts])
    got = gru.score(p, np.concatenate(texts), lengths)
    alone = [gru.score(p, t, np.array([len(t)]))[0] for t in texts]
    assert np.allclose(got, alone, atol=1e-3)
    every = [gru.score(p, np.array([3, 4, w]), np.array([3]))[0] for w in range(p["embed"].shape[0])]
    head = gru.score(p, np.array([3, 4]), np.array([2]))[0]
    assert np.isclose(np.exp(np.array(every) - head).sum(), 1, atol=1e-4)


def test_gradients_equal_differences():
    p = {k: v.astype(np.float64) for k, v in small_model().items()}
    learner = gru.Learner(p)
    rng = np.random.default_rng(2)
    target = rng.integers(0, 10, (6, 3))
    target[4:, 2] = -1
    before, goes_on = rng.integers(0, 10, (6, 3)), (rng.random((6, 3)) > 0.3).astype(np.float64)
    state = rng.normal(size=(3, gru.WIDTH))
    loss = lambda: -learner.gradients(target, before, goes_on, state)[3]
    grads = learner.gradients(target, before, goes_on, state)[0]
    words, rows = grads["embed"]
    grads["embed"] = np.zeros_like(p["embed"])
    grads["embed"][words] = rows
    for k, g in grads.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in g.shape)
            keep = learner.p[k][at]
            learner.p[k][at] = keep + 1e-3
            more = loss()
            learner.p[k][at] = keep - 1e-3
            less = loss()
            learner.p[k][at] = keep
            assert np.isclose((more - less) / 2e-3, g[at], atol=2e-3, rtol=2e-2), k


def plain_states(p, codes):
    """The state after each word, one word at a time in double precision."""
    p = {k: v.astype(np.float64) for k, v in p.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    h, before, out = np.zeros(gru.WIDTH), 0, []
    for w in codes:
        x, g = p["embed"][before] @ p["wx"] + p["b"], h @ p["wh"]
        k = gru.WIDTH
        z, r = sigmoid(x[:k] + g[:k]), sigmoid(x[k : 2 * k] + g[k : 2 * k])
        n = np.tanh(x[2 * k :] + r * g[2 * k :])
        h = (1 - z) * n + z * h
        out.append(h)
        before = w
    return out


def plain_score(p, codes):
    begins = gru.classes(len(p["bw"]))
    total = 0.0
    for h, w in zip(plain_states(p, codes), codes, strict=True):
        k = max(i for i, first in enumerate(begins[:-1]) if first <= w)
        words = slice(begins[k], begins[k + 1])
        a, b = h @ p["wc"] + p["bc"], p["ww"][words] @ h + p["bw"][words]
        total += a[k] - np.log(np.exp(a).sum()) + b[w - begins[k]] - np.log(np.exp(b).sum())
    return total


def test_scores_and_carried_states_equal_a_plain_loop():
    p = small_model()
    p["wc"] += np.random.default_rng(5).normal(0, 0.5, p["wc"].shape).astype(np.float32)
    rng = np.random.default_rng(6)
    lengths = np.array([1, 700, 0, 30, 1600, 512, 513])
    codes = rng.integers(0, 10, lengths.sum())
    texts = np.split(codes, np.cumsum(lengths)[:-1])
    assert np.allclose(gru.score(p, codes, lengths), [plain_score(p, t) for t in texts], rtol=1e-4)
    want = [plain_states(p, t)[at - 1] for t in texts for at in range(gru.SEGMENT, len(t), gru.SEGMENT)]
    got = gru.states_between(p, codes, lengths)
    assert not got[0].any() and np.allclose(got[1:], want, atol=1e-4)


def test_learning_lowers_the_loss_of_long_texts():
    p = gru.initial(np.ones(10))
    codes = np.tile([3, 1, 4, 1, 5, 9, 2, 6], 2000)
    lengths = np.array([12_000, 3_000, 1_000])
    learner = gru.Learner(p)
    learner.learn(codes, lengths)
    assert learner.words == 16_000
    assert gru.score(learner.p, codes, lengths).sum() > 0.7 * gru.score(p, codes, lengths).sum()


def test_a_text_of_a_million_words_beside_short_ones():
    p = small_model()
    lengths = np.array([1_000_000] + [40] * 511)
    codes = np.random.default_rng(1).integers(0, 10, lengths.sum())
    tracemalloc.start()
    got = gru.score(p, codes, lengths)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200e6 and np.isfinite(got).all()


def test_memory_of_scoring_follows_the_words():
    p = small_model()
    lengths = np.array([40_000] + [3] * 600)
    codes = np.random.default_rng(1).integers(0, 10, lengths.sum())
    tracemalloc.start()
    got = gru.score(p, codes, lengths)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30e6
    assert np.allclose(got[[0, 7]], [gru.score(p, codes[:40_000], lengths[:1])[0], gru.score(p, codes[40_018:40_021], lengths[7:8])[0]], rtol=1e-4)
