import zlib
from collections import Counter, defaultdict

import numpy as np
from meshweave.llm.langid import CLASSES, SYMBOLS, identify, in_a_language, learn, mixtures, predict_languages


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    out = got[got.held_out]
    assert len(got) == docs.count() and len(out) > 200
    assert (out.lang_pred == out.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_mixtures_of_two_languages(spark, small_docs):
    model = learn(small_docs)
    assert model.languages == ["de", "en", "es", "fr"]
    rows = small_docs.toPandas()
    en, fr = (" ".join(rows[rows.lang == x].text[:3]).split()[:300] for x in ("en", "fr"))
    docs = spark.createDataFrame([(1, " ".join(en + fr[:150])), (2, " ".join(en)), (3, " ".join(fr))], "doc_id long, text string")
    got = {r.doc_id: r for r in identify(docs, model, keep=["doc_id"]).collect()}
    assert got[1]["__lang"] == "en" and abs(got[1]["__score"] - 2 / 3) < 0.08
    assert [m.lang for m in got[1]["__mixture"]][:2] == ["en", "fr"]
    assert got[2]["__lang"] == "en" and got[2]["__score"] > 0.97
    assert got[3]["__lang"] == "fr" and got[3]["__score"] > 0.97


def test_em_equals_a_plain_version():
    rng = np.random.default_rng(1)
    log_word = np.log(rng.uniform(0.01, 1, (60, 3)))
    got = mixtures(log_word, np.array([0, 25]), penalty=0.0, rounds=200, most=3)
    for share, part in zip(got, (log_word[:25], log_word[25:]), strict=True):
        p, w = np.exp(part), np.full(3, 1 / 3)
        for _ in range(3000):
            r = p * w
            w = (r / r.sum(1, keepdims=True)).mean(0)
        fit = np.log((p * share).sum(1)).sum()
        assert fit >= np.log((p * w).sum(1)).sum() - 0.05


def test_odd_rows(spark, odd_docs, no_docs):
    got = sorted((r.doc_id or 0, r.lang_pred, r.score) for r in predict_languages(odd_docs).collect())
    assert len(got) == 12
    assert {(i, l) for i, l, _ in got if i in (2, 3, 7, 2**40)} == {(i, "und") for i in (2, 3, 7, 2**40)}
    assert predict_languages(no_docs).collect() == []
    unlabelled = spark.createDataFrame([(1, "some words here", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in predict_languages(unlabelled).collect()] == [("und", 0.0)]
    blank = spark.createDataFrame([(1, "12 … !", "xx"), (4, "\U0001f600", "xx"), (7, "abc", "xx"), (10, "Ωμέγα", "xx")], "doc_id long, text string, lang string")
    kinds = {r.doc_id: r.lang_pred for r in predict_languages(blank).collect()}
    assert kinds[1] == kinds[4] == "und" and kinds[7] == "xx" and kinds[10] == "xx"


def test_more_than_four_languages():
    log_word = np.full((600, 7), -12.0)
    log_word[np.arange(600), np.arange(600) % 6] = -1.0
    got = mixtures(log_word, np.array([0]), penalty=3.0)
    assert np.allclose(got, [[1 / 6] * 6 + [0]], atol=0.01)


def test_rows_stay_without_learnt_languages(spark):
    schema = "doc_id long, text string, lang string"
    rows = [(i, f"some words here {i}", None) for i in range(6)] + [(6, "12 !", None), (7, None, None)]
    assert sorted(r.doc_id for r in in_a_language(spark.createDataFrame(rows, schema)).collect()) == list(range(6))
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 3 == 1]
    labelled = spark.createDataFrame([(i, "some words here", "en") for i in held], schema)
    assert in_a_language(labelled).count() == len(held)


def plain_predictions(rows):
    """language, largest share of each text, with dictionaries and loops."""

    def words(text):
        """Trigrams of each word: a symbol and the two before it, and the end of the word."""
        symbols = [0, 0, *(int(CLASSES[b]) for b in (text or "").lower().encode()), 0]
        found = []
        for g in zip(symbols, symbols[1:], symbols[2:], strict=False):
            if g[2] and not g[1]:
                found.append([])
            if g[1] or g[2]:
                found[-1].append(g)
        return found

    counts, before = defaultdict(Counter), defaultdict(Counter)
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1 and text is not None and lang is not None:
            for word in words(text):
                for g in word:
                    counts[lang][g] += 1
                    before[lang][g[:2]] += 1
    languages = sorted(counts)

    def fit(table, allowed):
        share = np.full(len(allowed), 1 / len(allowed))
        for _ in range(2000):
            part = table[:, allowed] * share
            new = (part / part.sum(1, keepdims=True)).mean(0)
            if np.abs(new - share).max() <= 1e-5:
                break
            share = new
        return new, np.log((table[:, allowed] * new).sum(1)).sum()

    out = {}
    for i, text, _ in rows:
        own = words(text)
        if not own or not any(map(str.isalpha, text)):
            out[i] = ("und", 0.0)
            continue
        log_p = np.array([[sum(np.log((counts[x][g] + 0.5) / (before[x][g[:2]] + 0.5 * SYMBOLS)) for g in w) for x in languages] for w in own])
        table = np.exp(np.maximum(log_p - log_p.max(1, keepdims=True), -60))
        alone = np.log(table).sum(0)
        best, score, share = [int(alone.argmax())], alone.max(), np.array([1.0])
        order = np.argsort(-fit(table, list(range(len(languages))))[0], kind="stable").tolist()
        for k in range(2, len(languages) + 1):
            own_share, value = fit(table, order[:k])
            value -= (k - 1) * 3.0 * np.log(len(own) + 1)
            if value > score:
                best, score, share = order[:k], value, own_share
        out[i] = (languages[best[int(share.argmax())]], float(share.max()))
    return out


def test_predictions_equal_a_plain_version(spark, small_docs):
    rows = [(r.doc_id, r.text, r.lang) for r in small_docs.orderBy("doc_id").limit(70).collect()]
    by = {lang: [t for _, t, x in rows if x == lang and t] for lang in ("en", "fr", "de")}
    rows += [(1000 + k, " ".join(" ".join(by[x][k % len(by[x])].split()[: 40 + 20 * k]) for x in ("en", "fr", "de")[: 2 + k % 2]), None) for k in range(6)]
    rows += [(2000, None, "en"), (2001, "", "fr"), (2002, "12 !", None)]
    want = plain_predictions(rows)
    got = {r.doc_id: (r.lang_pred, r.score) for r in predict_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got.keys() == want.keys() and any(0.3 < s < 0.9 for _, s in got.values())
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 0.02 for i in want)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "some words here", "en", "x", 3), (4, None, "en", "y", 4)], "doc_id long, text string, lang string, __lang string, __score int")
    got = in_a_language(docs)
    assert got.dtypes == docs.dtypes and [tuple(r) for r in got.collect()] == [(1, "some words here", "en", "x", 3)]
