"""Phrases and scores against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from meshweave.llm import collocations as module
from meshweave.llm.collocations import collocations, phrase_counts, scored_phrases

SCHEMA = "doc_id bigint, text string, lang string"


def plain(rows, least=100, top=2000, percent=100):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", folded):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        cands = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        most = Counter()
        for p, c in cands.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    most[p[i : i + size]] = max(most[p[i : i + size]], c)
        own = []
        for p, a in cands.items():
            if p not in most or 100 * most[p] < percent * a:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                own.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def found(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


def texts(n, seed):
    draw = random.Random(seed)
    words = [w for k in range(12) for w in ["the"] * (k == 0) + [f"w{k}", f"É{k}", f"Up{k}"]]
    fixed = ["new York city", "as Well as the", "in the long run it", "é è à"]
    out = []
    for _ in range(n):
        parts = [draw.choice(fixed) if draw.random() < 0.3 else draw.choice(words) + draw.choice([" ", " ", "  ", "\t", ", ", ". ", "\n", " ", "! "]) for _ in range(draw.randint(0, 60))]
        out.append((" ".join(parts), draw.choice(["en", "en", "en", "fr", None, "und", ""])))
    return out


@pytest.mark.parametrize(("least", "top", "percent"), [(5, 2000, 100), (20, 17, 100), (8, 2000, 60)])
def test_against_plain_counts(spark, least, top, percent):
    rows = texts(400, 3)
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA).repartition(5)
    got = found(collocations(docs, least=least, top=top, percent=percent))
    assert got == plain(rows, least, top, percent)
    assert len(got) > 20


def test_small_blocks_buckets_and_parts(spark, monkeypatch):
    """Pieces beyond PART_WORDS are cut with an overlap; many blocks and buckets, a crowded filter and repeated pieces change nothing."""
    draw = random.Random(1)
    long = " ".join(draw.choice("abcdef") for _ in range(3000))
    rows = [*texts(200, 4), (long, "en"), (long, "en"), (long + " tail", "fr"), ("x y z x y z", "en"), ("x y z x y z", "en")]
    monkeypatch.setattr(module, "PART_WORDS", 6)
    assert [len(p.split()) for p in module.pieces_of(b"a b c d e f g h i j k l m n o", 6)] == [10, 9]
    want = plain(rows, 6)
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA).repartition(3)
    monkeypatch.setattr(module, "BUCKET_WORDS", 500)
    monkeypatch.setattr(module, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(module, "MOST_BITS", 1 << 20)
    assert found(collocations(docs, least=6)) == want


def test_cut_parts_of_a_long_piece():
    words = [str(k % 7) for k in range(200)]
    pieces = list(module.pieces_of(" ".join(words).encode(), 16))
    for n in range(1, 6):
        got = phrase_counts(b"\n".join(pieces), np.ones(len(pieces), np.int64), n)
        assert got == Counter(" ".join(words[i : i + n]).encode() for i in range(len(words) - n + 1))


def test_products_beyond_64_bits(spark):
    big = 10**15
    frequent = spark.createDataFrame([("en", "p q", 2, big), ("en", "p", 1, 3 * big), ("en", "q", 1, 2 * big)], "lang string, phrase string, words int, f bigint")
    totals = spark.createDataFrame([("en", 7 * 10**17)], "lang string, n bigint")
    r = scored_phrases(frequent, totals).first()
    assert r.score == 1000 * big * 7 * 10**17 // (6 * big * big) and (r.l, r.r) == (3 * big, 2 * big)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.text, r.lang) for r in odd_docs.collect()]
    assert found(collocations(odd_docs, least=40)) == plain(rows, 40)
    assert found(collocations(no_docs)) == []
    blank = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, " .,;\n", "de")], SCHEMA)
    assert found(collocations(blank, least=1)) == []
