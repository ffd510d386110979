import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
from meshweave.llm.tokens import load_tokenizer, tokenizer_path

from .test_near_dedup import brute as near_brute
from .test_suffix_dedup import LENGTH

SF = "/root/testdata/sf0.001"


def removed(rows):
    first, out = {}, {}
    for i, t in sorted(rows):
        t = t.encode()
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - LENGTH + 1):
            if first.setdefault(t[s : s + LENGTH], (i, s)) != (i, s):
                gone[s : s + LENGTH] = True
        out[i] = bytes(b for b, g in zip(t, gone, strict=False) if not g).decode("utf-8", "ignore")
    return out


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by_name, frames = dict(corpus_pipeline.STAGES), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF).persist()
        frames.append((before.collect(), docs.collect()))
        if name != "pack":
            assert docs.dtypes == before.dtypes
    assert list(by_name) == ["language_id", "near_dedup", "suffix_dedup", "mix", "pack"]

    before, after = frames[0]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {r.doc_id for r in before if not any(map(str.isalpha, r.text or ""))}
    before, after = frames[1]
    assert sorted(r.doc_id for r in after) == sorted(i for i, n, c in near_brute([(r.doc_id, r.text) for r in before]) if i == c)
    before, after = frames[2]
    assert {r.doc_id: r.text for r in after} == removed([(r.doc_id, r.text) for r in before])
    before, after = frames[3]
    words, source = {r.doc_id: len(r.text.split()) for r in before}, {r.doc_id: r.source for r in before}
    size, taken = defaultdict(int), defaultdict(int)
    for r in before:
        size[r.source] += words[r.doc_id]
    for r in after:
        taken[r.source] += words[r.doc_id]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}
    capped = set()
    while True:
        left, weights = sum(size.values()) - sum(3 * size[s] for s in capped), sum(weight[s] for s in size if s not in capped)
        more = {s for s in size if s not in capped and left * weight[s] / weights > 3 * size[s]}
        if not more:
            break
        capped |= more
    for s in size:
        target = 3 * size[s] if s in capped else left * weight[s] / weights
        assert abs(taken[s] - target) <= max([words[i] for i in words if source[i] == s]) / 2 + 1
    before, after = frames[4]
    ids = {r.doc_id: [*load_tokenizer(tokenizer_path()).encode(r.text, add_special_tokens=False).ids, 2] for r in before}
    assert sum(p.length for p in after) == sum(len(ids[r.doc_id]) for r in before)
    assert all(zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for p in after)


def test_run_has_the_rows_of_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).persist()
    assert sorted(docs.collect()) == sorted(corpus_pipeline.run(spark, SF).collect())


def test_odd_rows_pass_every_stage(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF).persist()
        docs.collect()
