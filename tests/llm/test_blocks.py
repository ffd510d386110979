import numpy as np
from meshweave.llm import blocks
from meshweave.llm.tokens import units


def test_words_of_a_part_are_those_of_split():
    texts = [b"one two\tone\x0b\x0cthree", b"", b" \n", b"x\x1cy \xc2\xa0z", b"one", b"last two "]
    starts, words = units(b" ".join(texts), True)
    assert words.to_pylist() == b" ".join(texts).split()
    n = np.diff(np.searchsorted(starts, np.cumsum([0, *[len(t) + 1 for t in texts]])))
    assert n.tolist() == [len(t.split()) for t in texts]


def test_parts_hold_every_text_once(monkeypatch):
    monkeypatch.setattr(blocks, "BYTES_AT_ONCE", 10)
    texts = [b"x" * n for n in (3, 0, 4, 30, 2, 9, 1, 0)]
    parts = list(blocks._parts(texts))
    assert sum(parts, []) == texts and len(parts) > 2 and all(sum(map(len, p[:-1])) <= 10 for p in parts)
    assert list(blocks._parts([b""])) == [[b""]]
