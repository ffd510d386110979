"""Encoding with a public tokenizer, once per distinct pre-token.

Space and \\t \\n \\v \\f \\r are dropped by the tokenizer's pre-tokenizer, no
pre-token or special string contains them, and neither normalisation nor case
folding reaches across them.  A text's ids are therefore the ids of its runs
between them, one after another, and a run seen before need not be encoded again.
A very long run is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

TOKENIZER = "word_bpe_49k.json"
#: Distinct runs an encoder remembers before it forgets the rare ones; bounds a Python worker's memory.
REMEMBERED = 200_000
#: Uses from which a run is not rare.
OFTEN = 4


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_loaded: dict[str, object] = {}


def load_tokenizer(path: str):
    """The tokenizer at ``path``, loaded once in a Python worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _loaded[path] = tokenizer
    return _loaded[path]


RUNS_AT_ONCE = 1024


def _kinds() -> np.ndarray:
    """0: white space, 1: letter, 2: digit, 3: any other."""
    table = np.full(256, 3, np.uint8)
    table[128:] = 1
    table[ord("a") : ord("z") + 1] = table[ord("A") : ord("Z") + 1] = 1
    table[ord("0") : ord("9") + 1] = 2
    table[32] = 0
    return table


KINDS = _kinds()
#: The same of whole texts, where control characters are white space too.
KINDS_OF_TEXT = KINDS.copy()
KINDS_OF_TEXT[9:14] = 0
#: A pre-token of clean runs.
PRETOKEN = re.compile(rb"[a-zA-Z\x80-\xff]+|[0-9]|[^a-zA-Z0-9\x80-\xff ]+")


def _odd_bytes() -> np.ndarray:
    table = np.zeros(256, bool)
    table[:33] = table[[ord("'"), 127]] = True
    table[192:] = True
    table[[32, 0xC3, 0xC4, 0xC5]] = False
    return table


ODD = _odd_bytes()
#: Two bytes that are no letter, that folding makes two letters, or that may begin a special string.
ODD_PAIRS = [(0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0), (ord("<"), ord("|"))]


def odd_runs(runs: list[bytes]) -> np.ndarray:
    """Which runs are not of ASCII without apostrophe and of letters up to U+017F that folding keeps single.

    All others, the clean ones, fall into pre-tokens where letters, digits and other characters meet, and at every digit.
    """
    data = np.frombuffer(b" ".join(runs), np.uint8)
    odd = ODD[data]
    for one, two in ODD_PAIRS:
        odd[:-1] |= (data[:-1] == one) & (data[1:] == two)
    bad = np.zeros(len(runs), bool)
    bad[np.searchsorted(np.flatnonzero(data == 32), np.flatnonzero(odd))] = True
    return bad


def clean_and_odd(runs: Iterable[bytes]) -> tuple[list[bytes], list[bytes]]:
    runs = list(runs)
    which = odd_runs(runs).tolist()
    return [r for r, x in zip(runs, which, strict=True) if not x], [r for r, x in zip(runs, which, strict=True) if x]


def pretoken_starts(joined: bytes) -> np.ndarray:
    """Where pre-tokens begin in clean runs that single spaces separate."""
    kind = KINDS[np.frombuffer(joined, np.uint8)]
    new = np.empty(len(kind), bool)
    new[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    return (new & (kind > 0)) | (kind == 2)


_word_ends: dict[str, np.ndarray] = {}


def word_ends(path: str) -> np.ndarray:
    """Which ids end a pre-token."""
    if path not in _word_ends:
        tokenizer = load_tokenizer(path)
        suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
        ends = np.zeros(tokenizer.get_vocab_size() + 1, bool)
        if suffix:
            for token, i in tokenizer.get_vocab().items():
                ends[i] = token.endswith(suffix)
        _word_ends[path] = ends
    return _word_ends[path]


#: Steps before the model for which lower-cased clean pre-tokens need only their bytes named.
KNOWN_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
}
_short: dict[str, object] = {}


def short_tokenizer(path: str):
    """The same model behind a split at spaces, for lower-cased clean pre-tokens; none where the tokenizer's steps are not the known ones."""
    if path not in _short:
        tokenizer = load_tokenizer(path)
        steps = {k: getattr(tokenizer, k) for k in KNOWN_STEPS}
        steps = {k: None if x is None else json.loads(x.__getstate__()) for k, x in steps.items()}
        _short[path] = None
        if steps == KNOWN_STEPS and type(tokenizer.model).__name__ == "BPE" and not tokenizer.model.dropout:
            from tokenizers import Tokenizer
            from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

            tokenizer.model._resize_cache(0)  # pre-tokens come once
            _short[path] = Tokenizer(tokenizer.model)
            _short[path].pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
    return _short[path]


def encode_runs(path: str, clean: list[bytes], odd: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The runs in the order in which they were encoded, their numbers of ids, and all ids one after another.

    Clean runs are encoded many in a call.  An id that ends a pre-token tells where the next begins;
    should their number not be the runs' own, those runs are encoded one by one as odd ones are.
    """
    tokenizer, ends, odd = load_tokenizer(path), word_ends(path), list(odd)
    if not ends.any():
        clean, odd = [], clean + odd
    groups = [clean[i : i + RUNS_AT_ONCE] for i in range(0, len(clean), RUNS_AT_ONCE)]
    joined = [b" ".join(g) for g in groups]
    texts = joined
    if groups and (short := short_tokenizer(path)):
        tokenizer, texts = short, [b" ".join(PRETOKEN.findall(j)) for j in joined]
    done, lengths, ids = [], [], []
    for group, text, e in zip(groups, joined, tokenizer.encode_batch_fast([t.decode("utf-8").lower() if texts is not joined else t.decode("utf-8") for t in texts], add_special_tokens=False), strict=True):
        own, starts = np.array(e.ids, np.uint32), pretoken_starts(text)
        cuts = np.append(np.flatnonzero(np.frombuffer(text, np.uint8) == 32), len(text))
        pretokens = np.cumsum(starts)[cuts - 1]  # of the runs up to each
        last = np.flatnonzero(ends[own])
        if len(last) != pretokens[-1]:
            odd += group
            continue
        done += group
        lengths.append(np.diff(last[pretokens - 1] + 1, prepend=0))
        ids.append(own)
    encoded = [np.array(e.ids, np.uint32) for e in load_tokenizer(path).encode_batch_fast([r.decode("utf-8") for r in odd], add_special_tokens=False)]
    lengths.append(np.array([len(x) for x in encoded], np.int64))
    ids += encoded
    return done + odd, np.concatenate(lengths).astype(np.int64), np.concatenate(ids) if ids else np.zeros(0, np.uint32)


def fold(text: bytes) -> bytes:
    """A-Z folded where it cannot make a special string; the tokenizer folds them anyway."""
    return text if b"<|" in text else text.lower()


def pretokens_of(path: str, runs: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct pre-tokens of the runs, the places among them of each run's own, one run after another, and their number for each run."""
    bad = odd_runs(runs) if word_ends(path).any() else np.ones(len(runs), bool)
    order = np.argsort(bad, kind="stable")  # clean runs, then odd ones
    clean = int((~bad).sum())
    joined, odd = b" ".join([runs[i] for i in order[:clean].tolist()]), [runs[i] for i in order[clean:].tolist()]
    found = PRETOKEN.findall(joined)
    names = list(dict.fromkeys(chain(found, odd)))
    places = dict(zip(names, range(len(names)), strict=True))
    flat = np.fromiter(map(places.__getitem__, chain(found, odd)), np.int64, len(found) + len(odd))
    cuts = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))[:clean]
    number = np.concatenate([np.diff(np.cumsum(pretoken_starts(joined))[cuts - 1], prepend=0), np.ones(len(odd), np.int64)])
    n, first = np.empty(len(runs), np.int64), np.empty(len(runs), np.int64)
    n[order], first[order] = number, np.cumsum(number) - number
    return names, flat[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n


class Remembered:
    """Ids of byte strings seen before, in one flat array."""

    def __init__(self, most: int):
        self.most = most
        self.places: dict[bytes, int] = {}
        self.starts = self.lengths = self.used = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def forget(self) -> None:
        """Beyond the most, keeps the strings that were used often, or none if those are too many as well."""
        if len(self.places) <= self.most:
            return
        kept = np.flatnonzero(self.used >= OFTEN)
        kept = kept[: 0 if len(kept) > self.most // 2 else None]
        names = list(self.places)
        self.places = {names[i]: n for n, i in enumerate(kept.tolist())}
        self.ids = self.take(kept)
        self.lengths = self.lengths[kept]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.used = self.used[kept] // 2

    def add(self, names: list[bytes], lengths: np.ndarray, ids: np.ndarray) -> None:
        first = len(self.places)
        self.places.update(zip(names, range(first, first + len(names)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.used = np.concatenate([self.used, np.zeros(len(names), np.int64)])
        self.ids = np.concatenate([self.ids, ids])

    def find(self, names: list[bytes]) -> np.ndarray:
        """Places of strings; -1 of those not seen before."""
        return np.fromiter(map(self.places.get, names, repeat(-1)), np.int64, len(names))

    def take(self, at: np.ndarray) -> np.ndarray:
        """Ids of the strings at these places, one after another."""
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        return self.ids[np.repeat(self.starts[at] - ends + lengths, lengths) + np.arange(int(lengths.sum()))]


def units(joined: bytes, whole: bool) -> tuple[np.ndarray, pa.Array]:
    """Where pre-tokens of clean runs, and other runs, begin in a text, and their bytes; ``whole`` cuts no run."""
    data = np.frombuffer(joined, np.uint8)
    kind = KINDS_OF_TEXT[data]
    inner = kind > 0
    starts = inner.copy()
    starts[1:] &= ~inner[:-1]
    if not whole:
        odd = ODD[data]
        odd &= inner
        for one, two in ODD_PAIRS:
            odd[:-1] |= (data[:-1] == one) & (data[1:] == two)
        new = starts.copy()
        new[1:] |= kind[1:] != kind[:-1]
        new |= kind == 2
        new &= inner
        if odd.any():
            begin = np.flatnonzero(starts)
            runs = np.unique(np.searchsorted(begin, np.flatnonzero(odd), "right") - 1)
            inside = np.zeros(len(data) + 1, np.int8)
            inside[begin[runs]] = 1
            ends = np.flatnonzero(inner & ~np.append(inner[1:], False)) + 1
            inside[ends[runs]] -= 1
            new &= ~np.cumsum(inside[:-1], dtype=np.int8).view(bool)
            new |= starts
        starts = new
    offsets = np.append(np.flatnonzero(starts[inner]), int(inner.sum())).astype(np.int32)
    return np.flatnonzero(starts), pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data[inner])])


class RunEncoder:
    """Ids of whole texts; every distinct pre-token of clean runs, and every distinct other run, is encoded once."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.path = path
        self.known = Remembered(remembered)

    def encode(self, texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of the texts one after another, and the number of each; call it with some hundred texts at a time."""
        texts = list(texts)
        ends = np.cumsum([len(t) + 1 for t in texts])
        starts, names = units(b" ".join(map(fold, texts)), not word_ends(self.path).any())
        encoded = names.dictionary_encode()
        which, distinct = encoded.indices.to_numpy(), encoded.dictionary.to_numpy(zero_copy_only=False)
        self.known.forget()
        at = self.known.find(distinct.tolist())
        if len(new := np.flatnonzero(at < 0)):
            self.known.add(*encode_runs(self.path, *clean_and_odd(distinct[new].tolist())))
            at[new] = self.known.find(distinct[new].tolist())
        self.known.used[at] += np.bincount(which, minlength=len(at))
        at = at[which]
        total = np.concatenate([[0], np.cumsum(self.known.lengths[at])])
        return self.known.take(at), np.diff(total[np.searchsorted(starts, np.concatenate([[0], ends]))])


_encoders: dict[str, RunEncoder] = {}


def encoder(path: str) -> RunEncoder:
    """This Python worker's encoder, with the runs it remembers from earlier tasks."""
    if path not in _encoders:
        _encoders[path] = RunEncoder(path)
    return _encoders[path]
