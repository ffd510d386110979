"""Blocks of documents with their distinct words, for work done once per distinct word.

A corpus has far fewer distinct words than words, and a block of some thousand
documents has far fewer than its documents together.  A block row holds its
distinct words in hash buckets and each document's (word, frequency) pairs as
compressed arrays.  Only the (block, bucket) word lists travel to be looked up;
frequencies stay with the block until the looked-up values come back.

Memory: a block holds at most ``BLOCK_BYTES`` of text, or one longer document.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, sliced
from .tokens import units as units_of

BLOCK_BYTES = 24 << 20
TEXTS_AT_ONCE = 1024
#: UTF-8 bytes of text cut into words at once.
BYTES_AT_ONCE = 2 << 20
SCHEMA = "block bigint, doc_ids array<bigint>, n_bytes array<bigint>, n_words array<bigint>, flags array<boolean>, pairs binary, buckets array<struct<bucket: int, words: binary, flagged: binary>>"
Units = Callable[[list[bytes]], tuple[list[bytes], np.ndarray, np.ndarray]]
_BUCKET = pa.struct([("bucket", pa.int32()), ("words", pa.binary()), ("flagged", pa.binary())])
_ARROW = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("flags", pa.list_(pa.bool_())), ("pairs", pa.binary()), ("buckets", pa.list_(_BUCKET))])


def pack(*arrays: np.ndarray, kind: str = "<u4") -> bytes:
    """Arrays of one length as unsigned integers, byte planes apart, compressed."""
    width = np.dtype(kind).itemsize
    return zlib.compress(b"".join(a.astype(kind).view(np.uint8).reshape(-1, width).T.tobytes() for a in arrays), 1)


def unpack(data: bytes, n: int, kind: str = "<u4") -> list[np.ndarray]:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(n, np.dtype(kind).itemsize, -1)
    return [np.ascontiguousarray(p.T).view(kind).ravel() for p in planes]


def buckets_for(docs: DataFrame, text: str = "text") -> int:
    """Hash buckets of words, the unit in which words are looked up: they grow with the square root of the corpus.

    A block's words then fall into buckets of several words at every size, and the words of all blocks into ever more buckets.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1024, 1 << int(np.ceil(np.log2(max(1.0, size**0.5 / 64)))))


def _block(number: int, docs: list[tuple[int | None, int, bool, np.ndarray]], places: dict[bytes, int], ordered: bool, units: Units | None, most: int) -> pa.RecordBatch:
    words, own = list(places), None
    if units:
        words, *own = units(words)
    hashed = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % most
    order = np.argsort(hashed, kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    lengths = np.array([len(d[3]) for d in docs], np.int64)
    size = max(1, len(words), len(places))
    sequence = np.concatenate([d[3] for d in docs]).astype(np.int64)
    if not own:
        sequence = rank[sequence]
    flags = np.array([d[2] for d in docs], bool)
    of = at = often = np.zeros(0, np.int64)
    if not ordered:
        pairs, often = np.unique(np.repeat(np.arange(len(docs)), lengths) * size + sequence, return_counts=True)
        of, at = pairs // size, pairs % size
    if own:  # from the words' frequencies to their units'
        which, n = own
        first, times = (np.cumsum(n) - n)[at], n[at]
        at = rank[which[np.repeat(first - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))]]
        pairs, inverse = np.unique(np.repeat(of, times) * size + at, return_inverse=True)
        often = np.bincount(inverse, np.repeat(often, times), minlength=len(pairs)).astype(np.int64)
        of, at = pairs // size, pairs % size
    if ordered:
        flagged = np.bincount(sequence[np.repeat(flags, lengths)], minlength=len(words)).astype(np.uint32)
    else:
        flagged = np.bincount(at[flags[of]], often[flags[of]], minlength=len(words)).astype(np.uint32)
    starts = np.searchsorted(hashed[order], np.arange(most + 1))
    buckets = []
    for b in np.flatnonzero(np.diff(starts)):
        part = order[starts[b] : starts[b + 1]]
        buckets.append({"bucket": int(b), "words": zlib.compress(b" ".join([words[i] for i in part]), 1), "flagged": pack(flagged[starts[b] : starts[b + 1]])})
    row = {"block": number, "doc_ids": [d[0] for d in docs], "n_bytes": [d[1] for d in docs], "n_words": lengths.tolist(), "flags": flags.tolist(), "pairs": pack(sequence) if ordered else pack(of, at, often), "buckets": buckets}
    return pa.RecordBatch.from_pylist([row], schema=_ARROW)


def _runs(sizes: list[int], begun: int) -> Iterator[tuple[int, int]]:
    """Rows [first, last) that go on with a block of ``begun`` bytes, or with the next one."""
    first = 0
    for i, n in enumerate(sizes):
        begun += n
        if begun >= BLOCK_BYTES or i == len(sizes) - 1:
            yield first, i + 1
            first, begun = i + 1, 0 if begun >= BLOCK_BYTES else begun


def _parts(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in lists of about BYTES_AT_ONCE, or of one longer text."""
    part = np.cumsum([0, *map(len, texts[:-1])]) // BYTES_AT_ONCE
    cuts = np.flatnonzero(np.diff(part)) + 1
    for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True):
        yield texts[first:last]


def build_blocks(docs: DataFrame, *, lower: bool, flag: Column, ordered: bool = False, units: Units | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Block rows of all documents.  ``flag`` marks documents whose frequencies are also summed by word.

    ``lower`` folds A-Z.  ``ordered`` keeps all words in their order (as places among the block's
    words) in place of the pairs.  ``units`` cuts words into the units that take their place (names,
    places of the words' units, number of units of each).  A null text counts as empty, a null key stays null.
    """
    most = buckets_for(docs, text)
    columns = docs.select(F.col(key).cast("bigint").alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"), flag.alias("f"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = (TaskContext.get().partitionId() << 32) - 1
        docs, places, size = [], {}, 0
        for batch in sliced(batches, TEXTS_AT_ONCE):
            keys, texts, flags = (batch.column(i).to_pylist() for i in range(3))
            for first, last in _runs(list(map(len, texts)), size):
                n, flat = [], []
                for some in _parts(texts[first:last]):
                    joined = b" ".join(some)
                    starts, words = units_of(joined.lower() if lower else joined, True)
                    encoded = words.dictionary_encode()
                    distinct = encoded.dictionary.to_numpy(zero_copy_only=False)
                    at = np.fromiter(map(places.get, distinct.tolist(), repeat(-1)), np.int64, len(distinct))
                    new = np.flatnonzero(at < 0)
                    at[new] = np.arange(len(places), len(places) + len(new))
                    places.update(zip(distinct[new].tolist(), at[new].tolist(), strict=True))
                    flat.append(at.astype(np.uint32)[encoded.indices.to_numpy()])
                    n += np.diff(np.searchsorted(starts, np.cumsum([0, *[len(t) + 1 for t in some]]))).tolist()
                flat = np.concatenate(flat)
                docs += zip(keys[first:last], map(len, texts[first:last]), flags[first:last], np.split(flat, np.cumsum(n)[:-1]), strict=True)
                size += sum(map(len, texts[first:last]))
                if size >= BLOCK_BYTES:
                    yield _block(number := number + 1, docs, places, ordered, units, most)
                    docs, places, size = [], {}, 0
        if docs:
            yield _block(number + 1, docs, places, ordered, units, most)
        del docs, places
        give_back()

    return columns.mapInArrow(build, SCHEMA)


def words_of(data: bytes) -> list[bytes]:
    return zlib.decompress(data).split(b" ")


def totals_by_document(blocks: DataFrame, looked_up: DataFrame, weigh: Callable[[np.ndarray], list[np.ndarray]], totals: list[str]) -> DataFrame:
    """Sums a block's looked-up values over each document's words.

    ``looked_up`` has block, bucket, value (``pack`` of one uint32 per word of
    that bucket).  ``weigh`` turns the block's values into float64 arrays, one
    for each name in ``totals``; each is summed with the document's frequencies.
    Returns doc_id, n_bytes, n_words, flag and the totals (double).  A block
    has at most a value for each bucket to gather.
    """
    gathered = looked_up.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "value"))).alias("values"))
    joined = blocks.drop("buckets").join(gathered, "block", "left")
    schema = "doc_id bigint, n_bytes bigint, n_words bigint, flag boolean, " + ", ".join(f"{t} double" for t in totals)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in ("doc_ids", "n_bytes", "n_words", "flags")}
                of, at, often = unpack(batch.column("pairs")[i].as_py(), 3)
                values = batch.column("values")[i].as_py() or []
                known = np.concatenate([unpack(v["value"], 1)[0] for v in values]) if values else np.zeros(0, np.uint32)
                n = len(row["doc_ids"])
                sums = [np.bincount(of, often * w[at], minlength=n) for w in weigh(known)] if len(of) else [np.zeros(n) for _ in totals]
                yield pa.RecordBatch.from_arrays([row[c].values for c in row] + [pa.array(s, pa.float64()) for s in sums], ["doc_id", "n_bytes", "n_words", "flag", *totals])

    return joined.mapInArrow(total, schema)
