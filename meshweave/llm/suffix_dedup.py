"""Removal of long repeated byte strings by merging Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts earlier.
Two equal strings contain the same minimiser (the least hashed substring of
``ANCHOR`` bytes), so the corpus is cut into pieces of consecutive starts with one
minimiser, and only minimisers that occur more than once go on.  Pieces of one
minimiser meet in one task.  There the pieces form shards with a
Burrows-Wheeler transform each, and the transforms are merged by refining their
interleave (Holt & McMillan 2014; common prefixes after Egidi & Manzini 2017):
after k rounds the merged order is that of the first k symbols, and the
boundaries between unequal prefixes are known.  No suffix is sorted again.  After
LENGTH symbols every interval without boundary is one repeated string; all its
starts but the first are reported.

Equal pieces of a block of documents travel as one.  A minimiser that occurs more than ``HOT``
times is replaced by the hash of the whole string, piece by piece, so that no task
gathers all of its surroundings.  Such strings may be in every block, so they meet in two
levels: each of about the root of the blocks' number of groups keeps the first, and
only those go on to their bucket.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, give_back, giving_back
from .hashing import Substrings

LENGTH = 100
ANCHOR = 40
#: Occurrences from which a minimiser is too frequent for one task.
HOT = 20_000
#: Text of a block of documents; a longer document is a block of its own.
BLOCK_BYTES = 4 << 20
#: Text for each of the groups that minimisers are dealt to; their number grows with the corpus.
BUCKET_BYTES = 8 << 20
#: Bytes of pieces in one shard, and in one merge.
SHARD_BYTES, MERGE_BYTES = 1 << 18, 1 << 20
#: Symbols that one round of refinement takes; divides LENGTH.
STEP = 4
#: Low bits of a hash that give way to its position, to tell two places of one minimiser.
PLACE = np.uint64(4095)


def minimisers(data: bytes, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first start and number of starts of each run of starts that share a place of it."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashed = Substrings(data).windows(anchor)
    width = LENGTH - anchor + 1
    # places wrap where a stretch of ``width`` ends, so that within one they are in order
    places = np.uint64((int(PLACE) + 1) // width * width)
    hashed = (hashed & ~PLACE) | (np.arange(len(hashed), dtype=np.uint64) % places)
    padded = np.concatenate([hashed, np.full(-len(hashed) % width, 2**64 - 1, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    back, ahead = back[:n], ahead[width - 1 : width - 1 + n]
    # of equals the first: then starts of equal strings never share a place
    least = np.where((back | PLACE) <= (ahead | PLACE), back, ahead)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return least[first] & ~PLACE, first, np.diff(np.append(first, n))


def shard_transform(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and Burrows-Wheeler symbols of one shard.

    ``text``: uint16 symbols of strings, each closed by a 0; ``ends``: the
    places of those zeros.  Suffixes are cyclic within their string; they are
    ordered by LENGTH symbols and then by place.  ``STEP`` preceding
    symbols, nearest last, are packed into one number for each suffix.
    """
    n = len(text)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts + 1
    first, span = np.repeat(starts, size), np.repeat(size, size)
    place = np.arange(n) - first
    rank, depth = text.astype(np.uint64), 1
    bits = np.uint64(max(9, int(n).bit_length()))
    at = np.arange(n, dtype=np.uint64)
    order = None
    while depth < LENGTH:
        ahead = rank[first + (place + depth) % span]
        key = np.sort((((rank << bits) | ahead) << bits) | at)
        order = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        key >>= bits
        new = np.empty(n, np.uint64)
        new[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])).astype(np.uint64)
        rank, depth = new, depth * 2
    before = np.zeros(n, np.uint64)
    for back in range(STEP, 0, -1):
        before = before * np.uint64(257) + text[first + (place - back) % span].astype(np.uint64)
    return order, before[order]


def merge_transforms(transforms: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' suffixes after LENGTH symbols, and the class of equal prefixes of each.

    A round takes the symbols before each suffix in the merged order and
    sorts by them stably; that is the order of the suffixes that begin STEP symbols earlier.
    A boundary is where these symbols differ or the suffixes after them did.
    """
    shards = np.repeat(np.arange(len(transforms), dtype=np.uint16), [len(t) for t in transforms])
    symbols = np.concatenate(transforms)
    n = len(symbols)
    shift = np.uint64(max(1, int(n).bit_length()))
    interleave = shards  # before the first round all suffixes are equal: shard after shard
    same = np.zeros(n, np.int64)
    place = np.arange(n, dtype=np.uint64)
    for _ in range(LENGTH // STEP):
        own = np.empty(n, np.uint64)
        own[np.argsort(interleave, kind="stable")] = symbols
        key = np.sort((own << shift) | place)
        order = (key & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
        key >>= shift
        interleave, behind = interleave[order], same[order]
        new = np.empty(n, bool)
        new[0] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        new[1:] |= behind[1:] != behind[:-1]
        same = np.cumsum(new)
    return interleave, same


def repeated_starts(strings: list[bytes], counts: np.ndarray, docs: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Which starts repeat an earlier string: booleans, piece by piece.

    A piece has ``counts`` starts, from place ``firsts`` of document ``docs``,
    and LENGTH - 1 more bytes than starts.
    """
    begun = np.cumsum(counts) - counts
    of = np.repeat(np.arange(len(strings)), counts)
    offset = np.arange(len(of)) - begun[of]
    transforms, numbers = [], []
    first = 0
    while first < len(strings):
        last, size = first, 0
        while last < len(strings) and (not size or size + len(strings[last]) < SHARD_BYTES):
            size, last = size + len(strings[last]) + 1, last + 1
        ends = np.cumsum([len(s) + 1 for s in strings[first:last]]) - 1
        text = np.frombuffer(b"\0".join(strings[first:last]) + b"\0", np.uint8).astype(np.uint16) + 1
        text[ends] = 0
        order, symbols = shard_transform(text, ends)
        number = np.full(len(text), -1)  # the start that a suffix is, or none
        own = slice(begun[first], begun[last - 1] + counts[last - 1])
        number[np.concatenate([[0], ends[:-1] + 1])[of[own] - first] + offset[own]] = np.arange(own.start, own.stop)
        transforms.append(symbols)
        numbers.append(number[order])
        first = last
    interleave, same = merge_transforms(transforms)
    merged = np.empty(len(interleave), np.int64)
    merged[np.argsort(interleave, kind="stable")] = np.concatenate(numbers)
    start, interval = merged[merged >= 0], same[merged >= 0]
    doc, place = docs[of[start]], firsts[of[start]] + offset[start]
    order = np.lexsort((place, doc, interval))
    start, interval, doc, place = start[order], interval[order], doc[order], place[order]
    head = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
    head = np.repeat(head, np.diff(np.append(head, len(start))))
    repeat = np.zeros(len(of), bool)
    repeat[start] = (doc != doc[head]) | (place != place[head])
    return repeat


def _packed(**arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte planes apart, compressed."""
    return zlib.compress(b"".join(np.ascontiguousarray(a.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays.values()), 1)


def _unpacked(data: bytes, n: int) -> list[np.ndarray]:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(n, 8, -1)
    return [np.ascontiguousarray(p.T).view(np.int64).ravel() for p in planes]


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and length of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2] - edges[::2]


def text_blocks(docs: DataFrame, keep: list[str], key: str, text: str) -> DataFrame:
    """block, kept (array of the columns in ``keep``), ids, sizes, body (the texts, compressed)."""
    rows = docs.select(F.struct(*keep).alias("kept"), F.coalesce(F.col(key).cast("bigint"), F.lit(-(2**63))).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            bodies = table.column("body").to_pylist()
            kept = table.column("kept").combine_chunks()
            kept = pa.concat_arrays(kept.chunks) if isinstance(kept, pa.ChunkedArray) else kept
            lists = pa.ListArray.from_arrays(pa.array([0, len(bodies)], pa.int32()), kept)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), lists, pa.array([table.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([[len(b) for b in bodies]], pa.list_(pa.int64())), pa.array([zlib.compress(b"".join(bodies), 1)], pa.binary())], ["block", "kept", "ids", "sizes", "body"])

        for batch in batches:
            sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column("body")]
            first = 0
            for i, n in enumerate(sizes):
                size += n
                if size >= BLOCK_BYTES:
                    held.append(batch.slice(first, i + 1 - first))
                    yield block()
                    number, held, size, first = number + 1, [], 0, i + 1
            if first < batch.num_rows:
                held.append(batch.slice(first))
        if held:
            yield block()

    return rows.mapInArrow(giving_back(build), f"block bigint, kept array<{rows.schema['kept'].dataType.simpleString()}>, ids array<bigint>, sizes array<bigint>, body binary")


def _cut(ids: list[int], sizes: list[int], body: bytes) -> tuple[list[bytes], dict[str, np.ndarray]]:
    """Texts of a block and all its pieces: minimiser, document, start, number of starts."""
    data, texts, at = zlib.decompress(body), [], 0
    found = {"anchor": [], "doc": [], "start": [], "n": []}
    for i, size in enumerate(sizes):
        texts.append(data[at : at + size])
        at += size
        anchor, start, n = minimisers(texts[-1])
        for name, x in zip(found, (anchor, np.full(len(start), i), start, n), strict=True):
            found[name].append(x)
    empty = {"anchor": np.uint64}
    return texts, {k: np.concatenate(v) if v else np.zeros(0, empty.get(k, np.int64)) for k, v in found.items()}


def _dealt(anchor: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of minimisers, the order by bucket and minimiser, and where each bucket begins in it."""
    bucket = ((anchor >> np.uint64(12)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((anchor, bucket))
    present, begins = np.unique(bucket[order], return_index=True)
    return present, order, np.append(begins, len(order))


def _kinds(table: pa.Table) -> pa.Table:
    """Kinds of a bucket's minimisers: 0 occurs once, 1 more often, 2 more than HOT times.  A block names each once, with a count."""
    lists, times = zip(*(_unpacked(x.as_py(), 2) for x in table.column("anchors")), strict=True)
    _, where = np.unique(np.concatenate([np.cumsum(x) for x in lists]), return_inverse=True)
    total = np.bincount(where, np.concatenate(times))[where]
    kind = np.where(total > HOT, 2, np.where(total > 1, 1, 0)).astype(np.uint8)
    cuts = np.cumsum([len(x) for x in lists])[:-1]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "kinds": pa.array([zlib.compress(x.tobytes(), 1) for x in np.split(kind, cuts)], pa.binary())})


def find_repeats(docs: DataFrame, *, keep: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """block, kept, ids, sizes, body, ranges (packed document, start, number of repeated starts) of every block."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    spread, merge, thin = max(1, math.isqrt(total // BLOCK_BYTES)), _merge_bucket, _first_of_equals
    blocks = checkpointed(text_blocks(docs, keep, key, text))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, cut = _cut(row["ids"], row["sizes"], row["body"])
                own, times = np.unique(cut["anchor"], return_counts=True)
                present, order, begins = _dealt(own, buckets)
                ordered, times = own[order].view(np.int64), np.minimum(times[order], HOT + 1)
                data = [_packed(steps=np.diff(ordered[a:b], prepend=0), times=times[a:b]) for a, b in zip(begins, begins[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(present), row["block"]), pa.int64()), pa.array(present, pa.int32()), pa.array(data, pa.binary())], ["block", "bucket", "anchors"])

    counted = blocks.select("block", "ids", "sizes", "body").mapInArrow(giving_back(anchors), "block bigint, bucket int, anchors binary")
    kinds = counted.groupBy("bucket").applyInArrow(_kinds, "block bigint, bucket int, kinds binary")
    # a block has at most as many buckets as minimisers
    kinds = kinds.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "kinds"))).alias("kinds"))

    names = ["bucket", "block", "pieces", "strings", "salt"]

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                texts, cut = _cut(row["ids"], row["sizes"], row["body"])
                _, order, _ = _dealt(cut["anchor"], buckets)
                ordered = cut["anchor"][order]
                first = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)]
                kind = np.frombuffer(b"".join(zlib.decompress(k["kinds"]) for k in row["kinds"]), np.uint8)[np.cumsum(first) - 1]
                anchor, doc, start, n = (cut[c][order[kind == 1]] for c in ("anchor", "doc", "start", "n"))
                hot, plain = order[kind == 2], len(anchor)
                if len(hot):  # one piece for each string
                    times = cut["n"][hot]
                    more = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    hot_doc, hot_start = np.repeat(cut["doc"][hot], times), np.repeat(cut["start"][hot], times) + more
                    whole = np.array([zlib.crc32(texts[d][s : s + LENGTH]) for d, s in zip(hot_doc.tolist(), hot_start.tolist(), strict=True)], np.uint64) << np.uint64(12)
                    anchor, doc, start, n = np.append(anchor, whole), np.append(doc, hot_doc), np.append(start, hot_start), np.append(n, np.ones(len(whole), np.int64))
                strings = [texts[d][s : s + k + LENGTH - 1] for d, s, k in zip(doc.tolist(), start.tolist(), n.tolist(), strict=True)]
                ids = np.array(row["ids"], np.int64)
                least = _least(strings, ids[doc], start) if strings else np.zeros(0, bool)
                # known already: a group of the block's own, below all buckets
                done = _packed(doc=doc[~least], start=start[~least], n=n[~least])
                yield pa.RecordBatch.from_arrays([pa.array([-1 - row["block"]], pa.int64()), pa.array([row["block"]], pa.int64()), pa.array([done], pa.binary()), pa.array([None], pa.binary()), pa.array([0], pa.int32())], names)
                kept = np.flatnonzero(least)
                salt = 1 + zlib.crc32(str(row["block"]).encode()) % spread
                for group, share in ((kept[kept < plain], 0), (kept[kept >= plain], salt)):
                    present, order, begins = _dealt(anchor[group], buckets)
                    for b, x, y in zip(present.tolist(), begins, begins[1:], strict=False):
                        own = group[order[x:y]]
                        pieces = _packed(anchor=anchor[own].view(np.int64), id=ids[doc[own]], doc=doc[own], start=start[own], n=n[own])
                        data = zlib.compress(b"".join([strings[i] for i in own]), 1)
                        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([row["block"]], pa.int64()), pa.array([pieces], pa.binary()), pa.array([data], pa.binary()), pa.array([share], pa.int32())], names)

    joined = blocks.select("block", "ids", "sizes", "body").join(kinds, "block")

    def first_level(table: pa.Table) -> pa.Table:
        if table.column("salt")[0].as_py():
            return thin(table)
        found = merge(table)
        none = pa.nulls(found.num_rows, pa.binary())
        return found.append_column("bucket", pa.nulls(found.num_rows, pa.int64())).append_column("pieces", none).append_column("strings", none)

    cut = joined.mapInArrow(giving_back(candidates), "bucket bigint, block bigint, pieces binary, strings binary, salt int")
    met = checkpointed(cut.groupBy("bucket", "salt").applyInArrow(first_level, "block bigint, ranges binary, bucket bigint, pieces binary, strings binary"))
    last = met.where("strings IS NOT NULL").select("bucket", "block", "pieces", "strings").groupBy("bucket").applyInArrow(merge, "block bigint, ranges binary")
    ranges = met.where("strings IS NULL").select("block", "ranges").unionByName(last)
    return blocks.join(ranges.groupBy("block").agg(F.collect_list("ranges").alias("ranges")), "block", "left")


def _least(strings: list[bytes], ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which pieces stand where the first of their equals stands."""
    number: dict[bytes, int] = {}
    same = np.fromiter((number.setdefault(s, len(number)) for s in strings), np.int64, len(strings))
    order = np.lexsort((start, ids, same))
    head = np.flatnonzero(np.concatenate([[True], same[order][1:] != same[order][:-1]]))
    head = np.repeat(order[head], np.diff(np.append(head, len(order))))
    least = np.empty(len(strings), bool)
    least[order] = (ids[order] == ids[head]) & (start[order] == start[head])
    return least


def _first_of_equals(table: pa.Table) -> pa.Table:
    """Of equal strings of whole pieces the first goes on, as rows of pieces and strings; the others are ranges."""
    columns, strings, block = [], [], []
    for row in table.to_pylist():
        own = _unpacked(row["pieces"], 5)
        data, ends = zlib.decompress(row["strings"]), np.cumsum(own[4] + LENGTH - 1).tolist()
        strings += [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        columns.append(own)
        block.append(np.full(len(own[0]), row["block"]))
    anchor, ids, doc, start, n = (np.concatenate(c) for c in zip(*columns, strict=True))
    block = np.concatenate(block)
    least = _least(strings, ids, start)
    out: list[dict] = []
    for name in np.unique(block).tolist():
        gone, own = np.flatnonzero((block == name) & ~least), np.flatnonzero((block == name) & least)
        if len(gone):
            out.append({"block": name, "ranges": _packed(doc=doc[gone], start=start[gone], n=n[gone])})
        if len(own):
            pieces = _packed(anchor=anchor[own], id=ids[own], doc=doc[own], start=start[own], n=n[own])
            out.append({"block": name, "bucket": table.column("bucket")[0].as_py(), "pieces": pieces, "strings": zlib.compress(b"".join([strings[i] for i in own]), 1)})
    return pa.Table.from_pylist(out, pa.schema([("block", pa.int64()), ("ranges", pa.binary()), ("bucket", pa.int64()), ("pieces", pa.binary()), ("strings", pa.binary())]))


def _merge_bucket(table: pa.Table) -> pa.Table:
    """Repeated starts among the pieces of one bucket, as packed ranges for each block."""
    blocks, packed = [], []
    columns, strings, block = [], [], []
    for row in table.to_pylist():
        if row["strings"] is None:  # repeats within a block are known already
            blocks.append(row["block"])
            packed.append(row["pieces"])
            continue
        own = _unpacked(row["pieces"], 5)
        data, ends = zlib.decompress(row["strings"]), np.cumsum(own[4] + LENGTH - 1).tolist()
        strings += [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        columns.append(own)
        block.append(np.full(len(own[0]), row["block"]))
    if strings:
        anchor, ids, doc, start, n = (np.concatenate(c) for c in zip(*columns, strict=True))
        block = np.concatenate(block)
        least = _least(strings, ids, start)
        found = [(np.flatnonzero(~least), np.zeros((~least).sum(), np.int64), n[~least])]
        kept = np.flatnonzero(least)
        kept = kept[np.argsort(anchor[kept], kind="stable")]
        begins = np.flatnonzero(np.concatenate([[True], anchor[kept][1:] != anchor[kept][:-1]]))
        batch: list[int] = []
        size = 0

        def flush() -> None:
            if batch:
                own = np.array(batch)
                repeat = repeated_starts([strings[i] for i in batch], n[own], ids[own], start[own])
                of = np.repeat(np.arange(len(own)), n[own])
                # runs end with their piece
                first = np.flatnonzero(repeat & ~np.concatenate([[False], repeat[:-1] & (of[1:] == of[:-1])]))
                last = np.flatnonzero(repeat & ~np.concatenate([repeat[1:] & (of[1:] == of[:-1]), [False]]))
                found.append((own[of[first]], first - (np.cumsum(n[own]) - n[own])[of[first]], last - first + 1))
                batch.clear()

        for a, b in zip(begins, np.append(begins[1:], len(kept)), strict=True):
            group = kept[a:b].tolist()
            if len(group) == 1:
                s, k = strings[group[0]], int(n[group[0]])
                if len({s[i : i + LENGTH] for i in range(k)}) == k:
                    continue
            batch += group
            size += sum(len(strings[i]) for i in group)
            if size >= MERGE_BYTES:
                flush()
                size = 0
        flush()
        piece, offset, times = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(block[piece], kind="stable")
        piece, offset, times = piece[order], offset[order], times[order]
        names, at = np.unique(block[piece], return_index=True)
        for name, a, b in zip(names.tolist(), at, np.append(at[1:], len(piece)), strict=True):
            blocks.append(name)
            packed.append(_packed(doc=doc[piece[a:b]], start=start[piece[a:b]] + offset[a:b], n=times[a:b]))
    give_back()
    return pa.table({"block": pa.array(blocks, pa.int64()), "ranges": pa.array(packed, pa.binary())})


def remove_repeats(docs: DataFrame, *, keep: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns in ``keep`` and __body (binary, what is left), __n_bytes, __n_removed, __n_spans of every row.

    A null text counts as empty; a null id comes before all others; rows that
    share an id share its places, so they are not earlier than one another.
    Texts shorter than LENGTH keep everything, a very long text is a block of its own, an empty table gives an empty result, other columns are ignored.
    """
    found = find_repeats(docs, keep=keep, key=key, text=text).select("kept", "sizes", "body", "ranges")
    kind = docs.select(F.struct(*keep).alias("kept")).schema["kept"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sizes = np.array(batch.column("sizes")[i].as_py(), np.int64)
                data = np.frombuffer(zlib.decompress(batch.column("body")[i].as_py()), np.uint8)
                begins = np.cumsum(sizes) - sizes
                cover = np.zeros(len(data) + 1, np.int32)
                for packed in batch.column("ranges")[i].as_py() or []:
                    doc, start, n = _unpacked(packed, 3)
                    np.add.at(cover, begins[doc] + start, 1)
                    np.add.at(cover, begins[doc] + start + n + LENGTH - 1, -1)
                gone = np.cumsum(cover, dtype=np.int32)[:-1] > 0
                bodies, removed, spans = [], [], []
                for a, size in zip(begins, sizes, strict=True):
                    own = gone[a : a + size]
                    bodies.append(data[a : a + size][~own].tobytes())
                    removed.append(int(own.sum()))
                    spans.append(len(_ranges(own)[0]))
                yield pa.RecordBatch.from_arrays([batch.column("kept")[i].values, pa.array(bodies, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], ["kept", "__body", "__n_bytes", "__n_removed", "__n_spans"])

    rows = found.mapInArrow(giving_back(run), f"kept {kind}, __body binary, __n_bytes bigint, __n_removed bigint, __n_spans bigint")
    return rows.select("kept.*", "__body", "__n_bytes", "__n_removed", "__n_spans")


def repeat_digests(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    found = remove_repeats(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("__text")), keep=["doc_id"], text="__text")
    return found.select("doc_id", F.col("__n_bytes").alias("n_bytes"), F.col("__n_removed").alias("n_removed"), F.col("__n_spans").alias("n_spans"), F.sha2("__body", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with their texts' repeats removed and n_chars, if there, counted anew.

    What is left of a character that a removed span cuts goes too; a null text stays null, an empty one empty.
    Nulls in other columns, repeated rows, ties and very long texts are as in ``remove_repeats``; columns may have any names.
    """
    rest = [c for c in docs.columns if c != text]
    named = docs.select(F.struct(*rest).alias("row"), F.col(text).isNull().alias("null"), F.col(key).alias("id"), F.col(text).alias("text"))
    found = remove_repeats(named, keep=["row", "null"], key="id")

    @F.pandas_udf("string")
    def readable(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for body in bodies:
            yield body.map(lambda x: bytes(x).decode("utf-8", "ignore"))
        body = None
        give_back()

    found = found.withColumn("left", F.when(~F.col("null"), readable("__body")))
    columns = {c: F.col("row").getField(c) for c in rest} | {text: F.col("left")}
    if "n_chars" in rest:
        columns["n_chars"] = F.when(F.col("__n_removed") > 0, F.length("left").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return found.select(*[columns[c].alias(c) for c in docs.columns])
