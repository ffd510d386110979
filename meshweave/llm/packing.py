"""Mixture-controlled packing by deficit round-robin over source queues.

Queues are served in rounds.  A round adds ``share * QUANTUM`` to the deficit of each queue that
still has tokens and lays down as many of its tokens as the deficit has whole ones,
cutting a document where that ends; the rest of the deficit is carried to the
next round.  The rounds follow one another in one stream of tokens, which is cut into
windows.  With a quantum of a window every window holds a round or two parts of
rounds, each of the target proportions.

What a queue has been served before a round is known without the rounds before
it: deficits only ever keep a fraction of a token, so it is the whole part of what
the rounds have added.  Buckets of documents are therefore packed by tasks of their own.
All that a bucket needs of the others is how many tokens of each queue they hold.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, giving_back, running_total
from .tokens import encoder, tokenizer_path

WINDOW = 4096
#: The id that ends a document.
END = 2
#: UTF-8 bytes of text of one bucket; bounds the memory of a packing task.
BUCKET_BYTES = 8 << 20
#: UTF-8 bytes of text encoded at once, or one longer text.
BYTES_AT_ONCE = 1 << 20
#: Sources beyond so many share queues: a window cannot mix more than it has tokens.
MOST_QUEUES = 1024
#: Rounds worked out at once.
ROUNDS = 8192


def encode_documents(docs: DataFrame, path: str, buckets: int) -> DataFrame:
    """doc_id, queue, bucket, n (ids with the end), ids (compressed little-endian, two bytes each where that is enough)."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    queue = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    rows = docs.select("doc_id", queue.alias("queue"), body.alias("body"), F.pmod(F.xxhash64("doc_id", F.crc32(body)), F.lit(buckets)).cast("int").alias("bucket"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            size = np.cumsum(pa.compute.binary_length(batch.column("body")).to_numpy()) // BYTES_AT_ONCE
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
            for first, last in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(first, last - first)
                ids, lengths = own.encode(part.column("body").to_pylist())
                kind = "<u2" if not len(ids) or ids.max() < 2**16 else "<u4"
                ends = np.cumsum(lengths + 1)
                closed = np.full(int(ends[-1]), END, kind)
                inner = np.ones(len(closed), bool)
                inner[ends - 1] = False
                closed[inner] = ids
                data = [zlib.compress(closed[a:b].tobytes(), 1) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("queue"), part.column("bucket"), pa.array(lengths + 1, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "queue", "bucket", "n", "ids"])

    return rows.mapInArrow(giving_back(encode), "doc_id bigint, queue string, bucket int, n bigint, ids binary")


@dataclass(frozen=True)
class Epoch:
    """Rounds [first, last) in which the same queues have tokens: the stream's place before them, weights, tokens served before, sizes."""

    first: int
    last: int
    place: int
    quantum: int
    queues: list[str]
    weights: list[int]
    served: list[int]
    sizes: list[int]

    def totals(self, start: int, count: int) -> np.ndarray:
        """(queue, round) tokens served before each of ``count`` rounds from ``start``."""
        whole, later = sum(self.weights), np.arange(count)
        out = np.empty((len(self.queues), count), np.int64)
        for k, (weight, served, size) in enumerate(zip(self.weights, self.served, self.sizes, strict=True)):
            step, more = divmod(weight * self.quantum, whole)
            base, carried = divmod(weight * self.quantum * (start - self.first), whole)
            out[k] = np.minimum(size, served + base + step * later + (carried + more * later) // whole)
        return out

    def rounds_until(self, k: int, tokens: int) -> int:
        """Rounds of this epoch after which queue k has been served so many tokens."""
        return -(-(tokens - self.served[k]) * sum(self.weights) // (self.weights[k] * self.quantum))


def schedule(sizes: dict[str, int], weights: dict[str, int], quantum: int = WINDOW) -> list[Epoch]:
    """Epochs until all queues are empty.  Queues without weight are served last, by their sizes."""
    served, place, first, epochs = dict.fromkeys(sizes, 0), 0, 0, []
    while left := sorted(q for q in sizes if served[q] < sizes[q]):
        queues = [q for q in left if weights.get(q, 0) > 0]
        own = [weights[q] for q in queues] if queues else [sizes[q] for q in left]
        queues = queues or left
        epoch = Epoch(first, 0, place, quantum, queues, own, [served[q] for q in queues], [sizes[q] for q in queues])
        last = first + min(epoch.rounds_until(k, sizes[q]) for k, q in enumerate(queues))
        epochs.append(Epoch(first, last, place, quantum, queues, own, epoch.served, epoch.sizes))
        for q, n in zip(queues, epoch.totals(last, 1)[:, 0].tolist(), strict=True):
            place += n - served[q]
            served[q] = n
        first = last
    return epochs


def laid_down(epochs: list[Epoch], queue: str, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """First token of each stretch of a queue's tokens [low, high) that lies together in the stream, and its place there."""
    starts, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for epoch in epochs:
        if low >= high:
            break
        if queue not in epoch.queues:
            continue
        k = epoch.queues.index(queue)
        end = int(epoch.totals(epoch.last, 1)[k, 0])
        if low >= end:
            continue
        now = epoch.first + epoch.rounds_until(k, low + 1) - 1
        stop = epoch.first + epoch.rounds_until(k, min(high, end))
        for start in range(now, stop, ROUNDS):
            totals = epoch.totals(start, min(ROUNDS, stop - start) + 1)
            round_place = epoch.place + (totals - np.array(epoch.served)[:, None]).sum(axis=0)[:-1]
            place = round_place + np.diff(totals[:k], axis=1).sum(axis=0)
            begin = np.maximum(totals[k, :-1], low)
            some = begin < np.minimum(totals[k, 1:], high)
            starts.append(begin[some])
            places.append((place + begin - totals[k, :-1])[some])
        low = min(high, end)
    return np.concatenate(starts), np.concatenate(places)


def pieces_of(starts: np.ndarray, places: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Document number, start in the document, length and place in the stream of each piece.

    ``starts``, ``places``: stretches of one queue; ``bounds``: its documents' first tokens and the end of the last.
    """
    ends = np.append(starts[1:], bounds[-1])
    joined = np.zeros(len(starts), bool)  # stretches that go on where the one before them ends
    joined[1:] = places[1:] == places[:-1] + starts[1:] - starts[:-1]
    crossed = (places + ends - starts - 1) // window - places // window
    of = np.repeat(np.arange(len(starts)), crossed)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(crossed) - crossed, crossed) + 1
    at_window = starts[of] + (places[of] // window + nth) * window - places[of]
    cuts = np.unique(np.concatenate([starts[~joined | (places % window == 0)], bounds[:-1], at_window]))
    stretch = np.searchsorted(starts, cuts, "right") - 1
    doc = np.searchsorted(bounds, cuts, "right") - 1
    return doc, cuts - bounds[doc], np.diff(np.append(cuts, bounds[-1])), places[stretch] + cuts - starts[stretch]


def _ids(data: bytes, n: int) -> np.ndarray:
    raw = zlib.decompress(data)
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")


def pack_documents(docs: DataFrame, *, window: int = WINDOW, shares: dict[str | None, float] | None = None, path: str | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    ``shares`` gives each source's share of a window (others come last, in one queue); without it each has its
    share of all tokens, so that all queues last to the end.  All documents are packed
    either way: a queue without documents left is passed over and the rest share the window.
    Beyond MOST_QUEUES sources, a queue holds the documents of several.

    A null text is one end id; a null source has its own queue; repeated rows are documents of
    their own and ties of ids are laid down by their tokens; a very long text is cut like any other (its ids are in
    memory whole); an empty table gives no pieces; other columns are ignored.
    """
    path = path or tokenizer_path()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    encoded = checkpointed(encode_documents(docs, path, buckets))
    name = F.col("queue")
    if shares is not None:
        weights = {"" if k is None else f"={k}": max(1, int(v * 2**40)) for k, v in shares.items() if v > 0}
        name = F.when(name.isin(list(weights)), name).otherwise("~")
    elif encoded.select("queue").distinct().limit(MOST_QUEUES + 1).count() > MOST_QUEUES:
        name = F.pmod(F.xxhash64("queue"), F.lit(MOST_QUEUES)).cast("string")
    rows = encoded.withColumn("source", F.when(name == F.col("queue"), F.lit(None)).otherwise(F.col("queue"))).withColumn("queue", name)
    tokens = rows.groupBy("bucket", "queue").agg(F.sum("n").alias("n"))
    sizes = {r["queue"]: r["n"] for r in tokens.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # a row a queue
    epochs = schedule(sizes, sizes if shares is None else weights, window)
    before = running_total(tokens, ["queue"], "bucket", "n", "served").select(F.col("bucket").alias("of"), F.col("queue").alias("name"), "served")
    kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("queue", pa.string())])

    def pack(table: pa.Table, served: pa.Table) -> pa.Table:
        so_far = dict(zip(served.column("name").to_pylist(), served.column("served").to_pylist(), strict=True))
        out = []
        table = table.sort_by([("queue", "ascending"), ("doc_id", "ascending"), ("n", "ascending"), ("ids", "ascending")])
        for queue in sorted(so_far):
            own = table.filter(pa.compute.equal(table.column("queue"), queue))
            lengths = own.column("n").to_numpy()
            ids = np.concatenate([_ids(x.as_py(), n) for x, n in zip(own.column("ids"), lengths.tolist(), strict=True)])
            bounds = so_far[queue] + np.concatenate([[0], np.cumsum(lengths)])
            starts, places = laid_down(epochs, queue, int(bounds[0]), int(bounds[-1]))
            doc, start, length, place = pieces_of(starts, places, bounds, window)
            begin = 4 * (bounds[doc] + start - bounds[0])
            data = memoryview(ids.tobytes())
            crc = [zlib.crc32(data[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True)]
            doc = pa.array(doc)
            names = pa.compute.coalesce(own.column("source"), own.column("queue")).take(doc)
            out.append(pa.table([own.column("doc_id").take(doc), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), own.column("n").take(doc), pa.array(place // window), pa.array(place % window), names], schema=kind))
        return pa.concat_tables(out)

    packed = rows.groupBy("bucket").cogroup(before.groupBy("of")).applyInArrow(pack, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, queue string")
    return packed.withColumn("source", F.when(F.col("queue") != "", F.expr("substring(queue, 2)"))).drop("queue")
