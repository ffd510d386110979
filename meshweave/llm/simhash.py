"""SimHash near-duplicates by tables of distances to pivots (Micó et al. 1994, over Hamming distances).

Every document has a 64-bit fingerprint; equal ones fall into one class at once.  The distances of a fingerprint to a
fixed set of reference fingerprints, the pivots, are looked up for five bands of its bits.  By the triangle inequality
a band in which two fingerprints have different distances to some pivot has at least one differing bit, so three differing
bits leave two bands of the five whose distances are all the same: pairs of classes meet on the pivot distances of two bands (ten pairs of bands, ten
nodes a class).  Within a node a pair is discarded when its distances to some pivot, over the whole fingerprint, differ by more
than three; what survives is verified on the fingerprints.

Only what connects classes is reported, not every pair.  A node of more than ``CHUNK`` classes is dealt to several tasks; each
links its share to one hub, the member nearest to the node's majority.  If classes of different components are left in it, it
branches: the bits on which the node does not agree yet are cut into four pieces, one of which must agree, and so on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, sliced, whole_groups
from .components import components
from .hashing import mix

WORDS, SEED = 3, 42
#: Links have at most so many differing bits.
BITS = 3
PIVOTS = 16
BANDS = 5
#: Pieces that a node's open bits are cut into when it branches: one more than bits may differ.
PIECES = BITS + 1
#: Classes of a node that one task compares.
CHUNK = 4096
#: Members of a node whose pairs are taken by their lag, over many nodes at a time.
SMALL = 48
_PIVOT = mix(np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes) -> int:
    """Majority of the shingles' hashes, bit by bit; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(WORDS, len(words))
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], gaps + 1])[: len(words) - width + 1].tolist()
    ends = np.append(gaps, len(joined))[width - 1 :].tolist()
    hashed = xxhash.xxh64_intdigest
    h = np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))
    # how often each value of each of the eight bytes occurs tells how often each bit is set
    at = h.astype("<u8").view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256, dtype=np.uint16)
    ones = np.bincount(at.ravel(), minlength=2048).reshape(8, 256) @ _OF_BYTE
    return int.from_bytes(np.packbits(2 * ones.ravel() > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed integer) of every row."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py()) for x in batch.column("body")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


def _masks(pieces: int, bits: list[int]) -> list[int]:
    """The given bits in so many pieces, as masks."""
    return [sum(1 << int(b) for b in part) for part in np.array_split(np.array(bits), pieces)]


BAND_MASKS = _masks(BANDS, list(range(64)))


def pivot_distances(fp: np.ndarray, mask: int = 2**64 - 1) -> np.ndarray:
    """(fingerprint, pivot) Hamming distances within a mask."""
    return np.bitwise_count((fp[:, None] ^ _PIVOT) & np.uint64(mask))


def _key(distances: np.ndarray) -> np.ndarray:
    """One 64-bit word for a row of distances; different rows may share one, equal rows do."""
    packed = np.ascontiguousarray(distances, np.uint8).view("<u8").reshape(len(distances), -1)
    out = np.zeros(len(distances), np.uint64)
    for k in range(packed.shape[1]):
        out = mix(out * np.uint64(0xD1342543DE82EF95) + packed[:, k] + np.uint64(k + 1))
    return out


def _roots(fp: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Node and mask of the agreed bits, for each two bands."""
    keys = [_key(pivot_distances(fp, m)) for m in BAND_MASKS]
    for number, (a, b) in enumerate(combinations(range(BANDS), 2), 1):
        yield mix(keys[a] * np.uint64(0xD1342543DE82EF95) + mix(keys[b]) + np.uint64(number)), BAND_MASKS[a] | BAND_MASKS[b]


def _children(node: np.ndarray, mask: int, fp: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """The same, below nodes that agree on ``mask``: each piece of the open bits with its pivot distances."""
    for number, piece in enumerate(_masks(PIECES, [b for b in range(64) if not mask >> b & 1]), 1):
        yield mix(node * np.uint64(0xD1342543DE82EF95) + mix(_key(pivot_distances(fp, piece)) + np.uint64(number))), mask | piece


def _expand(rows: DataFrame, roots: bool) -> DataFrame:
    """node, mask, fp, label of all nodes of classes (fp), or of the children of nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 8192):
            fp, label = batch.column("fp").to_numpy().view(np.uint64), batch.column("label").to_numpy()
            if roots:
                found = [(*x, slice(None)) for x in _roots(fp)]
            else:
                node, masks = batch.column("node").to_numpy().view(np.uint64), batch.column("mask").to_numpy()
                own = [(m, np.flatnonzero(masks == m)) for m in np.unique(masks).tolist()]
                found = [(*x, at) for m, at in own for x in _children(node[at], m % 2**64, fp[at])]
            for node, mask, at in found:
                signed = np.full(len(node), np.uint64(mask)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node.view(np.int64), signed, fp[at].view(np.int64), label[at])], ["node", "mask", "fp", "label"])

    return rows.mapInArrow(run, "node bigint, mask bigint, fp bigint, label bigint")


def _near(fp: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs are links: first by every pivot, then by the fingerprints."""
    left = np.arange(len(i))
    for k in range(table.shape[1]):
        left = left[np.abs(table[i[left], k] - table[j[left], k]) <= BITS]
    out = np.zeros(len(i), bool)
    out[left] = np.bitwise_count(fp[i[left]] ^ fp[j[left]]) <= BITS
    return out


def _links_of_many(fp: np.ndarray, label: np.ndarray, rest: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between different labels of small groups; ``rest``: rows from each to the end of its group."""
    table = pivot_distances(fp).astype(np.int8)
    for lag in range(1, int(rest.max(initial=0))):
        i = np.flatnonzero(rest > lag)
        i = i[label[i] != label[i + lag]]
        hit = _near(fp, table, i, i + lag)
        yield i[hit], i[hit] + lag


def _links_of_one(fp: np.ndarray, label: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that connect different labels of one group, no more than connect them."""
    table = pivot_distances(fp).astype(np.int8)
    names, label = np.unique(label, return_inverse=True)
    root = np.arange(len(names))
    left = np.arange(len(fp))
    hub = int(np.bitwise_count(fp ^ _majority(fp)).argmin())
    found = left[np.bitwise_count(fp ^ fp[hub]) <= BITS]
    for j in found.tolist():
        if root[label[j]] != root[label[hub]]:
            root[root == root[label[j]]] = root[label[hub]]
            yield hub, j
    common = root[label] == np.bincount(root[label]).argmax()  # no member of the largest part needs another of it
    order = np.concatenate([np.flatnonzero(~common), np.flatnonzero(common)])
    for k, i in enumerate(order[: int((~common).sum())].tolist()):
        others = order[k + 1 :]
        others = others[root[label[others]] != root[label[i]]]
        for j in others[_near(fp, table, np.full(len(others), i), others)].tolist():
            if root[label[j]] != root[label[i]]:
                root[root == root[label[j]]] = root[label[i]]
                yield i, j


def _majority(fp: np.ndarray) -> np.uint64:
    ones = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(fp), bitorder="little").view("<u8")[0]


def _compared(nodes: DataFrame) -> DataFrame:
    """a, b: links within nodes that one task can compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in whole_groups(batches, ["node"]):
            fp, label = table.column("fp").to_numpy().view(np.uint64), table.column("label").to_numpy()
            size = np.diff(begins)
            rest = np.repeat(np.where(size <= SMALL, begins[1:], begins[:-1]), size) - np.arange(len(fp))
            found = list(_links_of_many(fp, label, rest))
            for first, last in zip(begins[:-1][size > SMALL], begins[1:][size > SMALL], strict=True):
                pairs = np.array(list(_links_of_one(fp[first:last], label[first:last])), np.int64).reshape(-1, 2) + first
                found.append((pairs[:, 0], pairs[:, 1]))
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], ["a", "b"])

    dealt = nodes.select("node", "fp", "label").repartition("node").sortWithinPartitions("node", "fp")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _stars(large: DataFrame, chunk: int) -> DataFrame:
    """a, b: links between the hub of each large node and its members; ``large`` has n, the node's members."""
    parts = F.ceil(F.col("n") / chunk).cast("bigint")
    rows = large.select("node", "n", "fp", F.pmod(F.xxhash64("fp", "node"), parts).alias("part"))

    def central(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in whole_groups(batches, ["node", "part"]):
            fp, own, scores = table.column("fp").to_numpy().view(np.uint64), [], []
            for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                own.append(a + int(np.bitwise_count(fp[a:b] ^ _majority(fp[a:b])).argmin()))
                scores.append(int(1000 * (np.bitwise_count(fp[a:b] ^ fp[own[-1]]) <= BITS).sum() // (b - a)))
            yield from table.take(pa.array(own)).select(["node", "n", "fp"]).append_column("score", pa.array(scores, pa.int64())).to_batches()

    best = rows.repartition("node", "part").sortWithinPartitions("node", "part").mapInArrow(central, "node bigint, n bigint, fp bigint, score bigint")
    best = best.groupBy("node", "n").agg(F.max(F.struct("score", "fp")).alias("best"))
    hubs = best.select("node", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"), F.col("best.fp").alias("hub"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= BITS
    return rows.join(hubs, ["node", "part"]).where(near & (F.col("fp") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("fp").alias("b"))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with the least fingerprint known to be connected with theirs as label."""
    found = labels.select(F.col("member").alias("__member"), F.col("root").alias("__root"))
    return rows.drop("label").join(found, F.col("fp") == F.col("__member"), "left").withColumn("label", F.coalesce("__root", "fp")).drop("__member", "__root")


def _links(classes: DataFrame, chunk: int) -> DataFrame:
    """member, root over the classes' fingerprints."""
    nodes = _expand(classes.select("fp", F.col("fp").alias("label")), roots=True)
    links, labels = [], None
    while True:
        sizes = checkpointed(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))  # read back, so that a hot node's join can be split
        nodes = checkpointed(nodes.join(sizes, "node").select("node", "mask", "fp", "label", "n"))
        small, large = nodes.where(F.col("n") <= chunk), nodes.where(F.col("n") > chunk)
        links.append(checkpointed(_compared(small)))
        hot = not large.isEmpty()
        if hot:
            links.append(checkpointed(_stars(large, chunk)))
        edges = links[0]
        for more in links[1:]:
            edges = edges.unionByName(more)
        labels = components(edges)
        if not hot:
            return labels
        rows = _labelled(large, labels)
        several = rows.groupBy("node").agg(F.min("label").alias("first"), F.max("label").alias("last")).where("first <> last").select("node")
        nodes = _expand(checkpointed(rows.join(several, "node", "left_semi").select("node", "mask", "fp", "label")), roots=False)
        links = [labels.select(F.col("member").alias("a"), F.col("root").alias("b"))]


def simhash_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id for every row.

    component_id is the least id that a chain of links (three differing bits at most) reaches.  A null, empty or
    blank text has fingerprint zero and is linked like any other.  A row without id takes no part in the ids: it gets the component of its
    fingerprint's other rows, or null.  Repeated rows and equal fingerprints are in one class; ties need no care, since
    components have no order.  A very long text is hashed whole.  An empty table gives an empty result; other columns, of any names, are ignored.
    """
    found = checkpointed(fingerprints(docs, key, text))
    classes = checkpointed(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = checkpointed(_labelled(classes, _links(classes, chunk)))
    ids = checkpointed(roots.groupBy(F.col("label").alias("of")).agg(F.min("least").alias("component_id")))
    by_fp = roots.join(ids, F.col("label") == F.col("of")).select(F.col("fp").alias("of"), "component_id")
    joined = found.join(by_fp, F.col("fp") == F.col("of"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
