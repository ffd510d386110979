"""Near-duplicates by a chosen-path set similarity join (Christiani & Pagh 2017; CPSJoin 2018).

Sets of word shingles that are equal fall into one class at once.  Every class
has a signature of minwise tokens.  In each of several independent trees a node
picks one or two coordinates of the signature (1 / threshold on average), and a
class goes to the child of each picked coordinate's token, so that similar sets
share a leaf with the recall that the number of trees sets.

A node of at most ``SMALL`` members compares all of them.  A larger one first looks for hubs,
members that many others resemble, and compares with those alone: a
group of near copies becomes one component by as many comparisons as it has
members.  Where that has left a node with members of different components, those of
different components are compared on their full sets, all within the task that
has the node; a node too large for that (``CHUNK`` members, ``NODE_BYTES`` of text) branches on.

A link is what full sets confirm.  One between two classes that are connected
already can change no component and is not looked for.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, few_files, give_back, giving_back, sliced, whole_groups
from .components import components
from .hashing import mix, shingles

WORDS = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
COORDINATES = 96
TREES = 12
FIRST_DEPTH = 2
#: Members of a node that are all compared with each other at once.
SMALL = 32
#: Most members, and text of them, of a node that one task compares on full sets.
CHUNK, NODE_BYTES = 2048, 32 << 20
#: A member is a hub while it resembles this share of the rest of its node.
HUB = 1 / 64
#: Pairs whose full sets one task compares.
PAIRS_PER_TASK = 2000
#: Agreeing coordinates from which a pair is confirmed: 4.5 standard deviations below the threshold.
AGREEING = int(COORDINATES * PERCENT / 100 - 4.5 * (COORDINATES * PERCENT / 100 * (1 - PERCENT / 100)) ** 0.5)
_SHIFT = np.random.default_rng(77).integers(1, 2**63, COORDINATES, dtype=np.uint64)


def signature(tokens: np.ndarray) -> np.ndarray:
    """Sixteen bits of each coordinate's least token."""
    least = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for first in range(0, len(tokens), 4096):
        part = tokens[first : first + 4096, None] ^ _SHIFT
        part = (part ^ (part >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(least, part.min(axis=0), out=least)
    return mix(least).astype(np.uint16)


def _signatures(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, COORDINATES)


def sketch_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, class (digest of the set, null if empty), signature."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, signed = [], [], []
            for body in batch.column("body"):
                tokens = shingles(body.as_py(), WORDS)
                n.append(len(tokens))
                digest.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None)
                signed.append(signature(tokens).tobytes() if len(tokens) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(signed, pa.binary())], ["doc_id", "text_hash", "n_shingles", "class", "signature"])

    return rows.mapInArrow(giving_back(run), "doc_id bigint, text_hash bigint, n_shingles bigint, class binary, signature binary")


def _branch(node: np.ndarray, signed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of nodes (one for each row of ``signed``): positions and child ids."""
    draw = mix(node ^ np.uint64(0x9E3779B97F4A7C15))
    picks = [(np.arange(len(node)), draw % np.uint64(COORDINATES))]
    twice = np.flatnonzero((draw >> np.uint64(40)).astype(np.float64) / 2**24 < 100 / PERCENT - 1)
    other = (picks[0][1][twice] + np.uint64(1) + mix(draw[twice]) % np.uint64(COORDINATES - 1)) % np.uint64(COORDINATES)
    picks.append((twice, other))
    at = np.concatenate([p[0] for p in picks])
    coordinate = np.concatenate([p[1] for p in picks])
    token = signed[at, coordinate.astype(np.int64)].astype(np.uint64)
    return at, mix(node[at] * np.uint64(0xD1342543DE82EF95) + (token << np.uint64(8)) + coordinate + np.uint64(1))


def _expand(rows: DataFrame, depth: int, trees: int | None) -> DataFrame:
    """node, class, n_shingles: of each row's own node ``depth`` levels down, or from the roots of ``trees``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1024):
            signed = _signatures(batch.column("signature"))
            if trees is None:
                at, node = np.arange(batch.num_rows), batch.column("node").to_numpy().view(np.uint64)
            else:
                at = np.tile(np.arange(batch.num_rows), trees)
                node = mix(np.repeat(np.arange(1, trees + 1), batch.num_rows).astype(np.uint64))
            for _ in range(depth):
                of, node = _branch(node, signed[at])
                at = at[of]
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), batch.column("class").take(at), batch.column("n_shingles").take(at)], ["node", "class", "n_shingles"])

    return rows.mapInArrow(giving_back(run), "node bigint, class binary, n_shingles bigint")


def _members(nodes: DataFrame, rows: int) -> DataFrame:
    """node, n, shingles (both of the node), class, n_shingles of nodes with two members or more."""
    sizes = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles")).where("n > 1")
    return checkpointed(few_files(nodes.join(sizes, "node").select("node", "n", "shingles", "class", "n_shingles"), rows))


def _agreement(signed: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.count_nonzero(signed == one, axis=1)


def _central(signed: np.ndarray) -> int:
    """The member that agrees with the most frequent token of most coordinates."""
    low = (signed & np.uint16(255)).astype(np.int64) + np.arange(COORDINATES) * 256
    often = np.bincount(low.ravel(), minlength=COORDINATES * 256).reshape(COORDINATES, 256).argmax(axis=1)
    return int(_agreement(signed & np.uint16(255), often.astype(np.uint16)).argmax())


def _pairs_by_lag(signed: np.ndarray, rest: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Resembling pairs i, i + lag, where ``rest`` is the number of rows from i to the end of its group."""
    for lag in range(1, int(rest.max(initial=0))):
        every = np.flatnonzero(rest > lag)
        for first in range(0, len(every), 8192):
            i = every[first : first + 8192]
            agree = np.count_nonzero(signed[i] == signed[i + lag], axis=1)
            hit = agree >= AGREEING
            yield i[hit], i[hit] + lag, agree[hit]


def _stars(signed: np.ndarray, hubs: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of one large node: each hub with the members that resemble it and no hub before; the last few all."""
    left = np.arange(len(signed))
    hubs = list(hubs)
    while len(left) > SMALL:
        given = bool(hubs)
        hub = hubs.pop() if given else int(left[_central(signed[left])])
        agree = _agreement(signed[left], signed[hub])
        near = agree >= AGREEING
        others = near & (left != hub)
        yield np.full(others.sum(), hub), left[others], agree[others]
        if not given and near.sum() < HUB * len(left):
            return
        left = left[~near & (left != hub)]
    for i, j, agree in _pairs_by_lag(signed[left], len(left) - np.arange(len(left))):
        yield left[i], left[j], agree


def _candidates(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """a, b, agree: pairs worth a look, from all nodes; of larger nodes, b resembles the hub a.

    A node of more than CHUNK members is dealt to several tasks by (node, part).  Its hub, which
    the parts' own central members tell, goes to all of them.
    """
    parts = F.ceil(F.col("n") / CHUNK).cast("bigint")
    part = F.when(F.col("n") > CHUNK, F.pmod(F.xxhash64("class", "node"), parts)).otherwise(F.lit(0).cast("bigint"))
    rows = members.select("node", "n", "class").join(sketches, "class").select("node", part.alias("part"), "n", "class", "signature", F.lit(False).alias("hub"))
    large = rows.where(F.col("n") > CHUNK)
    if not members.where(F.col("n") > CHUNK).isEmpty():

        def central(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, begins in whole_groups(batches, ["node", "part"]):
                signed, found, scores = _signatures(table.column("signature")), [], []
                for a, b in zip(begins, begins[1:], strict=False):
                    one = a + _central(signed[a:b])
                    found.append(one)
                    scores.append(int(_agreement(signed[a:b], signed[one]).sum() * 1000 // (b - a)))
                table = table.take(pa.array(found)).select(["node", "n", "class", "signature"])
                yield from table.append_column("score", pa.array(scores, pa.int64())).to_batches()

        kind = "node bigint, n bigint, class binary, signature binary, score bigint"
        own = large.repartition("node", "part").sortWithinPartitions("node", "part").mapInArrow(giving_back(central), kind)
        best = own.groupBy("node", "n").agg(F.max(F.struct("score", "class", "signature")).alias("best"))
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))
        rows = rows.unionByName(best.select("node", every.alias("part"), "n", "best.class", "best.signature", F.lit(True).alias("hub")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in whole_groups(batches, ["node", "part"], at_once=1024):
            signed, names = _signatures(table.column("signature")), table.column("class").combine_chunks()
            size = np.diff(begins)
            rest = np.repeat(begins[1:], size) - np.arange(len(signed))
            few = table.column("n").to_numpy() <= SMALL
            found = list(_pairs_by_lag(signed, np.where(few, rest, 0)))
            hub = table.column("hub").to_numpy()
            for a, b in zip(begins[:-1], begins[1:], strict=True):
                if not few[a]:
                    found += [(a + i, a + j, agree) for i, j, agree in _stars(signed[a:b], np.flatnonzero(hub[a:b]).tolist())]
            if found:
                a, b, agree = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b)), pa.array(agree, pa.int32())], ["a", "b", "agree"])

    dealt = rows.repartition("node", "part").sortWithinPartitions("node", "part", "class")
    found = dealt.mapInArrow(giving_back(run), "a binary, b binary, agree int").where("a <> b")
    return found.groupBy("a", "b").agg(F.max("agree").alias("agree"))


def _confirmed(pairs: DataFrame, bodies: DataFrame, most: int) -> DataFrame:
    """The pairs (``most`` at most) whose full sets are similar enough.  a may be in any number of them."""
    one = bodies.select(F.col("class").alias("a"), F.col("body").alias("body_a"))
    other = bodies.select(F.col("class").alias("b"), F.col("body").alias("body_b"))
    joined = pairs.select("a", "b").join(other, "b").join(one, "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in batches:
            kept = []
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("body_a"), batch.column("body_b"), strict=True):
                if a != last:
                    last, known = a, shingles(zlib.decompress(x.as_py()), WORDS)
                own = shingles(zlib.decompress(y.as_py()), WORDS)
                both = len(np.intersect1d(own, known, assume_unique=True))
                kept.append(100 * both >= PERCENT * (len(own) + len(known) - both))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return checkpointed(joined.select("a", "b", "body_a", "body_b").coalesce(-(-most // PAIRS_PER_TASK) or 1).mapInArrow(giving_back(run), "a binary, b binary"))


def _links_of_node(labels: np.ndarray, signed: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links that connect different labels of a node, no more than connect them."""
    root = np.arange(int(labels.max()) + 1)
    size = np.array([len(s) for s in sets])
    begins = np.cumsum(size) - size
    words, codes = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(len(words), bool)
    common = np.bincount(labels).argmax()  # members of the most common label need no comparison with each other
    order = np.concatenate([np.flatnonzero(labels != common), np.flatnonzero(labels == common)])
    for k, i in enumerate(order[: int((labels != common).sum())].tolist()):
        others = order[k + 1 :]
        others = others[_agreement(signed[others], signed[i]) >= AGREEING]
        own = codes[begins[i] : begins[i] + size[i]]
        marked[own] = True
        for first in range(0, len(others), 256):
            some = others[first : first + 256]
            some = some[root[labels[some]] != root[labels[i]]]
            if not len(some):
                continue
            n = size[some]
            at = np.repeat(begins[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.add.reduceat(marked[codes[at]].astype(np.int64), np.cumsum(n) - n)
            for j in some[100 * both >= PERCENT * (n + size[i] - both)].tolist():
                if root[labels[i]] != root[labels[j]]:
                    root[root == root[labels[j]]] = root[labels[i]]
                    yield i, j
        marked[own] = False


def _links_within(members: DataFrame, sketches: DataFrame, bodies: DataFrame) -> DataFrame:
    """a, b: confirmed links between the labels of each node.  ``members``: node, class, label."""
    rows = members.select("node", "class", "label").join(sketches, "class").join(bodies, "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in whole_groups(batches, ["node"], at_once=1):
            names = table.column("class").to_pylist()
            signed = _signatures(table.column("signature"))
            for first, last in zip(begins, begins[1:], strict=False):
                of = slice(int(first), int(last))
                labels = np.unique(np.array(table.column("label")[of.start : of.stop].to_pylist(), object), return_inverse=True)[1]
                sets = [shingles(zlib.decompress(x.as_py()), WORDS) for x in table.column("body")[of.start : of.stop]]
                found = [(names[first + i], names[first + j]) for i, j in _links_of_node(labels, signed[of], sets)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], ["a", "b"])
        give_back()

    dealt = rows.select("node", "class", "label", "signature", "body").repartition("node").sortWithinPartitions("node")
    return dealt.mapInArrow(giving_back(run), "a binary, b binary")


def _labelled(rows: DataFrame, labels: DataFrame, name: str = "class", label: str = "label") -> DataFrame:
    found = labels.select(F.col("member").alias(f"__{name}"), F.col("root").alias(f"__{label}"))
    return rows.join(found, F.col(name) == F.col(f"__{name}"), "left").withColumn(label, F.coalesce(f"__{label}", name)).drop(f"__{name}", f"__{label}")


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members, with their labels, of nodes that have more than one label."""
    rows = _labelled(members, labels)
    several = rows.groupBy("node").agg(F.min("label").alias("first"), F.max("label").alias("last")).where("first <> last").select("node")
    return rows.join(several, "node", "left_semi")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose classes are in different components."""
    return _labelled(_labelled(pairs, labels, "a", "label_a"), labels, "b", "label_b").where("label_a <> label_b")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", trees: int = TREES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash (xxhash64 of the text) for every row.

    component_id is the least id that a chain of links reaches; kept is doc_id = component_id.
    A null or empty text has no shingles and is linked with nothing.  Rows
    without id are linked with nothing either: component_id null, kept true.  Repeated rows and
    texts of equal sets are in one class; ties need no care, since components have no order.  A very
    long text is hashed whole; it is in memory with one other text, or with NODE_BYTES of them.
    An empty table gives an empty result; other columns are ignored.
    """
    sketched = checkpointed(sketch_documents(docs, key, text))
    rows = sketched.where("class IS NOT NULL AND doc_id IS NOT NULL")
    size = sketched.count()
    classes = rows.groupBy("class").agg(F.min("doc_id").alias("least"), F.min("n_shingles").alias("n_shingles"), F.min("signature").alias("signature"))
    classes = checkpointed(few_files(classes, size))
    sketches = classes.select("class", "signature")
    members = _members(_expand(classes, FIRST_DEPTH, trees), size)
    pairs = checkpointed(few_files(_candidates(members, sketches), size))
    larger = members.where(F.col("n") > SMALL)
    needed = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).union(larger.select("class")).distinct()
    bodies = checkpointed(few_files(_bodies(docs, classes, needed, key, text), size))
    # the nearest for each class first: most other pairs then lie within a component
    count = pairs.count()
    first = pairs.groupBy("b").agg(F.max(F.struct("agree", "a")).alias("best")).select("best.a", "b")
    labels = components(_confirmed(first, bodies, count))
    labels = _connected(labels, _confirmed(_apart(pairs.join(first, ["a", "b"], "left_anti"), labels), bodies, count))
    fits = (F.col("n") <= CHUNK) & (8 * F.col("shingles") <= NODE_BYTES) | (F.col("n") == 2)
    ready = []
    while not larger.isEmpty():
        mixed = checkpointed(few_files(_mixed(larger, labels), size))
        ready.append(mixed.where(fits).select("node", "class", "label"))
        parents = mixed.where(~fits).select("node", "class")
        if parents.isEmpty():
            break
        larger = _members(_expand(parents.join(classes, "class").select("node", "class", "n_shingles", "signature"), 1, None), size)
    if ready:
        labels = _connected(labels, checkpointed(few_files(_links_within(functools.reduce(DataFrame.unionByName, ready), sketches, bodies), size)))
    least = _labelled(classes.select("class", "least"), labels)
    ids = least.groupBy("label").agg(F.min("least").alias("component_id"))
    by_class = least.join(ids, "label").select("class", "component_id")
    found = sketched.select("doc_id", "text_hash", "n_shingles", "class").join(by_class, "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"), "text_hash")


def _connected(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after more links."""
    if links.isEmpty():
        return labels
    return components(labels.select(F.col("member").alias("a"), F.col("root").alias("b")).unionByName(links))


def _bodies(docs: DataFrame, classes: DataFrame, needed: DataFrame, key: str, text: str) -> DataFrame:
    """class, body (compressed text) of one document of each class in ``needed``."""
    chosen = classes.select("class", "least").join(needed, "class", "left_semi").select(F.col("class").alias("__class"), F.col("least").alias("__id"))
    texts = docs.select(F.col(key).cast("bigint").alias("__key"), F.col(text).cast("binary").alias("body"))
    found = texts.join(chosen, F.col("__key") == F.col("__id")).select(F.col("__class").alias("class"), "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, data = [], []
            for name, body in zip(batch.column("class").to_pylist(), batch.column("body"), strict=True):
                body = body.as_py() or b""  # an id may occur with other texts, which have other classes
                if hashlib.blake2b(shingles(body, WORDS).tobytes(), digest_size=16).digest() == name:
                    names.append(name)
                    data.append(zlib.compress(body, 1))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(data, pa.binary())], ["class", "body"])

    return found.mapInArrow(giving_back(run), "class binary, body binary").dropDuplicates(["class"])


def drop_near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that are linked to a smaller id.

    Of rows that repeat an id and its text one stays; rows without id or without
    words (null, empty) all stay.  Columns may have any names.
    """
    found = checkpointed(near_duplicates(docs, key=key, text=text))
    size = found.count()
    named = docs.select(F.struct("*").alias("row"), F.col(key).cast("bigint").alias("id"), F.xxhash64(text).alias("hash"))
    pair = [F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")]
    gone = found.where("NOT kept").select(*pair).distinct()
    left = named.join(gone, ["id", "hash"], "left_anti")
    repeated = found.where("kept AND doc_id IS NOT NULL AND n_shingles > 0").groupBy(*pair).count().where("count > 1").drop("count")
    if not repeated.isEmpty():
        repeated = checkpointed(few_files(repeated, size))
        once = left.join(repeated, ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"])
        left = left.join(repeated, ["id", "hash"], "left_anti").unionByName(once)
    return few_files(left.select("row.*"), size)
