"""Phrases whose words keep company: counts of n-grams within pieces of text, and the score of each phrase's weakest cut.

Identical pieces are counted once and carry their multiplicity.  Phrases grow level by level: a phrase of n words can be
frequent only where both of its parts of n - 1 words are, so tasks pass over the others by a bit array of the frequent ones' hashes (of
a bounded size; it lets too many through when it fills up, never too few).  A task counts the phrases of a block of pieces, weighted, and deals the sums
to hash buckets; DuckDB adds up a bucket, out of core where it is large.  A candidate's parts are frequent themselves: it
sends a request for each to where the part's count is, by a shuffle.
"""

from __future__ import annotations

import tempfile
import zlib
from collections import Counter
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, give_back, sliced, whole_groups
from .hashing import Substrings, mix

#: Words of a phrase, occurrences it needs, phrases of a language that are returned, and percent of a phrase's count at which a longer one replaces it.
MOST_WORDS, LEAST, TOP, PERCENT = 5, 100, 2000, 100
#: A-Z folded, and the characters that end a piece made line ends.
FOLD = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else b for b in bytes(range(256)).lower())
#: Pieces of more words are held in overlapping parts that begin with MARK, which no piece contains.
PART_WORDS, MARK = 1 << 16, b"\x0b"
#: Bytes of pieces in a block, and words of the corpus for each hash bucket.
BLOCK_BYTES, BUCKET_WORDS = 2 << 20, 4 << 20
#: Bits for each frequent phrase, and most bits at all (64 MB).
FILTER_BITS, MOST_BITS = 16, 1 << 29
#: Distinct phrases that a task holds before it deals their counts to the buckets, and compressed bytes that are inserted at once.
HELD_PHRASES, INSERT_BYTES = 300_000, 2 << 20
#: Memory of DuckDB for one bucket; beyond it the bucket is spilled.
BUCKET_MEMORY = "256MB"
#: Parts that a language's candidates are ranked in first.
SALTS = 64


def pieces_of(text: bytes, part_words: int = PART_WORDS) -> Iterator[bytes]:
    """The pieces that have words, one space between words; very long ones in marked parts that overlap by MOST_WORDS - 1 words."""
    for piece in text.translate(FOLD).split(b"\n"):
        words = piece.split()
        while len(words) > part_words + MOST_WORDS - 1:
            yield b" ".join([MARK, *words[: part_words + MOST_WORDS - 1]])
            words = words[part_words:]
        if words:
            yield b" ".join(words)


def piece_blocks(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, words (weighted), body (distinct pieces, compressed), weights: blocks of one language's pieces."""
    part_words = PART_WORDS
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("body")).where("body IS NOT NULL")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, int] = {}
            for name, body in zip(batch.column("lang").to_pylist(), batch.column("body"), strict=True):
                for piece in pieces_of(body.as_py(), part_words):
                    found[name, piece] = found.get((name, piece), 0) + 1
            columns = [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.binary()), pa.array(list(found.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "piece", "n"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, tuple[list, list]] = {}
        held = 0

        def block(name: str) -> pa.RecordBatch:
            pieces, weights = open_.pop(name)
            words = sum((1 + p.count(b" ") if p[:1] != MARK else part_words) * w for p, w in zip(pieces, weights, strict=True))
            data = [[name], [words], [zstandard.compress(b"\n".join(pieces), 1)], [zlib.compress(np.array(weights, np.int64).tobytes(), 1)]]
            return pa.RecordBatch.from_arrays([pa.array(d, kind) for d, kind in zip(data, (pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["lang", "words", "body", "weights"])

        for batch in batches:
            for name, piece, n in zip(batch.column("lang").to_pylist(), batch.column("piece").to_pylist(), batch.column("n").to_pylist(), strict=True):
                pieces, weights = open_.setdefault(name, ([], []))
                pieces.append(piece)
                weights.append(n)
                held += len(piece) + 64
                if held > BLOCK_BYTES:
                    yield from map(block, list(open_))
                    held = 0
        yield from map(block, list(open_))
        give_back()

    counted = rows.mapInArrow(distinct, "lang string, piece binary, n bigint").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    return checkpointed(counted.mapInArrow(packed, "lang string, words bigint, body binary, weights binary"))


def _hash_of_lang(lang: str) -> np.uint64:
    return np.uint64(zlib.crc32(lang.encode()) * 0x9E3779B97F4A7C15 % 2**64)


class _Filter:
    """Which phrases may be frequent, as bits at their hashes."""

    def __init__(self, bits: bytes):
        self.bits, self.mask = np.frombuffer(bits, np.uint8), np.uint64(8 * len(bits) - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def phrase_counts(body: bytes, weights: np.ndarray, n: int, lang: str = "", known: _Filter | None = None, into: Counter | None = None) -> Counter:
    """``into`` (or a new counter) with the weighted occurrences of the phrases of ``n`` words in pieces (a line each) whose parts of n - 1 words ``known`` may have."""
    data = np.frombuffer(body, np.uint8)
    gaps = np.flatnonzero((data == 32) | (data == 10))
    starts, ends = np.concatenate([[0], gaps + 1]), np.append(gaps, len(data))
    piece = np.concatenate([[0], np.cumsum(data[gaps] == 10)])
    last = np.searchsorted(piece, piece, side="right")  # one beyond the piece's last word
    first_of = np.searchsorted(piece, np.arange(len(weights)))
    marked = data[starts[first_of]] == MARK[0]
    at = np.arange(len(starts))
    ok = at + n <= last
    if marked.any():  # a part ends with words that the next one begins with, and begins with the mark
        ok &= ~marked[piece] | (at + MOST_WORDS <= last) & (at != first_of[piece])
    at = at[ok]
    if known is not None and len(at):
        sub, turn = Substrings(body), _hash_of_lang(lang)
        for k in (0, 1):
            at = at[known.has(mix(sub.hashes(starts[at + k], ends[at + k + n - 2]) ^ turn))]
    found = Counter() if into is None else into
    found.update([body[a:b] for a, b in zip(starts[at].tolist(), ends[at + n - 1].tolist(), strict=True)])
    again = at[weights[piece[at]] > 1]
    for a, b, w in zip(starts[again].tolist(), ends[again + n - 1].tolist(), weights[piece[again]].tolist(), strict=True):
        found[body[a:b]] += w - 1
    return found


def _bucket_sums(rows: DataFrame, n: int, least: int) -> DataFrame:
    """lang, phrase, words, f: each hash bucket's sums, counted in DuckDB; ``rows``: bucket, lang, phrases, counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(folder: str) -> duckdb.DuckDBPyConnection:
            con = duckdb.connect(config={"threads": 1, "memory_limit": BUCKET_MEMORY, "temp_directory": folder, "preserve_insertion_order": False})
            con.execute("CREATE TABLE part (lang VARCHAR, phrase BLOB, n BIGINT)")
            return con

        def sums(con: duckdb.DuckDBPyConnection) -> Iterator[pa.RecordBatch]:
            found = con.sql("SELECT lang, phrase, sum(n)::BIGINT AS f FROM part GROUP BY lang, phrase HAVING sum(n) >= ?", params=[least]).to_arrow_table()
            for batch in found.to_batches(max_chunksize=10_000):
                phrase = batch.column("phrase").cast(pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("lang").cast(pa.string()), phrase, pa.array(np.full(batch.num_rows, n, np.int32)), batch.column("f").cast(pa.int64())], ["lang", "phrase", "words", "f"])

        last, held = None, []

        def insert(con: duckdb.DuckDBPyConnection) -> None:
            langs, phrases, counts = [], [], []
            for lang, p, c in held:
                phrases += zstandard.decompress(p).split(b"\n")
                counts.append(np.frombuffer(zlib.decompress(c), np.int64))
                langs += [lang] * len(counts[-1])
            held.clear()
            con.register("block", pa.table({"lang": pa.array(langs, pa.string()), "phrase": pa.array(phrases, pa.binary()), "n": np.concatenate(counts)}))
            con.execute("INSERT INTO part SELECT * FROM block")
            con.unregister("block")

        with tempfile.TemporaryDirectory(prefix="bucket-") as folder:  # spill of this task alone, gone with it
            con, size = counted(folder), 0
            for batch in sliced(batches, 64):
                for bucket, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "lang", "phrases", "counts")), strict=True):
                    if held and (bucket != last or size > INSERT_BYTES):
                        insert(con)
                        size = 0
                    if last is not None and bucket != last:
                        yield from sums(con)
                        con.execute("TRUNCATE part")
                    last = bucket
                    held.append(row)
                    size += len(row[1]) + len(row[2]) + 64
            if last is not None:
                insert(con)
                yield from sums(con)
            con.close()
        give_back()

    dealt = rows.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "lang string, phrase string, words int, f bigint")


def _level(blocks: DataFrame, n: int, buckets: int, least: int, bits: bytes | None) -> DataFrame:
    """lang, phrase, words, f of the phrases of ``n`` words that occur ``least`` times."""
    sent = None if bits is None else blocks.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Filter(sent.value) if sent else None
        found: dict[str, Counter] = {}

        def dealt() -> Iterator[pa.RecordBatch]:
            for lang, counter in found.items():
                own: dict[int, list[bytes]] = {}
                for phrase in counter:
                    own.setdefault(zlib.crc32(phrase) % buckets, []).append(phrase)
                counts = [zlib.compress(np.array([counter[p] for p in some], np.int64).tobytes(), 1) for some in own.values()]
                phrases = [zstandard.compress(b"\n".join(some), 1) for some in own.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array([lang] * len(own), pa.string()), pa.array(phrases, pa.binary()), pa.array(counts, pa.binary())], ["bucket", "lang", "phrases", "counts"])
            found.clear()

        for batch in batches:
            for lang, body, weights in zip(*(batch.column(c) for c in ("lang", "body", "weights")), strict=True):
                lang = lang.as_py()
                phrase_counts(zstandard.decompress(body.as_py()), np.frombuffer(zlib.decompress(weights.as_py()), np.int64), n, lang, known, found.setdefault(lang, Counter()))
                if sum(map(len, found.values())) > HELD_PHRASES:
                    yield from dealt()
        yield from dealt()
        give_back()

    return checkpointed(_bucket_sums(blocks.mapInArrow(run, "bucket bigint, lang string, phrases binary, counts binary"), n, least))


def _filter_bits(frequent: DataFrame, count: int) -> bytes:
    """Bits at the hashes of frequent phrases; the size grows with their number up to MOST_BITS.  Slices are built in tasks."""
    size = min(MOST_BITS, max(1 << 20, 1 << (FILTER_BITS * count).bit_length()))
    slice_bits = 1 << 20

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            held = [p.encode() for p in batch.column("phrase").to_pylist()]
            ends = np.cumsum([len(p) for p in held])
            turn = np.array([_hash_of_lang(x) for x in batch.column("lang").to_pylist()], np.uint64)
            at = mix(Substrings(b"".join(held)).hashes(np.concatenate([[0], ends[:-1]]), ends) ^ turn) & np.uint64(size - 1)
            yield pa.RecordBatch.from_arrays([pa.array((at // np.uint64(slice_bits)).astype(np.int64)), pa.array((at % np.uint64(slice_bits)).astype(np.int64))], ["slice", "bit"])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in whole_groups(batches, ["slice"], at_once=1):
            bits = np.zeros(slice_bits, np.uint8)
            bits[table.column("bit").to_numpy()] = 1
            yield pa.RecordBatch.from_arrays([table.column("slice")[:1].combine_chunks(), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["slice", "bits"])

    rows = frequent.select("lang", "phrase").mapInArrow(places, "slice bigint, bit bigint").distinct()
    out = bytearray(size // 8)
    for number, bits in rows.repartition("slice").sortWithinPartitions("slice").mapInArrow(built, "slice bigint, bits binary").collect():  # MOST_BITS at most
        out[number * slice_bits // 8 : (number + 1) * slice_bits // 8] = bits
    return bytes(out)


def frequent_phrases(docs: DataFrame, *, lang: str = "lang", text: str = "text", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of up to MOST_WORDS words that occur ``least`` times, and (lang, n): all words."""
    blocks = piece_blocks(docs, lang, text)
    totals = blocks.groupBy("lang").agg(F.sum("words").alias("n"))
    words = blocks.agg(F.sum("words")).first()[0] or 0
    buckets, levels, bits = 1 + words // BUCKET_WORDS, [], None
    for n in range(1, MOST_WORDS + 1):
        levels.append(_level(blocks, n, buckets, least, bits))
        count = levels[-1].count()
        if not count or n == MOST_WORDS:
            break
        bits = _filter_bits(levels[-1], count)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out, totals


def scored_phrases(frequent: DataFrame, totals: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """lang, phrase, a, l, r, n, score of candidates that no longer candidate replaces."""
    exact = "decimal(38,0)"
    candidates = frequent.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    joined = lambda first, size: F.array_join(F.slice(F.col("w"), first, size), " ")
    cuts = candidates.select("lang", "phrase", "words", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = F.array(F.struct(F.lit(True).alias("first"), joined(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("first"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("part")))
    requests = cuts.select("lang", "phrase", "a", "k", F.explode(sides).alias("s")).select("lang", "phrase", "a", "k", "s.first", "s.part")
    counts = frequent.select(F.col("lang").alias("__lang"), F.col("phrase").alias("__part"), "f")
    replies = requests.join(counts, (F.col("lang") == F.col("__lang")) & (F.col("part") == F.col("__part")))
    both = replies.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r"))
    few = totals.count() <= 10_000
    both = both.join(F.broadcast(totals) if few else totals, "lang")
    score = F.expr(f"(cast(1000 as {exact}) * cast(a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as {exact}) * cast(r as decimal(19,0)))")
    weakest = both.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # every longer candidate sends its count to the phrases inside it
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda first: joined(first, size))))
    longer = candidates.where("words > 2").select(F.col("lang").alias("__lang"), F.explode(inner).alias("__part"), "a").groupBy("__lang", "__part").agg(F.max("a").alias("most"))
    kept = weakest.join(longer, (F.col("lang") == F.col("__lang")) & (F.col("phrase") == F.col("__part")), "left")
    kept = kept.where(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("a")))
    return kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, *, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP, percent: int = PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases by score.

    Texts have A-Z folded and are cut into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and tabs.  Candidates are phrases of 2 to
    5 words with a >= ``least`` occurrences.  Cut after its first k words a candidate has the score floor(1000 * a * n / (l * r)), l and r
    being the parts' occurrences and n all words of the language; its lowest cut counts, ties to the smallest k.  A candidate that lies in
    a longer one with at least ``percent`` percent of its occurrences is dropped.  Ties of the score go to the more frequent phrase, then by bytes.

    A null language is ``und``; a null, empty or blank text has no pieces; repeated rows count each; texts and
    pieces of any length are read whole; an empty table gives an empty result.  Other columns, of any names, are ignored.
    """
    found = scored_phrases(*frequent_phrases(docs, lang=lang, text=text, least=least), percent=percent)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within parts of a language, so that no task ranks all of one
    salted = found.withColumn("__salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__salt").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "__salt")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
