"""Language-model scores of whole documents.

Every document counts: word counts and the unigram score come from all training
documents, and all of them train a gated recurrent network (``gru``) in numpy by truncated
backpropagation.  Tasks train on their own documents from the same parameters, and
the parameters are averaged after each round.  Scoring carries the state through a whole document.

The network's words are the most frequent ones.  All others share one output,
and a word's probability within it is its smoothed relative frequency, so that the
probabilities of all words add up to one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from .blocks import build_blocks, pack, unpack, words_of
from .common import checkpointed, crc_fold, tasks_for

#: Outputs before the words: the end of a text, and any other word.
END, OTHER = 0, 1
ROUNDS = 4
SMOOTHING = 0.1
#: Partitions among which the most frequent words are looked for.
TOP_PARTITIONS = 32
#: Parameters averaged as one row, and rows added in one task.
PART, FAN_IN = 8192, 64


def words_for(tokens: int) -> int:
    """Words with an output of their own: 4,094 at least, more with the cube root of the training tokens.

    Work for a token grows with the square root of the words, the parameters in proportion to them.
    """
    return max(4094, int(2 * tokens ** (1 / 3)))


def held_out(key: Column) -> Column:
    return crc_fold(key, 10) == 0


def _dictionary(blocks: DataFrame, tasks: int) -> DataFrame:
    """bucket, words, counts (packed): each distinct word once, with its number of training occurrences."""
    rows = blocks.select(F.explode("buckets").alias("b")).select("b.*")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, totals = None, {}

        def done() -> pa.RecordBatch:
            counts = np.fromiter(totals.values(), np.int64, len(totals))
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([zlib.compress(b" ".join(totals), 1)], pa.binary()), pa.array([pack(counts, kind="<u8")], pa.binary()), pa.array([int(counts.sum())], pa.int64()), pa.array([int((counts > 0).sum())], pa.int64())], ["bucket", "words", "counts", "total", "distinct"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    if totals:
                        yield done()
                    bucket, totals = row["bucket"], {}
                for w, n in zip(words_of(row["words"]), unpack(row["flagged"], 1)[0].tolist(), strict=True):
                    totals[w] = totals.get(w, 0) + n
        if totals:
            yield done()

    return rows.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(count, "bucket int, words binary, counts binary, total bigint, distinct bigint")


def _frequent(dictionary: DataFrame, most: int) -> tuple[list[bytes], list[int]]:
    """At most ``most`` words that occur more often than any other, most frequent first.

    Words that tie with the first one left out are left out too, so a count alone tells whether a word is in.
    """

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = [], np.zeros(0, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                words += words_of(row["words"])
                counts = np.append(counts, unpack(row["counts"], 1, "<u8")[0].astype(np.int64))
                if len(words) > 4 * (most + 1):
                    keep = np.lexsort((np.arange(len(words)), -counts))[: most + 1]
                    words, counts = [words[i] for i in keep], counts[keep]
        keep = np.lexsort((np.arange(len(words)), -counts))[: most + 1]
        yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in keep], pa.binary()), pa.array(counts[keep], pa.int64())], ["word", "n"])

    found = dictionary.select("words", "counts").mapInArrow(top, "word binary, n bigint").where("n > 0")
    # every partition sends its own most frequent words to the driver: a fixed number of them bounds that
    rows = found.repartition(TOP_PARTITIONS).orderBy(F.desc("n"), "word").limit(most + 1).collect()
    least = rows[most]["n"] if len(rows) > most else 0
    rows = [r for r in rows if r["n"] > least]
    return [bytes(r["word"]) for r in rows], [r["n"] for r in rows]


def _looked_up(blocks: DataFrame, dictionary: DataFrame, codes: dict[bytes, int], tasks: int) -> DataFrame:
    """block, bucket, value: counts and codes (packed) of a block's words."""
    shared = blocks.sparkSession.sparkContext.broadcast(codes)
    asked = blocks.select(F.col("block"), F.explode("buckets").alias("b")).select("block", "b.bucket", "b.words", F.lit(None).cast("binary").alias("counts"))
    known = dictionary.select(F.lit(None).cast("bigint").alias("block"), "bucket", "words", "counts")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        own = shared.value
        for batch in batches:
            blocks, buckets, values = [], [], []
            for row in batch.to_pylist():
                words = words_of(row["words"])
                if row["block"] is None:  # sorts before the blocks that ask
                    counts = dict(zip(words, unpack(row["counts"], 1, "<u8")[0].tolist(), strict=True))
                    continue
                blocks.append(row["block"])
                buckets.append(row["bucket"])
                values.append(pack(np.array([counts[w] for w in words]), np.array([own.get(w, OTHER) for w in words]), kind="<u8"))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(buckets, pa.int32()), pa.array(values, pa.binary())], ["block", "bucket", "value"])

    rows = known.unionByName(asked).repartition(tasks, "bucket").sortWithinPartitions("bucket", F.col("block").asc_nulls_first())
    return rows.mapInArrow(look_up, "block bigint, bucket int, value binary")


def _coded(blocks: DataFrame, values: DataFrame, least: int, base: float, rest: float, ends: int, rounds: int) -> DataFrame:
    """One row per block: its documents' totals, and the network codes of those that each round learns from.

    A document is closed by END; document i is learnt from in round i modulo ``rounds``.
    """
    gathered = values.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "value"))).alias("values"))
    joined = blocks.drop("buckets").join(gathered, "block", "left")
    names = ["doc_ids", "flags", "lengths", "n_known", "base", "rest", "codes", "kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sequence = unpack(row["pairs"], 1)[0]
                lengths = np.array(row["n_words"], np.int64)
                looked = [unpack(v["value"], 2, "<u8") for v in row["values"] or []]
                counts = np.concatenate([v[0] for v in looked]).astype(np.float64) if looked else np.zeros(0)
                own = np.concatenate([v[1] for v in looked]).astype(np.int64) if looked else np.zeros(0, np.int64)
                of = np.repeat(np.arange(len(lengths)), lengths)
                total = lambda w: np.bincount(of, w[sequence], minlength=len(lengths)) if len(of) else np.zeros(len(lengths))  # noqa: B023, E731
                smooth = np.log10(counts + SMOOTHING)
                end = np.log10(ends + SMOOTHING)
                basic = total(smooth) + end - base * (lengths + 1)
                other = total(np.where(counts < least, smooth - rest, 0.0))
                codes = np.zeros(int((lengths + 1).sum()), np.int64)
                closed = np.cumsum(lengths + 1) - 1
                inner = np.ones(len(codes), bool)
                inner[closed] = False
                codes[inner] = own[sequence]
                kind = "<u2" if codes.max(initial=0) < 2**16 else "<u4"
                turn = np.repeat(np.arange(len(lengths)) % rounds, lengths + 1)
                packed = [pack(codes[turn == k], kind=kind) for k in range(rounds)]
                known = total((counts > 0).astype(np.float64)) + (ends > 0)
                data = [row["doc_ids"], row["flags"], (lengths + 1).tolist(), known.astype(np.int64).tolist(), basic.tolist(), other.tolist()]
                kinds = [pa.list_(k) for k in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(data, kinds, strict=True)] + [pa.array([packed], pa.list_(pa.binary())), pa.array([kind])], names)

    return joined.mapInArrow(run, "doc_ids array<bigint>, flags array<boolean>, lengths array<bigint>, n_known array<bigint>, base array<double>, rest array<double>, codes array<binary>, kind string")


def _codes(data: bytes, kind: str) -> np.ndarray:
    return unpack(data, 1, kind)[0].astype(np.int64)


def train(coded: DataFrame, start: gru.Parameters, rounds: int = ROUNDS) -> gru.Parameters:
    """One pass over all training documents, a share of them in each round; parameters are averaged by words after each."""
    context = coded.sparkSession.sparkContext
    parameters = start
    for number in range(rounds):
        shared = context.broadcast(gru.flatten(parameters))

        def learn(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            learner = gru.Learner(gru.unflatten(shared.value, start))
            for batch in batches:
                for row in batch.to_pylist():
                    which, lengths = np.array(row["flags"], bool)[number::rounds], np.array(row["lengths"], np.int64)[number::rounds]
                    learner.learn(_codes(row["codes"], row["kind"])[np.repeat(which, lengths)], lengths[which])
            if learner.words:
                flat = gru.flatten(learner.p).astype(np.float64) * learner.words
                parts = [flat[i : i + PART].tobytes() for i in range(0, len(flat), PART)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([learner.words] * len(parts), pa.int64()), pa.array(parts, pa.binary())], ["part", "words", "total"])

        learnt = coded.select("flags", "lengths", F.get("codes", F.lit(number)).alias("codes"), "kind").mapInArrow(learn, "part int, words bigint, total binary")
        learnt, tasks = learnt.withColumn("task", F.spark_partition_id()), coded.rdd.getNumPartitions()
        while tasks > 1:  # no task adds more than FAN_IN rows
            learnt = learnt.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")).groupBy("part", "task").applyInArrow(_added, "part int, words bigint, total binary, task int")
            tasks = -(-tasks // FAN_IN)
        found = sorted(learnt.collect(), key=lambda r: r["part"])
        shared.unpersist()
        if found:
            parameters = gru.unflatten(np.concatenate([np.frombuffer(r["total"]) / r["words"] for r in found]), start)
    return parameters


def _added(rows: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x.as_py()) for x in rows.column("total")], axis=0)
    first = rows.slice(0, 1)
    return pa.table({"part": first.column("part"), "words": pa.array([pa.compute.sum(rows.column("words")).as_py()], pa.int64()), "total": pa.array([total.tobytes()], pa.binary()), "task": first.column("task")})


def score_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int | None = None, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Scores are log10 probabilities.  A null or empty text is its end alone; a
    null id counts as the empty text in the fold; repeated rows are documents of
    their own; words that tie in frequency are all in the network's vocabulary or none; a very long text is scored
    whole, in a lane of its own; other columns are ignored.  ``words`` sets the network's vocabulary in place of ``words_for``.  With no training documents every
    token is unknown and score is that of the network before training; an empty table gives an empty result.
    """
    blocks = checkpointed(build_blocks(docs, lower=True, flag=~held_out(F.col(key)), ordered=True, key=key, text=text))
    tasks = tasks_for(docs, blocks.count(), 2)
    dictionary = checkpointed(_dictionary(blocks, tasks))
    sums = dictionary.agg(F.sum("total"), F.sum("distinct")).first()
    ends = blocks.agg(F.sum(F.size(F.filter("flags", lambda x: x)))).first()[0] or 0
    n, v = (sums[0] or 0) + ends, (sums[1] or 0) + (ends > 0)
    frequent, counts = _frequent(dictionary, words or words_for(n))
    least = counts[-1] if counts else 1
    n_rest, v_rest = (sums[0] or 0) - sum(counts), (sums[1] or 0) - len(counts)
    codes = {w: i + 2 for i, w in enumerate(frequent)}
    base = np.log10(n + SMOOTHING * (v + 1))
    rest = np.log10(n_rest + SMOOTHING * (v_rest + 1))
    coded = checkpointed(_coded(blocks, _looked_up(blocks, dictionary, codes, tasks), least, float(base), float(rest), ends, rounds))
    learnt = train(coded, gru.initial(np.array([ends, n_rest, *counts], np.float64)), rounds)
    shared = docs.sparkSession.sparkContext.broadcast(gru.flatten(learnt))
    like = learnt

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parameters = gru.unflatten(shared.value, like)
        for batch in batches:
            for i in range(batch.num_rows):
                lengths = np.array(batch.column("lengths")[i].as_py(), np.int64)
                order = np.concatenate([np.arange(k, len(lengths), rounds) for k in range(rounds)])
                codes = np.concatenate([_codes(x, batch.column("kind")[i].as_py()) for x in batch.column("codes")[i].as_py()])
                own = np.array(batch.column("rest")[i].as_py())
                own[order] += gru.score(parameters, codes, lengths[order]) / np.log(10)
                columns = [batch.column(c)[i].values for c in ("doc_ids", "flags", "lengths", "n_known", "base")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(own, pa.float64())], ["doc_id", "flag", "n_tokens", "n_known", "base_score", "score"])

    scored = coded.mapInArrow(run, "doc_id bigint, flag boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select("doc_id", (~F.col("flag")).alias("held_out"), "n_tokens", "n_known", F.lit(int(n)).cast("bigint").alias("train_tokens"), "base_score", "score")
