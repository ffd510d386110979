"""Mixing sources to target weights by Pareto order sampling (Rosen 1997), in column expressions.

A source that must be taken e times gives floor(e) certain copies of each document.  The
rest of its words comes from a sample of fixed size without replacement in which every document has an inclusion
probability p of its own: documents are ranked by their random odds divided by their inclusion odds,
u(1-p) / ((1-u)p), and the source takes the prefix of that order whose words come nearest to what is wanted.

With r = e - floor(e), p = r (1 + (1 - r) h), where h falls from the shortest to the longest document
of the source and is 0 on average over its words.  Shorter documents are therefore likelier, which gives a
sample of given words more documents, and the expected words are those wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, few_files

#: Bits of md5 used for a document's random number.
RANDOM_HEX = 13


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def random_number(key: Column, text: Column, seed: int) -> Column:
    """In (0, 1), the same in every run for a key (for a text, where the key is null): the first 52 bits of an md5."""
    name = F.coalesce(key.cast("string"), F.md5(F.coalesce(text, F.lit(""))))
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), name)), 1, RANDOM_HEX)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**RANDOM_HEX))


def length_class(size: Column, mean: Column) -> Column:
    """0 to 1023, growing with a document's words; in integers, so that sums over a source are exact."""
    return F.floor(F.lit(1024) * size / (size + mean)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """source, source_size, rows -> the same with rank and target: weights repeat over the sources by code point, null last.

    All targets add up to the total size.  No target exceeds ``cap`` times its
    source; the excess goes to the others by weight.  With sources ordered by
    size / weight the capped ones are a prefix, so one window finds them.  This
    table has a row per source and holds no documents.
    """
    every = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    choice = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("rank", rank).withColumn("weight", choice.cast("bigint"))
    ranked = ranked.withColumn("total", F.sum("source_size").over(every)).withColumn("weights", F.sum("weight").over(every))
    smaller = Window.orderBy(F.col("source_size") / F.col("weight").cast("double"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - cap * F.coalesce(F.sum("source_size").over(smaller), F.lit(0))).cast("double") / (F.col("weights") - F.coalesce(F.sum("weight").over(smaller), F.lit(0))).cast("double")
    ranked = ranked.withColumn("level", level)
    ranked = ranked.withColumn("capped", F.col("weight") * F.col("level") > cap * F.col("source_size").cast("double"))
    ranked = ranked.withColumn("level", F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("weight").cast("double"), F.col("rank"), F.col("level").alias("level")))).over(every)["level"])
    target = F.when(F.col("capped"), F.lit(float(cap)) * F.col("source_size")).otherwise(F.col("weight") * F.col("level"))
    return ranked.select("source", "rank", "source_size", "rows", target.alias("target"))


def order_bucket(odds: Column, r: Column, buckets: int) -> Column:
    """Buckets that never fall where odds grow, of equal width in u where p is r; p is not far from it."""
    return F.least(F.floor(buckets / (1 + (1 - r) / (odds * r))), F.lit(buckets - 1)).cast("int")


def mix_sources(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 17, buckets: int = 4096, keep: tuple[str, ...] = ()) -> DataFrame:
    """How many words the mix takes of every document.

    Returns doc_id, size, source_size, target, taken, copies and the columns in
    ``keep``.  A null text has size 0, null sources form a source of their own,
    repeated rows are documents of their own (equal ids draw equal random
    numbers; ties are told apart by id, size and ``keep``, and rows equal in all of them are interchangeable),
    rows without id draw by their text, a very long text counts whole, an empty table gives an empty result
    and other columns are ignored.

    Only sums leave a source: the order is cut into ``buckets`` of
    about as many rows, a prefix sum over their words finds the one bucket in which the
    sample ends, and ranking happens inside (source, bucket), so that a source
    with a third of all rows is ranked by many tasks.
    """
    narrow = checkpointed(docs.select("doc_id", "source", *keep, word_count(F.col("text")).alias("size"), random_number(F.col("doc_id"), F.col("text"), seed).alias("u")))
    targets = source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")), weights, cap)
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("whole", F.floor(times).cast("bigint")).withColumn("r", times - F.floor(times))
    targets = targets.withColumn("wanted", F.col("target") - (F.col("whole") * F.col("source_size")).cast("double")).withColumnRenamed("source", "__source")
    mean = F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.col("rows"))).cast("bigint")
    targets = checkpointed(targets.withColumn("mean", mean).drop("rows"))

    def classed(targets: DataFrame) -> DataFrame:
        rows = narrow.join(targets, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
        return rows.withColumn("class", length_class(F.col("size"), F.col("mean")))

    classes = classed(targets).groupBy("rank").agg(F.sum(F.col("size") * F.col("class")).alias("classes"))
    rows = classed(checkpointed(targets.join(classes, "rank").coalesce(16)))  # a row a source
    h = (F.col("classes").cast("double") / F.col("source_size").cast("double") - F.col("class").cast("double")) / F.lit(1024.0)
    rows = rows.withColumn("p", F.when(F.col("r") > 0, F.col("r") * (1 + (1 - F.col("r")) * h)))
    rows = rows.withColumn("odds", (F.col("u") * (1 - F.col("p"))) / ((1 - F.col("u")) * F.col("p")))
    bucket = order_bucket(F.col("odds"), F.col("r"), buckets)
    rows = rows.withColumn("bucket", F.coalesce(bucket, F.pmod(F.xxhash64("u"), F.lit(buckets)).cast("int")))
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    starts = starts.select("rank", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("rank", "bucket").orderBy("odds", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(starts, ["rank", "bucket"])
    first = F.col("start") + F.col("before")
    nearer = (2 * first + F.col("size")).cast("double") <= 2 * F.col("wanted")
    copies = F.col("whole") + F.when((F.col("r") > 0) & nearer, 1).otherwise(0)
    rows = rows.withColumn("copies", copies.cast("int"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", *keep)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Rows that repeat an id, text and source share their copies.  Nulls, empty texts and empty tables are as in
    ``mix_sources``; columns may have any names.
    """
    named = docs.select(F.struct("*").alias("row"), "doc_id", "source", "text", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"), F.xxhash64("text", "source").alias("hash"))
    taken = mix_sources(named, keep=("id", "hash"), **options).groupBy("id", "hash").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    taken = checkpointed(few_files(taken, named.count()))
    single = named.join(taken.where("rows = 1 AND copies > 0"), ["id", "hash"])
    if not taken.where("rows > 1").isEmpty():
        single = single.unionByName(named.join(taken.where("rows > 1 AND copies > 0"), ["id", "hash"]).dropDuplicates(["id", "hash"]))
    return single.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
