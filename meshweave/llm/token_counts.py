"""Token counts of whole texts without materialising ids.

Pieces are counted once per distinct pre-token of the corpus and joined
to the documents' pre-token frequencies through ``blocks``.  A run between white space is cut
into the tokenizer's pre-tokens where its characters leave no doubt (``tokens.clean_and_odd``);
any other run is looked up whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import build_blocks, pack, totals_by_document, words_of
from .common import checkpointed, tasks_for
from .tokens import clean_and_odd, encode_runs, pretokens_of, tokenizer_path


def count_tokens(docs: DataFrame, *, limit: int = 2048, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row.

    A null or empty text has 0 tokens; repeated rows, ties, null ids and other columns
    need no care; a very long text is a block of its own; an empty table gives an empty result.  All rows of a word's
    bucket meet in one task, sorted by bucket, so a task remembers the counts
    of one bucket at a time and no word is encoded twice.
    """
    path = path or tokenizer_path()
    blocks = checkpointed(build_blocks(docs, lower=False, flag=F.lit(False), units=lambda runs: pretokens_of(path, runs)))
    words = blocks.select("block", F.explode("buckets").alias("b")).select("block", "b.bucket", "b.words")
    tasks = tasks_for(docs, blocks.count(), 4)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, known = None, {}
        for batch in batches:
            values = []
            for b, data in zip(batch.column("bucket").to_pylist(), batch.column("words"), strict=True):
                if b != bucket:
                    bucket, known = b, {}
                own = words_of(data.as_py())
                new = [w for w in own if w not in known]
                if new:
                    runs, pieces, _ = encode_runs(path, *clean_and_odd(new))
                    known.update(zip(runs, pieces.tolist(), strict=True))
                values.append(pack(np.fromiter(map(known.__getitem__, own), np.uint32, len(own))))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), pa.array(values, pa.binary())], ["block", "bucket", "value"])

    counted = words.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(count, "block bigint, bucket int, value binary")
    totals = totals_by_document(blocks, counted, lambda pieces: [pieces.astype(np.float64)], ["tokens"])
    n = F.col("tokens").cast("bigint")
    return totals.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
