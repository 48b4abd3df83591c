"""Token counts by a whole-token shortcut.

Which vocabulary strings encode alone as one token is proved once, from the
tokenizer file.  A text is cut into pre-tokens; those that are such strings
count one token without any merge, and only the others are merged, each
distinct one once per group of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytebpe

LIMIT = 512


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """Count the tokens of every text as the library gives them for a byte-level BPE file.

    Without begin, end or other added tokens, truncation or padding; special
    strings inside a text are single tokens, the library's default.  Returns
    doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit``).

    Defined cases: a null text counts as empty and has no tokens; rows with
    null or repeated doc_id are rows like any other; texts with special
    strings or with characters outside the proved blocks are encoded by the
    library as a whole; an empty table gives an empty result.  Other columns
    of ``docs`` are ignored.
    """
    proved = bytebpe.proof(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bytebpe.Encoder(tokenizer, *proved)
        for batch in batches:
            n = [len(ids) // 4 for group in bytebpe.text_groups(batch["text"]) for ids in encoder.group(group)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])
        # The worker lives on for other stages.
        pa.default_memory_pool().release_unused()

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", size.alias("n_bytes"))
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
