"""Operator 1, token counts: the whole-token shortcut.

Offline, on the driver, each string of the vocabulary is put through the tokenizer alone; those that come
back as one token are proved whole. A count then needs no merging for a piece that is a whole token; only
the other pieces are merged, and a table of fixed size keeps recent ones.

Null texts count as empty (0 tokens), every input row gives one row, repeated rows give repeated rows, and
only the id and text columns are read, so further columns may have any name. Memory: a chunk of texts
(CHUNK_BYTES, or one longer text) and the table. There is no shuffle; a lost executor repeats its
tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, small_batches, table, whole_text
from .vocabulary import Encoder, Vocabulary, chunks

TOKEN_LIMIT = 512


def count_tokens(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", limit: int = TOKEN_LIMIT) -> DataFrame:
    """Per row: the id, n_bytes (UTF-8), n_tokens, over_limit (more than limit tokens) and n_whole, the pieces that
    are one token: all of these are proved whole and need no merging."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(tokenizer_path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder.of(shared.value)
            found_tokens, found_whole = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, texts in chunks(batch.column(1)):
                tokens, whole, _ = encoder.encode(texts, want_ids=False)
                found_tokens.append(tokens)
                found_whole.append(whole)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found_tokens)), pa.array(np.concatenate(found_whole))], ["id", "n_tokens", "n_whole"])
        release()

    rows = docs.select(F.col(id_column).alias("id"), whole_text(text_column).alias("text"))
    # the byte length comes from the counter's own reading of the text, so that the text is read once
    sized = rows.select(F.struct("id", F.octet_length("text").cast("long").alias("n_bytes")).alias("id"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    out = sized.mapInArrow(count, f"id struct<id:{kind},n_bytes:bigint>, n_tokens bigint, n_whole bigint")
    return out.select(F.col("id.id").alias(id_column), F.col("id.n_bytes").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_whole")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: tokens of every whole text of documents in the 50k byte-level vocabulary."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
