"""Token ids and token counts of whole texts, in Arrow batches.

Defined results: null and empty texts have the empty list (count 0), never a
null; texts are encoded whole, special tokens' strings as ordinary text; extra
columns are left out but for the id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
AT_ONCE = 1000  # texts encoded at once


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for lo in range(0, batch.num_rows, AT_ONCE):
        yield batch.slice(lo, AT_ONCE)


def token_ids(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, ids) of each text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        for whole in batches:
            for b in _slices(whole):
                ids = bpe.encode_batch(b.column(1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                flat = np.fromiter((t for i in ids for t in i), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(encode, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, tokens) of each text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        for whole in batches:
            for b in _slices(whole):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bpe.count_batch(b.column(1).to_pylist()), pa.int64())], names=[key, "tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(count, f"`{key}` {kind}, tokens bigint")


def corpus_tokens(ids: DataFrame) -> DataFrame:
    """How often each token id occurs."""
    return ids.select(F.explode("ids").alias("token_id")).groupBy("token_id").agg(F.count("*").alias("n"))
