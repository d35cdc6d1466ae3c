"""Token counts of whole texts by rank-synchronous merging of byte-level BPE (see ``bpe``).

Rows stay in their partition: no shuffle, and a lost task repeats its own rows only.  A worker's
memory is bounded by a block of about 1 MB of text and by the pre-tokens it remembers.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm import bpe
from memspark.llm.common import slices, text_or_empty


def token_counts(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` of every row.

    ``vocabulary`` is the path of a tokenizer file every executor can read.  A special string inside
    a text is one token, as in the tokenizer's default; nothing is added or cut.  A null or empty
    text has 0 bytes and 0 tokens; a null key stays null; repeated rows give repeated results;
    other columns are ignored.
    """

    def count(batches):
        encoder = bpe.encoder(vocabulary)
        for batch in slices(batches, "text"):
            n = encoder.counts(batch.column("text").to_pylist())
            bytes_ = pa.compute.binary_length(batch.column("text").cast(pa.binary())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), bytes_, pa.array(n), pa.array(np.asarray(n > limit))], ["key", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(count, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)
