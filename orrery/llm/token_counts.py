"""Token counts of whole texts by a public tokenizer, lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_batches, text_of
from .pieces import piece_memory, spaced_pieces

DEFAULT_TOKENIZER = "byte_bpe_50k.json"


def count_tokens(
    docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Bytes and tokens of every whole text, and whether it has more than ``limit`` tokens.

    ``tokenizer`` is the path of a byte-level BPE file for the tokenizers library; special strings inside texts
    are handled as that library does by default, and nothing is added, cut or padded. A null or empty text has 0
    bytes and 0 tokens; repeated rows and null ids are kept as they are; extra columns are ignored; an empty table
    gives no rows. Texts go through in batches balanced by bytes, cut at boundaries that no token crosses.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = piece_memory(tokenizer, False)
        for rows, data, offsets in text_batches(batches):
            starts, ends, first = spaced_pieces(data, offsets)
            size, _ = memory.look_up(data, starts, ends)
            sums = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            tokens = sums[first[1:]] - sums[first[:-1]]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
