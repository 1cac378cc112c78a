"""BPE encoding and decoding (2): texts to token ids and back.

The merges are those of ``byte_pairs``: a segment tree over the ranks of adjacent pairs. Rows stay where they are:
no shuffle, and a worker holds one bounded batch at a time.

Defined results: a null or empty text has no ids; ids that are null decode to an empty text; repeated rows are each
answered; ids that are null or unknown read as nothing; an empty table gives an empty table. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tallyhouse.llm.byte_pairs import load
from tallyhouse.llm.tasks import bounded, ship, texts

#: Text that is encoded at once, and rows that are decoded at once.
BATCH_BYTES, ROWS = 4 << 20, 500


def encode(docs: DataFrame, vocabulary: str, decoded: bool = False) -> DataFrame:
    """``doc_id`` and ``ids``, the token ids of the whole text; on request also ``decoded``, the text of the ids."""
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = load(vocabulary)
        for batch in bounded(batches, "text", BATCH_BYTES):
            ids, counts = pairs.encode_flat(texts(batch))
            lists = pa.ListArray.from_arrays(np.cumsum(np.r_[0, counts], dtype=np.int32), pa.array(ids.view(np.int32)))
            columns = {"doc_id": batch.column("doc_id"), "ids": lists}
            if decoded:
                columns["decoded"] = pa.array(pairs.decode_flat(ids, counts), pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, ids array<int>" + ", decoded string" * decoded
    )


def decode(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded``, the text of the ids."""
    ship(tokens.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = load(vocabulary)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                lists = batch.column("ids")
                ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                decoded = pa.array(pairs.decode_flat(ids, counts), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, decoded], ["doc_id", "ids", "decoded"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")
