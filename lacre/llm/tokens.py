"""Encode a corpus with a public tokenizer, exactly, in one pass over the texts and without a shuffle.

Defined results: null and empty texts have the empty list of ids (0 tokens); blank texts are encoded as they are; texts
of any length are encoded whole; strings of special tokens are ordinary text; repeated rows stay; extra columns are
ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame

from lacre.llm.bpe import PrefixEncoder

#: Where the public vocabularies lie; never part of this repository.
VOCABULARIES = os.environ.get("LACRE_TOKENIZERS", "/opt/tokenizers")


def vocabulary(name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> bytes:
    """A rank file; it has a fixed size of under a megabyte and goes to executors as a broadcast variable."""
    return Path(folder, f"{name}.tiktoken").read_bytes()


def encode(documents: DataFrame, ranks: bytes) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, ids)."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(ranks)

    def ids(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa


        encoder = PrefixEncoder(shared.value)
        for batch in batches:
            rows = [encoder.encode(t) if t else [] for t in batch.column("text").to_pylist()]
            offsets = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r) for r in rows], out=offsets[1:])
            flat = np.fromiter((i for r in rows for i in r), np.int32, offsets[-1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(ids, f"doc_id {kind}, ids array<int>")


def count(documents: DataFrame, ranks: bytes) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, n_tokens)."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(ranks)

    def sizes(batches: Iterator) -> Iterator:
        import pyarrow as pa


        encoder = PrefixEncoder(shared.value)
        for batch in batches:
            n = [encoder.count(t) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(sizes, f"doc_id {kind}, n_tokens long")
