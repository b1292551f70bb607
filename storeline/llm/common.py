"""Helpers shared by the text operators.

Text reaches Python as UTF-8 bytes (Arrow binary), so tasks never depend on how a worker decodes strings, and every
operator works on whole texts. Input columns are renamed to reserved names first, so extra columns of any name (clashing
ones included) can neither be picked up by mistake nor be lost: operators that return documents join back on the input's
own columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, body): the id as long and the whole text as UTF-8 bytes; null text stays null."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("body"))


def keyed_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, body). A row is known by its id and a hash of its text, so rows that repeat an id with other
    texts stay apart, and rows that are equal in both share every decision."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"),
                       F.col(text_col).cast("binary").alias("body"))


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the bytes of ``column`` in each piece stay near ``max_bytes`` (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        total = np.cumsum(size, dtype=np.int64)
        start = 0
        while start < n:
            base = int(total[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(total, base + max_bytes, side="right")))
            yield batch.slice(start, end - start)
            start = end


def xor_fold(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a finaliser with full avalanche), so that any bits of them can be used as a hash."""
    z = values.copy()
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z
