"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.sources.written import discard, materialize, shared_dir

__all__ = ["discard", "held_out", "materialize", "packed", "shared_dir", "sized", "slices", "unpacked", "utf8_column", "without_rows"]

#: A relation may be broadcast only after its size was measured to be under this.
BROADCAST_BYTES = 16 << 20


def sized(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` (written before), marked for broadcast if its counted rows fit the bound."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def packed(docs: DataFrame) -> DataFrame:
    """``all`` (a struct of all columns of ``docs``), ``id`` (doc_id), ``row`` (hash of the text): no name can clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("all"), F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("row"))


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*(F.col("all")[c].alias(c) for c in columns))


def without_rows(docs: DataFrame, gone: DataFrame, row_bytes: int = 32) -> DataFrame:
    """``docs`` less the rows whose doc_id and hash of the text are in ``gone`` (id, row; written before)."""
    gone = sized(gone.select(F.col("id").alias("gone_id"), F.col("row").alias("gone_row")), row_bytes)
    rows = packed(docs).join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("row") == F.col("gone_row")), "left_anti")
    return unpacked(rows, docs.columns)


def held_out(doc_id: Column) -> Column:
    """True for the third of the rows (crc32 of the id as text, mod 3 = 1) that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def utf8_column(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings and the n+1 offsets into them; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    if col.null_count:
        col = col.fill_null(b"")
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about ``most`` bytes together (one row at least)."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end
