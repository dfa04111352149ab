"""Media columns: JPEG bytes as a column, with dimensions and thumbnail hashes beside them."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm import jpeg
from spanforge.llm.common import slices, utf8_column

STEP_BYTES = 1 << 20
DIGEST = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def image_columns(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with width, height, thumbnail (DC-only luminance samples, row by row) and thumb_hash of a JPEG column.

    A null, broken or non-baseline file gives nulls. Columns of these names are replaced.
    """
    made = {"width": pa.int32(), "height": pa.int32(), "thumbnail": pa.binary(), "thumb_hash": pa.string()}
    base = df.drop(*made)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in base.schema.fields)}{', ' if base.columns else ''}width int, height int, thumbnail binary, thumb_hash string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col, sizes = batch.column(batch.schema.get_field_index(media)), []
            for v in col:
                sizes.append(len(v.as_py() or b""))
            for a, b in slices(np.concatenate([[0], np.cumsum(sizes)]), STEP_BYTES):
                read = jpeg.decode([v.as_py() or b"" for v in col[a:b]])
                rows = [(None,) * 4 if x is None else (x[0].width, x[0].height, (t := jpeg.thumbnail(*x)).tobytes(), jpeg.average_hash(t)) for x in read]
                arrays = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(made.values())]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), *arrays], [*batch.schema.names, *made])

    return base.mapInArrow(run, schema)


def padded(text: bytes) -> bytes:
    """With bytes 0 up to a positive multiple of 64."""
    return text + bytes(-len(text) % jpeg.UNIT or (0 if text else jpeg.UNIT))


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the JPEG (``media``) that holds each row's whole text; a null text is empty.

    A text of more than ``jpeg.MOST_BYTES`` is several JPEG files, one after another.
    Repeated rows give repeated results; an empty table gives none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, files in encoded(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def stored(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload: a JPEG, or several one after another where it is longer than one holds."""
    pieces = [(i, p[k : k + jpeg.MOST_BYTES]) for i, p in enumerate(payloads) for k in range(0, len(p), jpeg.MOST_BYTES)]
    out: list[list[bytes]] = [[] for _ in payloads]
    for a, b in slices(np.cumsum([0, *(len(p) for _, p in pieces)]), STEP_BYTES):
        for (i, _), file in zip(pieces[a:b], jpeg.encode_all([np.frombuffer(p, np.uint8) for _, p in pieces[a:b]])):
            out[i].append(file)
    return [f[0] if len(f) == 1 else b"".join(f) for f in out]


def read_back(files: list[bytes]) -> list[tuple[bytes, str]]:
    """Payload and feature (dimensions and thumbnail hash of each image) of each stored form."""
    pieces = [(i, image) for i, f in enumerate(files) for image in jpeg.images(f)]
    out: list[tuple[list, list]] = [([], []) for _ in files]
    for a, b in slices(np.cumsum([0, *(len(p) for _, p in pieces)]), STEP_BYTES):
        for (i, _), (h, dc) in zip(pieces[a:b], jpeg.decode([p for _, p in pieces[a:b]]), strict=True):
            out[i][0].append(jpeg.payload(h, dc))
            out[i][1].append(f"{h.width}x{h.height}:{jpeg.average_hash(jpeg.thumbnail(h, dc))}")
    return [(b"".join(payload), ",".join(feature)) for payload, feature in out]


def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, list[bytes]]]:
    """Ids, text sizes and stored forms of a few rows at a time."""
    for batch in batches:
        data, offsets = utf8_column(batch.column(1))
        for a, b in slices(offsets, STEP_BYTES):
            yield batch.column(0).slice(a, b - a), np.diff(offsets[a : b + 1]), stored([padded(data[offsets[i] : offsets[i + 1]].tobytes()) for i in range(a, b)])


def digests(docs: DataFrame) -> DataFrame:
    """Digests of ``text_media``, of what is read back from the stored bytes; equal texts give equal values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, files in encoded(batches):
            cols: list[list] = [[] for _ in range(6)]
            for data, (back, feature) in zip(files, read_back(files), strict=True):
                row = (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-jpeg.UNIT :]), len(data), hashlib.sha256(data).hexdigest(), feature)
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), *(pa.array(c, k) for c, k in zip(cols, kinds))], [x.split()[0] for x in DIGEST.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")).mapInArrow(run, DIGEST)
