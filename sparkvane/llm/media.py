"""Media columns: bytes stored as progressive JPEGs, decoded to RGB tensors.

A payload becomes the quantised coefficients of a 4:2:0 file, the format's
lossless unit: byte - 128 per coefficient, 384 bytes an MCU, the rest of the
last MCU zero. Five kinds of scan (DC, two AC bands, both refined by a bit)
carry them. Reading back accumulates the scans into coefficients, which are the
payload, and turns them into a full-resolution RGB tensor.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, read, slices

UNIT, PAD, MCU = 576, 0xFF, 384


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes, filled up with 255 to a positive multiple of UNIT."""
    b = text.encode() if text else b""
    return b + bytes((PAD,)) * (-len(b) % UNIT if b else UNIT)


def store(payloads: list[bytes]) -> list[bytes]:
    """Each payload as a progressive JPEG."""
    import numpy as np

    from .jpeg import encode_blocks

    if not payloads:
        return []
    mcus = [-(-len(p) // MCU) for p in payloads]
    raw = b"".join(p + b"\x80" * (m * MCU - len(p)) for p, m in zip(payloads, mcus))
    return encode_blocks((np.frombuffer(raw, np.uint8).astype(np.int16) - 128).reshape(-1, 6, 64), mcus)


def decode(files: list[bytes]) -> list:
    """(coefficients + 128 as bytes: the units of `store`, RGB tensor) per file; None for
    what is no progressive JPEG."""
    import numpy as np

    from .jpeg import decode_coefficients, tensors

    if not files:
        return []
    try:
        frames, first, coef = decode_coefficients(files)
        rgb = tensors(frames, first, coef)
    except (ValueError, IndexError, KeyError, ArithmeticError, struct.error):  # a broken file
        return [None] if len(files) == 1 else [x for f in files for x in decode([f])]
    raw = (coef + 128).astype(np.uint8).reshape(-1).tobytes()
    return [(raw[64 * a : 64 * b], t) for a, b, t in zip(first[:-1].tolist(), first[1:].tolist(), rgb)]


def feature(rgb) -> str:
    """Size, mean and standard deviation of R, G and B of a tensor."""
    import numpy as np

    flat = rgb.reshape(-1, 3)
    n = len(flat)
    total = flat.sum(axis=0, dtype=np.int64)
    square = np.einsum("pc,pc->c", flat, flat, dtype=np.int64, casting="unsafe")
    sd = np.sqrt(np.maximum(0, square * n - total**2) / (n * n))
    return f"{rgb.shape[1]}x{rgb.shape[0]}:" + ",".join(f"{x:.4f}" for x in (*(total / n), *sd))


def _stored(batches):
    import pyarrow as pa

    for batch in batches:
        for b in slices(batch, 4 << 20):
            texts = b.column("text").to_pylist()
            pay = [payload_of(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([len(p) for p in pay], pa.int64()), pa.array(store(pay), pa.binary())], ["doc_id", "n_bytes", "payload_bytes", "media"])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, media (a JPEG file), one row per input row.
    A null text counts as empty: 576 bytes of 255."""
    d = fold(docs, id_col, text_col)
    return d.mapInArrow(_stored, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, media binary")


def _tensors(batches, media_col: str = "media", units: bool = False):
    """Batches with height, width, rgb and, if asked, the units of each file."""
    import pyarrow as pa

    for batch in batches:
        at = batch.schema.get_field_index(media_col)
        for b in slices(batch, 4 << 20, media_col):
            files = b.column(at).to_pylist()
            some = iter(decode([f for f in files if f]))
            rows = [next(some) if f else None for f in files]
            new = {
                "height": pa.array([r and r[1].shape[0] for r in rows], pa.int32()),
                "width": pa.array([r and r[1].shape[1] for r in rows], pa.int32()),
                "rgb": pa.array([r and r[1].tobytes() for r in rows], pa.binary()),
            }
            if units:
                new["units"] = pa.array([r and r[0] for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, *new.values()], [*b.schema.names, *new])


def decode_tensors(df: DataFrame, media_col: str = "media") -> DataFrame:
    """`df` with height, width and rgb (row-major uint8 tensor) of each file in place of
    same-named columns; null where the file is null or no progressive JPEG."""
    from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

    keep = df.drop("height", "width", "rgb")
    schema = StructType([*keep.schema.fields, StructField("height", IntegerType()), StructField("width", IntegerType()), StructField("rgb", BinaryType())])
    return keep.mapInArrow(lambda batches: _tensors(batches, media_col), schema)


def _digest(batches):
    """Digests of stored files and of the tensors that were read back from them."""
    import numpy as np
    import pyarrow as pa

    sha = lambda x: hashlib.sha256(x).hexdigest()
    for b in batches:
        media, units, rgb, high, wide, sizes = (b.column(c).to_pylist() for c in ("media", "units", "rgb", "height", "width", "payload_bytes"))
        payloads = [u[:n] for u, n in zip(units, sizes)]
        features = [feature(np.frombuffer(x, np.uint8).reshape(h, w, 3)) for x, h, w in zip(rgb, high, wide)]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("n_bytes"), b.column("payload_bytes"), pa.array(map(sha, payloads), pa.string()), pa.array([zlib.crc32(p[-32:]) for p in payloads], pa.int64()), pa.array(map(len, media), pa.int64()), pa.array(map(sha, media), pa.string()), pa.array(features, pa.string())],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as a file, decodes the file to its tensor and digests both; one row
    per input row. The three steps, those of store_texts and decode_tensors, run one after
    the other in one worker, as files and tensors are several times the size of the texts.
    Null counts as empty; equal texts get equal values; a long text spans several MCU rows;
    an empty table gives an empty result; other columns are ignored."""
    d = fold(docs, id_col, text_col)
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(lambda batches: _digest(_tensors(_stored(batches), units=True)), f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7_media(spark, sf_dir: str) -> DataFrame:
    return media_digest(read(spark, sf_dir, "documents"))
