"""Statistics files of table formats (the public Puffin layout): blobs, then a JSON footer.

Reading is by Spark's binaryFile source, so files anywhere a cluster can read will do; a
row is a blob. Theta blobs open with Spark's own theta functions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"PFA1"
THETA = "apache-datasketches-theta-v1"
#: property of a theta blob: its distinct values as counted (the public `ndv` is the sketch's estimate)
COUNTED = "ndv-counted"
SCHEMA = "path string, type string, fields array<int>, snapshot_id long, sequence_number long, properties map<string,string>, blob binary"


def compose(blobs: list[dict], properties: dict[str, str] | None = None) -> bytes:
    """File of blobs: dicts of type, fields, snapshot_id, sequence_number, properties, blob."""
    out, notes = bytearray(MAGIC), []
    for b in blobs:
        note = {"type": b["type"], "fields": list(b.get("fields", [])), "snapshot-id": b.get("snapshot_id", -1), "sequence-number": b.get("sequence_number", -1), "offset": len(out), "length": len(b["blob"])}
        if b.get("properties"):
            note["properties"] = dict(b["properties"])
        notes.append(note)
        out += b["blob"]
    text = json.dumps({"blobs": notes, "properties": properties or {}}).encode()
    return bytes(out) + MAGIC + text + len(text).to_bytes(4, "little") + bytes(4) + MAGIC


def parse(data: bytes) -> list[dict]:
    """The blobs of a file; ValueError for what is none, or is compressed."""
    if len(data) < 20 or data[:4] != MAGIC or data[-4:] != MAGIC:
        raise ValueError("no statistics file")
    if data[-8] & 1:
        raise ValueError("compressed footer")
    size = int.from_bytes(data[-12:-8], "little")
    begin = len(data) - 12 - size
    if begin < 8 or data[begin - 4 : begin] != MAGIC:
        raise ValueError("broken footer")
    out = []
    for n in json.loads(data[begin : begin + size])["blobs"]:
        if n.get("compression-codec"):
            raise ValueError(f"blob is compressed by {n['compression-codec']}")
        a, b = n["offset"], n["offset"] + n["length"]
        if not 4 <= a <= b <= begin - 4:
            raise ValueError("a blob lies outside")
        out.append({"type": n["type"], "fields": n["fields"], "snapshot_id": n["snapshot-id"], "sequence_number": n["sequence-number"], "properties": n.get("properties", {}), "blob": data[a:b]})
    return out


def read_puffin(spark: SparkSession, path: str) -> DataFrame:
    """(path, type, fields, snapshot_id, sequence_number, properties, blob), a row per blob."""

    def run(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
        names = ["path", "type", "fields", "snapshot_id", "sequence_number", "properties", "blob"]
        for b in batches:
            rows = [(p, *(list(x.items()) if isinstance(x, dict) else x for x in r.values())) for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist()) for r in parse(c)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def write_puffin(states: DataFrame, path: str, kind: str = THETA) -> int:
    """One file of the rows of `states`: fields, snapshot_id, sequence_number, properties, blob.

    A statistics file holds a sketch a column, so its rows are few; over a thousand are
    refused. Returns the number of blobs."""
    rows = states.select("fields", "snapshot_id", "sequence_number", "properties", "blob").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("over a thousand blobs in one statistics file")
    data = compose([{**r.asDict(), "type": kind, "blob": bytes(r.blob)} for r in rows])
    jvm = states.sparkSession.sparkContext._jvm
    conf = states.sparkSession.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(conf).create(target, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    return len(rows)


def distinct_values() -> Column:
    """Distinct values that a theta blob as read stands for: as counted where its file says so,
    else the sketch's estimate."""
    return F.coalesce(F.element_at("properties", COUNTED).try_cast("long"), F.theta_sketch_estimate("blob"))
