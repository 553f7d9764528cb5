"""Token-id output: length-delimited binary records with masked checksums and a separate offset index.

A shard is a pair of files. ``shard-N.bin`` holds records one behind another::

    length of the payload, 8 bytes | masked crc32 of these 8 bytes, 4 bytes
    payload                        | masked crc32 of the payload, 4 bytes

The payload is the document id (signed, 8 bytes), the width of an id (2 or 4, one byte; with 128 added, the
document has no id, and 0 stands for it) and then the token ids, in 2 bytes each where all of the document's are below 65536, else in 4; all is little-endian. The mask is that of record files in common use: the crc rotated right by 15 bits plus
a constant, so that a crc of data that holds crcs is no trivial value. ``shard-N.idx`` has 8 bytes
for each record, its offset in the other file, so that a reader may visit records in any order.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm import common, tokens

#: Added to the rotated checksum. Fixed value of the record format.
MASK_DELTA = 0xA282EAD8
#: Added to the width where a document has no id.
NO_ID = 128
MANIFEST = "shard int, path string, first_id long, n_docs long, n_tokens long, n_bytes long"


def masked(data: bytes) -> int:
    """The masked checksum of some bytes."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def record(doc_id: int | None, ids: bytes) -> bytes:
    """One framed record of ids that are given as 4 bytes each."""
    values = np.frombuffer(ids, "<u4")
    width = 2 if len(values) == 0 or values.max() < 1 << 16 else 4
    payload = (doc_id or 0).to_bytes(8, "little", signed=True) + bytes([width + NO_ID * (doc_id is None)]) + values.astype(f"<u{width}").tobytes()
    length = len(payload).to_bytes(8, "little")
    return length + masked(length).to_bytes(4, "little") + payload + masked(payload).to_bytes(4, "little")


def unframe(stream, offset: int) -> tuple[int | None, bytes]:
    """(document id, ids as 4 bytes each) of the record at an offset; ValueError where a checksum is wrong."""
    stream.seek(offset)
    head = stream.read(12)
    if masked(head[:8]) != int.from_bytes(head[8:], "little"):
        raise ValueError(f"the length at {offset} is damaged")
    n = int.from_bytes(head[:8], "little")
    body = stream.read(n + 4)
    if len(body) != n + 4 or masked(body[:n]) != int.from_bytes(body[n:], "little"):
        raise ValueError(f"the record at {offset} is damaged")
    ids = np.frombuffer(body[9:n], f"<u{body[8] % NO_ID}").astype("<u4").tobytes()
    return None if body[8] >= NO_ID else int.from_bytes(body[:8], "little", signed=True), ids


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def write_shards(docs: DataFrame, path: str, vocabulary: str) -> DataFrame:
    """Write the documents' ids, with the end id, in ascending doc_id order; returns the manifest.

    One shard for each range of ids. A task writes under a name of its own and renames when all is
    written, so a lost or repeated task leaves no half of a shard behind. Null texts are empty; rows
    without a doc_id come first; rows of equal doc_id follow in
    order of their text. An empty table gives an empty manifest. Other columns are ignored.
    """
    spark = docs.sparkSession
    common.prepare(spark)

    def write(batches):
        where, base = _store(path)
        where.create_dir(base, recursive=True)
        shard, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        names = [f"{base}/shard-{shard:06d}.{kind}" for kind in ("bin", "idx")]
        temporary = [f"{base}/.{attempt}.{kind}" for kind in ("bin", "idx")]
        first, docs_in, ids_in, at = None, 0, 0, 0
        data = index = None
        for batch in batches:
            if data is None and batch.num_rows:
                data, index = map(where.open_output_stream, temporary)
            keys = tokens.column(batch, "doc_id")
            offsets = []
            for doc_id, ids in zip(keys, tokens.with_end(batch.column("text"), vocabulary), strict=True):
                first = doc_id if first is None else first
                framed = record(doc_id, ids)
                data.write(framed)
                offsets.append(at)
                at, docs_in, ids_in = at + len(framed), docs_in + 1, ids_in + len(ids) // 4
            if offsets:
                index.write(np.array(offsets, "<u8").tobytes())
        if data is not None:
            data.close()
            index.close()
            for old, new in zip(temporary, names, strict=True):
                where.move(old, new)
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"{path}/shard-{shard:06d}", "first_id": first, "n_docs": docs_in, "n_tokens": ids_in, "n_bytes": at}], pa.schema([("shard", pa.int32()), ("path", pa.string()), *[(k, pa.int64()) for k in ("first_id", "n_docs", "n_tokens", "n_bytes")]]))

    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(common.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return common.saved(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each record, by way of the index; start counts ids of all records before it."""
    spark = manifest.sparkSession

    def load(batches):
        for batch in batches:
            for path, before in zip(tokens.column(batch, "path"), tokens.column(batch, "before"), strict=True):
                where, base = _store(path)
                with where.open_input_stream(f"{base}.idx") as f:
                    offsets = np.frombuffer(f.read(), "<u8")
                rows = []
                with where.open_input_file(f"{base}.bin") as f:
                    for offset in offsets:
                        doc_id, ids = unframe(f, int(offset))
                        rows.append((doc_id, before, len(ids) // 4, zlib.crc32(ids)))
                        before += len(ids) // 4
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row for each shard: a few thousand of them for terabytes
    order = Window.orderBy("first_id", "shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    spread = placed.select("path", "before").repartition(common.partitions(spark), "path")
    return spread.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_binary_output(spark, sf_dir: str) -> DataFrame:
    """All documents written as records and read back: doc_id, start, n_tokens, ids_crc32."""
    path = common.new_dir(spark, "tokens")
    return read_shards(write_shards(common.read(spark, sf_dir, "documents"), path, tokens.vocabulary_path()))
