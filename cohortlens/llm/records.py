"""Token sequences as length-delimited binary records, with an offset index for shuffled reads.

One file is a run of records: length of the payload (8 bytes), masked CRC-32 of those bytes
(4), payload, masked CRC-32 of the payload (4); all little-endian. The payload is the
document's id (8), 1 if it has one (1), bytes per token id (1) and the token ids. Beside each
file ``part-00000.rec`` lies ``part-00000.idx``: the byte offset of every record (8 each).
Files follow each other in ascending id order.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cohortlens.llm.common import ship
from cohortlens.llm.tokens import encoder

MASK = 0xA282EAD8  # added to the rotated checksum, so a checksum of checksums is no special case
HEAD, FOOT, DOC = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<qBB")
FRAME_BYTES = HEAD.size + FOOT.size  # around each payload

MANIFEST = "part int, n_docs long, n_ids long, n_bytes long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + FOOT.pack(masked(head)) + payload + FOOT.pack(masked(payload))


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that holds ``path`` (a URI, or a local path) and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _read(f) -> bytes | None:
    """The payload of the record at the file's position, checked; None at the end."""
    head = f.read(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size:
        raise ValueError("a record's head is cut off")
    length, check = HEAD.unpack(head)
    if check != masked(head[:8]):
        raise ValueError("a record's length fails its checksum")
    payload, foot = f.read(length), f.read(FOOT.size)
    if len(payload) < length or len(foot) < FOOT.size or FOOT.unpack(foot)[0] != masked(payload):
        raise ValueError("a record fails its checksum")
    return payload


def record(doc: int | None, ids: bytes, width: int) -> bytes:
    """The framed record of a document; ``ids`` are little-endian numbers of ``width`` bytes."""
    return frame(DOC.pack(0 if doc is None else doc, doc is not None, width) + ids)


def _document(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc, has, width = DOC.unpack_from(payload)
    return (doc if has else None), np.frombuffer(payload, dtype=f"<u{width}", offset=DOC.size)


def _table(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame([r[1:] for r in rows], columns=["start", "n_tokens", "ids_crc32"])
    return out.assign(doc_id=pd.array([r[0] for r in rows], dtype="Int64"))


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id",
                  text_col: str = "text", files: int | None = None) -> DataFrame:
    """Encode every whole text, append ``end_id``, and write the records in ascending id order.

    Texts are range-sorted by id and encoded where they are written, so token ids are never
    shuffled. Each task writes its file under a name of its own attempt and then renames it:
    a repeated or speculative task replaces a file by the same bytes. NULL texts are empty,
    NULL ids come first, repeated rows give repeated records. Returns the manifest, saved as
    Parquet under ``path``: part, n_docs, n_ids, n_bytes, one row a file.
    """
    spark = docs.sparkSession
    ship(spark)
    where = path.rstrip("/")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        files, root = store(where)
        name = f"{root}/part-{part:06d}"
        own = f"{root}/_attempt-{part:06d}-{uuid.uuid4().hex}"
        offsets, n_ids, at, out = [], 0, 0, None
        for pdf in batches:
            if out is None and len(pdf):
                files.create_dir(root, recursive=True)
                out = files.open_output_stream(f"{own}.rec", buffer_size=1 << 20)
            for doc, none, text in zip(pdf["id"].tolist(), pdf["none"], pdf["text"]):
                ids = enc.encode(text) + end
                data = record(None if none else doc, ids, enc.dtype.itemsize)
                out.write(data)
                offsets.append(at)
                at, n_ids = at + len(data), n_ids + len(ids) // enc.dtype.itemsize
        if out is not None:
            out.close()
            with files.open_output_stream(f"{own}.idx") as index:
                index.write(np.array(offsets, dtype="<u8").tobytes())
            files.move(f"{own}.idx", f"{name}.idx")
            files.move(f"{own}.rec", f"{name}.rec")
            yield pd.DataFrame({"part": [part], "n_docs": [len(offsets)], "n_ids": [n_ids], "n_bytes": [at]})

    doc = F.col(id_col).cast("long")  # NULLs go beside: pandas would make the ids floats
    rows = docs.select(doc.isNotNull().alias("some"), F.coalesce(doc, F.lit(0)).alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(files, "some", "id") if files else rows.repartitionByRange("some", "id")
    rows = rows.sortWithinPartitions("some", "id").select("id", (~F.col("some")).alias("none"), "text")
    rows.mapInPandas(run, MANIFEST).write.parquet(f"{where}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{where}/manifest")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, from the files: every length and
    checksum is verified, and the index must name the same offsets. ``start`` is the number
    of ids of all documents before; ids_crc32 is over them as little-endian 32-bit numbers."""
    where = path.rstrip("/")
    manifest = spark.read.schema(MANIFEST).parquet(f"{where}/manifest")
    before = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    parts = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = store(where)
        for pdf in batches:
            for part, n_docs, base in zip(pdf["part"], pdf["n_docs"], pdf["base"]):
                with files.open_input_stream(f"{root}/part-{part:06d}.idx") as f:
                    offsets = np.frombuffer(f.read(), dtype="<u8")
                out, at, start, seen = [], 0, int(base), 0
                with files.open_input_stream(f"{root}/part-{part:06d}.rec", buffer_size=1 << 20) as f:
                    while (payload := _read(f)) is not None:
                        if seen >= len(offsets) or offsets[seen] != at:
                            raise ValueError(f"part {part}: the index does not match the file")
                        doc, ids = _document(payload)
                        out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at, start, seen = at + len(payload) + FRAME_BYTES, start + len(ids), seen + 1
                        if len(out) >= 10_000:
                            yield _table(out)
                            out = []
                if seen != n_docs:
                    raise ValueError(f"part {part}: {seen} records, the manifest says {n_docs}")
                yield _table(out)

    return (parts.repartition(max(1, manifest.count())).mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def shuffled_records(spark: SparkSession, path: str, seed: int = 0) -> DataFrame:
    """(doc_id, ids) of all records in a random order: the offsets of the indexes are
    shuffled, and each task seeks to its records."""
    where = path.rstrip("/")
    ship(spark)

    def offsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = store(where)
        for pdf in batches:
            for part in pdf["part"]:
                with files.open_input_stream(f"{root}/part-{part:06d}.idx") as f:
                    yield pd.DataFrame({"part": part, "at": np.frombuffer(f.read(), dtype="<u8").astype(np.int64)})

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = store(where)
        for pdf in batches:
            got: dict[int, tuple] = {}
            for part, rows in pdf.groupby("part"):
                with files.open_input_file(f"{root}/part-{part:06d}.rec") as f:
                    for k, at in zip(rows.index, rows["at"]):
                        f.seek(at)
                        got[k] = _document(_read(f))
            yield pd.DataFrame({"doc_id": pd.array([got[k][0] for k in pdf.index], dtype="Int64"),
                                "ids": [got[k][1].astype(np.int64) for k in pdf.index]})

    parts = spark.read.schema(MANIFEST).parquet(f"{where}/manifest").select("part")
    index = parts.mapInPandas(offsets, "part int, at long")
    mixed = index.orderBy(F.xxhash64(F.lit(seed), "part", "at"), "part", "at")
    return mixed.mapInPandas(fetch, "doc_id long, ids array<long>")
