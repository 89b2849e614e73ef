"""Token ids as Parquet list columns that allow selective reads.

Documents are dealt by ranges of their ids, sorted, encoded and written by each task into one file:
ids as a dictionary-encoded list column, ids of documents, starts and counts delta-encoded, row
groups of about GROUP tokens, data pages of PAGE bytes, with a page index. A file's name has its
place in the order, and it appears whole under that name or not at all, so a task that runs again
writes the same file. Readers take single columns (metadata without tokens) or the pages that a
range of ids needs: a filter on doc_id reaches the scan, which skips files and row groups by their
statistics and pages by the page index.

Nulls and empty texts hold the end id alone, an empty table has no files. A null doc_id sorts first;
rows that share a doc_id are ordered by a hash of their text, by which they also spread over the
files. A very long text is a slice of its own. Only the key and the text of a table are read, so
further columns may have any name.
"""

from __future__ import annotations

import posixpath
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, input_parts, pieces, qualified, scratch_path
from .pretokens import load

GROUP, PAGE = 1 << 20, 1 << 16
SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


@dataclass(frozen=True)
class Store:
    """Files in order: (place, path, documents, tokens of the files before it)."""

    files: list[tuple[int, str, int, int]]


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """Of a qualified path; Spark writes local ones with a single slash."""
    return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def _writer(model_path: str, folder: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        fs, top = _file_system(folder)
        name = f"{top}/tokens-{place:06d}.parquet"
        draft = f"{name}.{TaskContext.get().taskAttemptId()}"
        model, writer, held, waiting, total, docs = load(model_path), None, [], 0, 0, 0

        def flush() -> None:
            nonlocal writer, held, waiting
            if writer is None:
                fs.create_dir(top, recursive=True)
                writer = pq.ParquetWriter(draft, SCHEMA, filesystem=fs, compression="zstd", compression_level=1, use_dictionary=["ids.list.element"], column_encoding={c: "DELTA_BINARY_PACKED" for c in ("doc_id", "start", "n_tokens")}, data_page_size=PAGE, write_page_index=True, store_schema=False)
            writer.write_table(pa.Table.from_batches(held, SCHEMA), row_group_size=1 << 30)
            held, waiting = [], 0

        for batch in batches:
            for part in pieces(batch, "text"):
                ids, off = model.encode(part.column("text"))
                ids = np.insert(ids, off[1:], end_id)
                off = off + np.arange(len(off))
                count = np.diff(off)
                lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))
                held.append(pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(total + off[:-1]), pa.array(count), lists], schema=SCHEMA))
                total, docs, waiting = total + len(ids), docs + len(count), waiting + len(ids)
                if waiting >= GROUP:
                    flush()
        if held:
            flush()
        if writer is not None:
            writer.close()
            fs.move(draft, name)
            yield pa.RecordBatch.from_pydict({"place": [place], "path": [posixpath.join(folder, posixpath.basename(name))], "docs": [docs], "tokens": [total]}, pa.schema([("place", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    return run


def write(docs: DataFrame, model_path: str, folder: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> Store:
    """Write the ids of every whole text, each with an end id, in ascending order of the key."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = qualified(spark, folder)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = input_parts(rows, least=8)
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text").asc()]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = dealt.mapInArrow(_writer(model_path, folder, end_id), "place int, path string, docs long, tokens long").collect()  # a row for each file
    files, before = [], 0
    for r in sorted(found):
        files.append((r.place, r.path, r.docs, before))
        before += r.tokens
    return Store(files)


TYPES = {"doc_id": "long", "start": "long", "n_tokens": "long", "ids": "array<int>"}


def _files(spark: SparkSession, store: Store) -> DataFrame:
    rows = spark.createDataFrame([(p, b) for _, p, _, b in store.files], "path string, before long")
    return rows.repartition(max(1, len(store.files)))


def read(spark: SparkSession, store: Store, columns: list[str] | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """The chosen columns of documents with low <= doc_id <= high; pages outside are not read."""
    columns = columns or list(TYPES)
    rows = spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in TYPES.items()))
    if store.files:
        rows = spark.read.schema(rows.schema).parquet(*(p for _, p, _, _ in store.files))
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.where(F.col("doc_id") <= high)
    if "start" in columns and store.files:
        before = spark.createDataFrame([(posixpath.basename(p), b) for _, p, _, b in store.files], "_file string, _before long")  # a row for each file
        rows = rows.withColumn("_file", F.col("_metadata.file_name")).join(F.broadcast(before), "_file").withColumn("start", F.col("start") + F.col("_before"))
    return rows.select(*columns)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of whole files, group by group."""
    for batch in batches:
        for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
            fs, name = _file_system(path)
            with fs.open_input_file(name) as f:
                file = pq.ParquetFile(f)
                for g in range(file.num_row_groups):
                    for b in file.read_row_group(g, columns=list(TYPES)).to_batches():
                        yield b.set_column(1, "start", pa.compute.add(b.column(1), before))


def _checks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _batches(batches):
        lists = b.column(3)
        off = np.asarray(lists.offsets)
        values = memoryview(np.ascontiguousarray(np.asarray(lists.values), "<u4").view(np.uint8))
        crc = [zlib.crc32(values[4 * i : 4 * j]) for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(spark: SparkSession, store: Store) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files, the checksum from the ids read back."""
    return _files(spark, store).mapInArrow(_checks, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    spark = docs.sparkSession
    return checksums(spark, write(docs, model_path, scratch_path(spark, "tokens")))
