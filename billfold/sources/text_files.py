"""One file per text in a folder of a mounted file system, written and read by tasks without Hadoop's file calls.

The layout is that of Spark's writer: ``file_stem=<stem>/part-...txt``, stems escaped as in a partition folder.
"""

from __future__ import annotations

import os
import re
import shutil
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

_KEY = b"file_stem="
_ESCAPED = re.compile(rb"""[\x00-\x1f"#%'*/:=?\\\x7f{}\[\]^]""")
_NONE = b"__HIVE_DEFAULT_PARTITION__"
_DRAFTS = "_temporary"
_BATCH_BYTES, _BATCH_ROWS = 1 << 22, 1 << 12  # of what a reading task hands over at once
_TASKS_PER_CORE = 4


def mounted_folder(spark: SparkSession, path: str) -> str | None:
    """The plain path of a folder in a file system that is mounted on every machine, else None."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _folder_name(stem: bytes | None) -> bytes:
    return _KEY + (_ESCAPED.sub(lambda c: b"%%%02X" % c[0][0], stem) if stem else _NONE)


def _writer(drafts: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        own = os.fsencode(f"{drafts}/{task.taskAttemptId()}")
        n = 0
        for batch in batches:
            for stem, value in zip(batch.column(0), batch.column(1), strict=True):
                folder = os.path.join(own, _folder_name(stem.as_py()))
                os.makedirs(folder, exist_ok=True)
                with open(os.path.join(folder, b"part-%05d-%d-%d.txt" % (task.partitionId(), task.taskAttemptId(), n)), "wb") as file:
                    file.write(value.as_buffer())
                    file.write(b"\n")
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([os.fsdecode(own)])], names=["draft"])

    return write


def _publish(draft: str) -> None:
    """Moves what a task has written to its place; what an attempt before has moved is no longer there."""
    top = os.path.dirname(os.path.dirname(draft))
    for name in os.listdir(draft):
        os.makedirs(f"{top}/{name}", exist_ok=True)
        for file in os.listdir(f"{draft}/{name}"):
            os.rename(f"{draft}/{name}/{file}", f"{top}/{name}/{file}")


def write_text_files(texts: DataFrame, folder: str) -> None:
    """Replaces a folder by one file per row of ``texts(file_stem, value)``.

    Each attempt of a task writes into a folder of its own; only those of the attempts whose task has ended
    well are moved to their place.
    """
    spark = texts.sparkSession
    shutil.rmtree(folder, ignore_errors=True)
    drafts = f"{folder}/{_DRAFTS}"
    os.makedirs(drafts)
    as_bytes = texts.selectExpr("cast(file_stem as binary)", "cast(value as binary)")
    written = [r.draft for r in as_bytes.mapInArrow(_writer(drafts), "draft string").collect()]
    if written:
        spark.sparkContext.parallelize(written, len(written)).foreach(_publish)
    shutil.rmtree(drafts)
    open(f"{folder}/_SUCCESS", "w").close()


def _stem(name: bytes) -> bytes | None:
    escaped = name.removeprefix(_KEY)
    return None if escaped == _NONE else re.sub(rb"%([0-9A-Fa-f]{2})", lambda c: bytes([int(c[1], 16)]), escaped)


def _reader(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batch(rows: list[tuple[bytes | None, bytes]]) -> pa.RecordBatch:
        columns = [pa.array(c, pa.binary()) for c in zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["file_stem", "value"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = os.fsencode(folder)
        rows, held = [], 0
        for name in (n.as_py() for b in batches for n in b.column(0)):
            for entry in os.scandir(os.path.join(top, name)):
                if entry.name.startswith((b"_", b".")):
                    continue
                with open(entry.path, "rb") as file:
                    rows.append((_stem(name), file.read()))
                held += len(rows[-1][1])
                if held >= _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)

    return read


def read_text_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(file_stem, value)`` of every file that ``write_text_files`` has made in a folder.

    The driver lists the names of the stems' folders, as Spark's own reader does with all files; tasks read them.
    """
    names = [n for n in os.listdir(os.fsencode(folder)) if n.startswith(_KEY)]
    listed = spark.createDataFrame(pa.table({"name": pa.array(names, pa.binary())}))
    found = listed.repartition(_TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    as_bytes = found.mapInArrow(_reader(folder), "file_stem binary, value binary")
    return as_bytes.selectExpr("cast(file_stem as string) as file_stem", "cast(value as string) as value")
