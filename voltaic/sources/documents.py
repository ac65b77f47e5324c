"""Documents as files (S7, S8): one file per document, listed, read whole and handed to the text operators."""

from __future__ import annotations

import os
import re
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDERS = 16                    # folders a writing task deals its files to: a later listing is dealt to tasks by folder
TASK_BYTES = 32 << 20           # of files that a task reads
# what Spark escapes in a folder of a partition, and "+", which url_decode reads as a space
_ESCAPED = {c: f"%{c:02X}" for c in [*range(32), 127, *b"\"#%'*/:=?\\{[]^+"]}
_NO_NAME = "__HIVE_DEFAULT_PARTITION__"


def write_documents(df: DataFrame, path: str, name_col: str, content_col: str, mode: str = "overwrite") -> None:
    """Writes each row's content to a file of its own, ``<name_col>=<name>.txt`` in one of a few folders a task. A null
    content is an empty document; the file ends with a line feed. Rows of one name in one task share a file.

    Under a mounted folder (no scheme, or ``file:``) the tasks write the files themselves, as Hadoop's local file system
    starts processes for the mode of each file, folder and checksum. Elsewhere, and in modes other than overwrite and append,
    Spark's writer gives each name a folder ``<name_col>=<name>``.
    """
    rows = df.select(F.col(name_col), F.coalesce(content_col, F.lit("")).alias("value"))
    to = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() == "file" and mode in ("overwrite", "append"):
        _write_files(rows, fs, fs.makeQualified(to), name_col, mode)
    else:
        rows.write.mode(mode).partitionBy(name_col).text(path)


def _write_files(rows: DataFrame, fs, to, name_col: str, mode: str) -> None:
    """The (name, value) rows as files. A task writes to folders of its attempt, which count only once the whole job is done;
    the driver handles these folders and no file."""
    new_path = rows.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path
    staged = new_path(to, f"_temporary-{uuid.uuid4().hex}")
    home, head = staged.toUri().getPath(), f"{name_col}="
    escaped, no_name, n_folders, longest = _ESCAPED, _NO_NAME, FOLDERS, 255 - len(".txt")

    def write(part):
        attempt, made = uuid.uuid4().hex, set()
        for name, value in part:
            stem = head + (name or no_name).translate(escaped)
            folder = f"{attempt}-{zlib.crc32(stem.encode()) % n_folders:02d}"
            made.add(folder)
            # a name that leaves no room for the ending is a folder
            file = os.path.join(home, folder, f"{stem}.txt" if len(stem.encode()) <= longest else f"{stem}/part.txt")
            os.makedirs(os.path.dirname(file), exist_ok=True)
            with open(file, "ab") as f:
                f.write(value + b"\n")
        return sorted(made)

    before = [x.getPath() for x in fs.listStatus(to)] if mode == "overwrite" and fs.exists(to) else []
    fs.mkdirs(staged)
    try:
        folders = rows.select(F.col(name_col).cast("string"), F.col("value").cast("binary")).rdd.mapPartitions(write).collect()
        for old in before:
            fs.delete(old, True)
        for folder in folders:
            if not fs.rename(new_path(staged, folder), new_path(to, folder)):
                raise OSError(f"{folder} of {staged} can't be moved to {to}")
    finally:
        fs.delete(staged, True)
    fs.createNewFile(new_path(to, "_SUCCESS"))


def _files(spark: SparkSession, path: str, glob: str, cols: list) -> DataFrame:
    """``cols`` of the files. Spark counts a small file as 4 MB when it deals files to tasks; here a task takes about 32 MB."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    size = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return files.select(*cols).coalesce(max(4 * spark.sparkContext.defaultParallelism, size // TASK_BYTES))


def _name(name_col: str):
    return F.url_decode(F.regexp_extract("path", f".*/{re.escape(name_col)}=([^/]*)(?:/.*|\\.[^./]*)$", 1))


def list_documents(spark: SparkSession, path: str, name_col: str, glob: str = "*.txt") -> DataFrame:
    """``(name, length, modificationTime, path)`` of every file, without reading any."""
    return _files(spark, path, glob, [_name(name_col).alias(name_col), "length", "modificationTime", "path"])


def read_documents(spark: SparkSession, path: str, name_col: str, content_col: str = "content", glob: str = "*.txt") -> DataFrame:
    """``(name, content)`` of every file, read whole as UTF-8. A file is one value, so it must fit a task (2 GB)."""
    return _files(spark, path, glob, [_name(name_col).alias(name_col), F.col("content").cast("string").alias(content_col)])

