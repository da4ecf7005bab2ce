"""Zip archives of files, written by the tasks that hold them and put in place by one commit.

A Python data source: every archive is streamed by one task to a file of its own attempt;
the driver renames the files of the attempts that Spark committed and removes all others,
so a task that failed or ran twice leaves no second copy. The folder has to be one that
driver and executors mount alike.
"""

from __future__ import annotations

import io
import os
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from sitelens.functions import paths as P

NAME = "sitelens_zip"
ENTRIES = "archive string, path string, size long, content binary"
#: The time that all entries bear, so that equal contents make equal archives.
EPOCH = (1980, 1, 1, 0, 0, 0)
BATCH_BYTES = 1 << 22


def mounted(path: str) -> str:
    """A folder's plain path; other stores than mounted ones can't take archives."""
    plain = path.removeprefix("file:")
    plain = "/" + plain.lstrip("/") if plain != path else plain
    if "://" in plain:
        raise ValueError(f"zip archives need a mounted folder, not {path}")
    return plain


@dataclass
class Written(WriterCommitMessage):
    """The archives of one attempt: (where it lies, its name)."""

    files: list[tuple[str, str]] = field(default_factory=list)


class ZipWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite
        self.attempts = os.path.join(folder, f"_attempts-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> Written:
        """Rows of (archive, path, content), those of an archive one after another."""
        mine = os.path.join(self.attempts, uuid.uuid4().hex)
        os.makedirs(mine)
        done, name, out = Written(), None, None
        try:
            for row in iterator:
                if row["archive"] != name:
                    if out:
                        out.close()
                    name, at = row["archive"], os.path.join(mine, f"{len(done.files)}.zip")
                    out = zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED)
                    done.files.append((at, name))
                out.writestr(zipfile.ZipInfo(row["path"], EPOCH), row["content"] or "", zipfile.ZIP_DEFLATED)
        finally:
            if out:
                out.close()
        return done

    def commit(self, messages: list) -> None:
        if self.overwrite:
            for old in os.listdir(self.folder):
                if old.endswith(".zip"):
                    os.remove(os.path.join(self.folder, old))
        for message in messages:
            for at, name in message.files if message else ():
                os.replace(at, os.path.join(self.folder, f"{name}.zip"))
        shutil.rmtree(self.attempts, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.attempts, ignore_errors=True)


class ZipSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> ZipWriter:
        folder = mounted(self.options["path"])
        os.makedirs(folder, exist_ok=True)
        return ZipWriter(folder, overwrite)


def write_zips(files: DataFrame, folder: str) -> None:
    """Write (archive, path, content) as one zip file an archive below ``folder``.

    Entry names are sanitised paths, so that none leaves the archive; archive names too,
    with slashes as underscores. Of rows with one name the least content counts, null
    contents are empty ones, and rows without an archive are left out. An empty table
    writes nothing.
    """
    spark = files.sparkSession
    spark.dataSource.register(ZipSource)
    archive = F.translate(P.sanitize_path(F.col("archive")), "/", "_")
    rows = files.filter("archive is not null").select(archive.alias("archive"), P.sanitize_path(F.coalesce("path", F.lit(""))).alias("path"), F.coalesce("content", F.lit("")).alias("content"))
    rows = rows.groupBy("archive", "path").agg(F.min("content").alias("content"))
    rows = rows.repartition("archive").sortWithinPartitions("archive", "path")
    rows.write.format(NAME).mode("append").save(folder)


def read_zips(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of ENTRIES for every entry of the zip files below a folder; files that are none give no rows."""
    names = [n.split()[0] for n in ENTRIES.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.binary()]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                held, size = [], 0
                try:
                    whole = zipfile.ZipFile(io.BytesIO(content.as_py()))
                except zipfile.BadZipFile:
                    continue
                for entry in whole.infolist():
                    data = whole.read(entry)
                    held.append((os.path.basename(path).removesuffix(".zip"), entry.filename, entry.file_size, data))
                    size += len(data)
                    if size > BATCH_BYTES:
                        yield pack(held)
                        held, size = [], 0
                if held:
                    yield pack(held)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder)
    return found.select("path", "content").mapInArrow(run, ENTRIES)


def barrels(parts: DataFrame) -> DataFrame:
    """(chunk, file, content): an index of each chunk's parts (chunk, file), one export a line in order of name."""
    name = F.concat(F.lit("export * from './"), F.col("file"), F.lit("';"))
    listed = F.array_sort(F.collect_set(name))
    return parts.filter("file is not null").groupBy("chunk").agg(F.concat(F.array_join(listed, "\n"), F.lit("\n")).alias("content")).select("chunk", F.lit("index.js").alias("file"), "content")
