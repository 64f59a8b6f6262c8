"""A data source that writes one text file for each row, such as a Markdown file for each letter.

``df.write.format("named_texts")`` takes the columns ``name`` (a path below the folder) and ``text``. A task writes each
file under a temporary name and then moves it to its own, so no half-written file is ever seen and a repeated task writes
the same files again. ``_SUCCESS`` is written when all tasks are done. Reading is left to Spark's own text source.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "named_texts"
#: Files of a micro-batch: the driver holds the names and the listing of one batch at a time.
FILES_PER_TRIGGER = 50_000
#: Spark deals 32 small files to a task, as many as would take the time of reading 128 MB if each cost as much as 4 MB.
SPLITS_PER_TASK = 64


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def file_path() -> Column:
    """The path of the file a row was read from, as it is named: Spark gives it percent-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


@dataclass
class Written(WriterCommitMessage):
    files: int


class NamedTexts(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return NamedTextWriter(self.options["path"], overwrite)


class NamedTextWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path = path
        store, folder = file_system(path)
        if store.get_file_info(f"{folder}/_SUCCESS").type != fs.FileType.NotFound:
            if not overwrite:
                raise ValueError(f"{path} holds finished files; write with mode overwrite, or elsewhere")
            store.delete_file(f"{folder}/_SUCCESS")
        store.create_dir(folder, recursive=True)

    def write(self, iterator: Iterator[Row]) -> Written:
        store, folder = file_system(self.path)
        made, files = {folder}, 0
        for row in iterator:
            parts = (row.name or "").split("/")
            if not all(parts) or {".", ".."} & set(parts):
                raise ValueError(f"not a name of a file: {row.name!r}")
            target = "/".join([folder, *parts])
            parent = target.rpartition("/")[0]
            if parent not in made:
                store.create_dir(parent, recursive=True)
                made.add(parent)
            temporary = f"{parent}/.{uuid.uuid4().hex}.tmp"
            with store.open_output_stream(temporary, compression=None) as out:
                out.write((row.text or "").encode())
            store.move(temporary, target)
            files += 1
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = file_system(self.path)
        with store.open_output_stream(f"{folder}/_SUCCESS", compression=None) as out:
            out.write(str(sum(m.files for m in messages if m is not None)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Files moved to their names stay, without ``_SUCCESS``; writing again replaces them."""


def write_texts(rows: DataFrame, path: str, *, name: str = "name", text: str = "text", mode: str = "append") -> None:
    """A file for each row. Two rows of one name write one file: the last to be written stays."""
    rows.sparkSession.dataSource.register(NamedTexts)
    rows.select(F.col(name).cast("string").alias("name"), F.col(text).cast("string").alias("text")).write.format(FORMAT).mode(mode).save(path)


def in_fewer_tasks(files: DataFrame) -> DataFrame:
    """Small files just read, in tasks of some 2,000 files where Spark has one for every 32, if all cores have work."""
    splits, cores = files.rdd.getNumPartitions(), files.sparkSession.sparkContext.defaultParallelism
    tasks = max(2 * cores, -(-splits // SPLITS_PER_TASK))
    return files.coalesce(tasks) if tasks < splits else files


@contextmanager
def many_small_files(spark: SparkSession) -> Iterator[None]:
    """A stream over files that runs inside lists and reads them in a few tasks for each core. By default Spark lists a
    batch in up to 10,000 tasks and reads it in one for every 32 files. The source looks up these settings for each batch.

    The log of the files read is compacted every ten batches to one file that names them all. Spark keeps those of the last
    hundred batches, so they grow with the square of the files; here those of the last ten are kept, which a restart needs.
    """
    cores = spark.sparkContext.defaultParallelism
    settings = {
        "spark.sql.files.openCostInBytes": "32k",
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": str(2 * cores),
        "spark.sql.streaming.minBatchesToRetain": "10",
        "spark.sql.streaming.fileSource.log.cleanupDelay": "0",
    }
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def stream_texts(spark: SparkSession, path: str, pattern: str = "*.txt", *, files_per_trigger: int | None = FILES_PER_TRIGGER) -> DataFrame:
    """Files landed since the last run, each whole: ``path, text``. The checkpoint of the query remembers which were read.
    Let the query run inside ``many_small_files``."""
    reader = spark.readStream.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path, wholetext=True).select(file_path().alias("path"), F.col("value").alias("text"))
