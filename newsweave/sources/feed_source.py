"""Feed documents as a Spark data source: the same reader for batches and streams.

The documents of a feed lie in ``<root>/<feed column>=<id>/<number column>=<n>/``, numbered as they were fetched. A partition is a run of documents
of one feed, so feeds are read side by side and a feed with most of the documents is split. The offset of a stream is the last number
read of every feed: a batch reads what lies between two offsets, and a restarted stream goes on from the offset in its checkpoint.
A new document must have a number above those of its feed; what is below an offset is never looked at again.

    register(spark)
    spark.read.format("feed_documents").option("root", folder).load()
    spark.readStream.format("feed_documents").option("root", folder).option("documents_per_task", 50).load()

Folders are opened through pyarrow's file systems, on the driver to list and in the tasks to read, so ``root`` may be a path that all
machines share or a URI of a store that pyarrow knows.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Runs of a batch beyond which they hold more documents, so that a backlog makes longer tasks, not ever more of them.
MAX_RUNS = 400

SCHEMA = "source_id long, number long, fetched_at timestamp, xml string"


def opened(root: str):
    """(file system, path) of a folder."""
    from pyarrow import fs

    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


def numbers_in(system, folder: str, column: str) -> list[int]:
    """The numbers n of the folders ``column=n`` below a folder."""
    from pyarrow import fs

    names = (i.base_name.split("=", 1) for i in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.type == fs.FileType.Directory)
    return sorted(int(n[1]) for n in names if len(n) == 2 and n[0] == column and n[1].isdigit())


@dataclass
class Run(InputPartition):
    """Documents of one feed."""

    feed: int
    numbers: tuple[int, ...]


class Folder:
    """Listing and reading of the documents below a root."""

    def __init__(self, options):
        self.root = options["root"]
        self.feed_column, self.number_column = options.get("feed_column", "source_id"), options.get("number_column", "number")
        self.per_task = int(options.get("documents_per_task", 100))

    def runs(self, after: dict[str, int], upto: dict[str, int] | None = None) -> list[Run]:
        """Documents behind the numbers ``after`` (by feed) and up to those of ``upto``, in runs of at most ``documents_per_task``, or of
        a ``MAX_RUNS``-th of all where that is more."""
        system, path = opened(self.root)
        found = {}
        for feed in numbers_in(system, path, self.feed_column):
            low, high = after.get(str(feed), -1), None if upto is None else upto.get(str(feed), -1)
            if high is not None and high <= low:
                continue
            found[feed] = [n for n in numbers_in(system, f"{path}/{self.feed_column}={feed}", self.number_column) if n > low and (high is None or n <= high)]
        length = max(self.per_task, -(-sum(map(len, found.values())) // MAX_RUNS))
        return [Run(feed, tuple(wanted[i:i + length])) for feed, wanted in found.items() for i in range(0, len(wanted), length)]

    def ends(self) -> dict[str, int]:
        """The last number of every feed."""
        system, path = opened(self.root)
        found = {str(f): numbers_in(system, f"{path}/{self.feed_column}={f}", self.number_column) for f in numbers_in(system, path, self.feed_column)}
        return {f: n[-1] for f, n in found.items() if n}

    def read(self, partition: Run):
        from pyarrow import fs

        system, path = opened(self.root)
        for n in partition.numbers:
            folder = f"{path}/{self.feed_column}={partition.feed}/{self.number_column}={n}"
            for info in sorted(system.get_file_info(fs.FileSelector(folder, allow_not_found=True)), key=lambda i: i.path):
                if info.type != fs.FileType.File or info.base_name.startswith(("_", ".")):
                    continue
                with system.open_input_stream(info.path) as f:
                    text = f.read().decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([pa.array([partition.feed]), pa.array([n]), pa.array([info.mtime], pa.timestamp("us", "UTC")), pa.array([text])],
                                                 ["source_id", "number", "fetched_at", "xml"])


class BatchReader(DataSourceReader):
    def __init__(self, options):
        self.folder = Folder(options)

    def partitions(self):
        return self.folder.runs({}) or [Run(0, ())]

    def read(self, partition):
        return self.folder.read(partition)


class StreamReader(DataSourceStreamReader):
    """An offset is {feed: last number}, feeds in order of their text, so that equal offsets are equal as JSON."""

    def __init__(self, options):
        self.folder = Folder(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return dict(sorted(self.folder.ends().items()))

    def partitions(self, start: dict, end: dict):
        return self.folder.runs(start, end)

    def read(self, partition):
        return self.folder.read(partition)

    def commit(self, end: dict) -> None:
        """Documents stay where they are."""


class FeedDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feed_documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BatchReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeedDocuments)


def feed_documents(spark: SparkSession, root: str, stream: bool = False, **options):
    """The documents below ``root`` (source_id, number, fetched_at, xml), as a batch or as a stream."""
    register(spark)
    reader = (spark.readStream if stream else spark.read).format("feed_documents").option("root", root)
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()
