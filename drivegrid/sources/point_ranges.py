"""Point files as a splittable source: many tasks read one file.

The body of a binary point file is a run of records of one size, so any range of records is a
range of bytes. The source lists files and reads their headers; its partitions are ranges of
about ``range_bytes``. ASCII bodies are one partition a file. Files are opened through Arrow's
file systems (local, HDFS and object stores); a store that only Spark's readers can open needs
``binary.read_point_files``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from drivegrid.sources.binary import POINT_FILE, finite_points, point_header, points_of, record_type

RANGE_BYTES = 64 << 20
#: Rows of a batch that a task hands over at once.
BATCH_ROWS = 1 << 18
_HEAD_BYTES = 1 << 16


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


@dataclass
class Range(InputPartition):
    path: str
    kind: str
    cols: list
    start: int
    count: int
    size: int | None

    def __post_init__(self):
        super().__init__(self.start)


class PointRangeReader(DataSourceReader):
    def __init__(self, paths: list[str], range_bytes: int):
        self.paths, self.range_bytes = paths, range_bytes

    def partitions(self) -> list[Range]:
        found = []
        for path in self.paths:
            with _open(path) as f:
                head, size = f.read(_HEAD_BYTES), f.size()
                while True:  # a longer header is read on
                    try:
                        kind, cols, n, body = point_header(head, path)
                        break
                    except ValueError:
                        more = f.read(_HEAD_BYTES)
                        if not more:
                            raise
                        head += more
            if kind == "ascii":
                found.append(Range(path, kind, cols, body, n, None))
                continue
            record = record_type(cols).itemsize
            if body + n * record > size:
                raise ValueError(f"{path} is shorter than its header says")
            each = max(1, self.range_bytes // record)
            found += [Range(path, kind, cols, body + k * record, min(each, n - k), record) for k in range(0, n, each)]
        return found

    def read(self, partition: Range):
        import pyarrow as pa

        with _open(partition.path) as f:
            f.seek(partition.start)
            if partition.size is None:
                parts = [(f.read(), partition.count)]
            else:
                parts = ((f.read(min(BATCH_ROWS, partition.count - k) * partition.size), min(BATCH_ROWS, partition.count - k)) for k in range(0, partition.count, BATCH_ROWS))
            for body, n in parts:
                yield pa.RecordBatch.from_pandas(points_of(partition.path, partition.kind, partition.cols, body, n), preserve_index=False)


class PointRanges(DataSource):
    """Format ``point_ranges``; options ``paths`` (one a line) and ``range_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "point_ranges"

    def schema(self) -> str:
        return POINT_FILE

    def reader(self, schema) -> PointRangeReader:
        paths = [p for p in self.options.get("paths", "").split("\n") if p]
        return PointRangeReader(paths, int(self.options.get("range_bytes", RANGE_BYTES)))


def read_point_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The points of all files under ``path`` (as ``binary.read_point_files`` gives them). Spark
    lists the files; their contents are read by the tasks only."""
    spark.dataSource.register(PointRanges)
    names = [r[0] for r in spark.read.format("binaryFile").load(path).select("path").collect()]
    raw = spark.read.format("point_ranges").option("paths", "\n".join(sorted(names))).option("range_bytes", str(range_bytes)).load()
    return finite_points(raw)
