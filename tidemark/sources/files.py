"""Identity of files of any size: a listing whose digests come from ranged reads."""

from __future__ import annotations

import fnmatch
import hashlib
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Bytes of a block, of a read of a whole file, and of the reads of one partition.
BLOCK, PIECE, TASK = 8 << 20, 1 << 20, 256 << 20
_TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


def digest(fs, path: str, size: int, mtime_ns: int, whole: int, block: int, stamp: bool) -> tuple[str, int]:
    """SHA-256 of the size and, up to ``whole`` bytes, all content; of a larger file of the first, middle and last
    block, behind its time of change if ``stamp``. Also the bytes that were read."""
    out, got = hashlib.sha256(str(size).encode()), 0
    with fs.open_input_file(path) as f:
        if size <= whole:
            while piece := f.read(PIECE):
                out.update(piece)
                got += len(piece)
        else:
            if stamp:
                out.update(str(mtime_ns).encode())
            for at in (0, max(0, size // 2 - block // 2), max(0, size - block)):
                f.seek(at)
                piece = f.read(min(block, size))
                out.update(piece)
                got += len(piece)
    return out.hexdigest(), got


class _Files(InputPartition):
    def __init__(self, files: list[tuple]):
        super().__init__(None)
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root, self.pattern = options["path"], options.get("pattern", "*")
        self.whole, self.block = int(options.get("whole", 0)), int(options.get("block", BLOCK))
        self.stamp, self.tests = options.get("stamp", "false").lower() == "true", []

    def pushFilters(self, filters):
        """Comparisons of the size with a number are answered by the listing; all others stay Spark's."""
        for f in filters:
            if type(f) in _TESTS and f.attribute == ("size",):
                self.tests.append((_TESTS[type(f)], f.value))
            else:
                yield f

    def partitions(self):
        """The files of the listing, dealt by the bytes that their digests read."""
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.root)
        parts, held, cost = [], [], 0
        for x in sorted(store.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda x: x.path):
            if x.type != fs.FileType.File or not fnmatch.fnmatch(x.base_name, self.pattern) or not all(test(x.size, n) for test, n in self.tests):
                continue
            held.append((x.path, x.size, x.mtime_ns))
            cost += PIECE + (x.size if x.size <= self.whole else min(x.size, self.block) * 3)
            if cost >= TASK:
                parts.append(_Files(held))
                held, cost = [], 0
        return [*parts, _Files(held)]

    def read(self, partition):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.root)
        for path, size, mtime_ns in partition.files:
            name, got = digest(store, path, size, mtime_ns, self.whole, self.block, self.stamp)
            yield path, size, datetime.fromtimestamp(mtime_ns // 1000 / 1e6, timezone.utc), name, got


class FileDigests(DataSource):
    """Files below a folder (path, size, modified, digest, bytes_read)."""

    @classmethod
    def name(cls):
        return "file_digests"

    def schema(self):
        return "path string, size long, modified timestamp, digest string, bytes_read long"

    def reader(self, schema):
        return _Reader(self.options)


def file_digests(spark: SparkSession, root: str, pattern: str = "*", whole: int = 0, block: int = BLOCK, stamp: bool = False) -> DataFrame:
    """Digests of the files below ``root``, a path or address that Arrow's file systems open. Files above ``whole``
    bytes are told by three blocks, so one of any size costs three seeks; the driver lists names and sizes only.
    An empty folder gives no rows; an empty file the digest of its size; a missing folder is an error."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileDigests)
    return spark.read.format("file_digests").options(pattern=pattern, whole=str(whole), block=str(block), stamp=str(stamp)).load(root)


def changed_content(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files of a listing that are new or whose size or digest differs from the catalog's, and files that are gone:
    (path, change: new, changed or gone)."""
    old = catalog.select("path", F.struct("size", "digest").alias("old"))
    both = found.select("path", F.struct("size", "digest").alias("now")).join(old, "path", "full_outer")
    change = F.when(F.col("old").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("old") != F.col("now"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")
