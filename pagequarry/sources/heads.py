"""A data source of file heads: n bytes at an offset of each file, and never more.

    spark.dataSource.register(MediaHeads)
    spark.read.format("media_heads").option("n", 65536).load("hdfs://.../*.mp4")

Files are listed by the driver, as for any file source, and dealt into partitions by number; an executor opens each file, moves to the
offset and reads. Paths may name a file, a folder (its files, whatever their depth) or a pattern with * and ?, in any file system
that Arrow knows (file, hdfs, viewfs, s3, gs).
"""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, size bigint, body binary"
HEAD, FILES = 65536, 256
_ARROW = pa.schema([("url", pa.string()), ("size", pa.int64()), ("body", pa.binary())])


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


def _opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path within it, and what stands before that path in a URL."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path, "file://"
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/"), "file://"
    if scheme == "viewfs":
        host, _, inner = rest.removeprefix("//").partition("/")
        return fs.HadoopFileSystem(f"viewfs://{host}", 0), f"/{inner}", f"viewfs://{host}"
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, path[: len(path) - len(inner)]


def listed(path: str) -> list[tuple[str, int]]:
    """URL and size of the files that a path names, by URL; hidden ones (_ and .) are left out, as Spark's readers do."""
    system, inner, before = _opened(path)
    wild = next((i for i, part in enumerate(inner.split("/")) if "*" in part or "?" in part), None)
    if wild is None:
        info = system.get_file_info(inner)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    else:
        parts = inner.split("/")
        found = system.get_file_info(fs.FileSelector("/".join(parts[:wild]) or "/", recursive=wild < len(parts) - 1))
        same = lambda p: len(p) == len(parts) and all(fnmatchcase(a, b) for a, b in zip(p, parts))
        found = [f for f in found if same(("/" + f.path.lstrip("/") if inner.startswith("/") else f.path).split("/"))]
    shown = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return sorted((f"{before}{f.path}", f.size) for f in shown)


class HeadReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.n, self.offset, self.files = (int(options.get(k, d)) for k, d in (("n", HEAD), ("offset", 0), ("filesperpartition", FILES)))
        if self.n < 0 or self.offset < 0 or self.files < 1:
            raise ValueError("n and offset must not be below 0, filesPerPartition not below 1")

    def partitions(self) -> list[InputPartition]:
        files = listed(self.path)
        return [Files(files[i : i + self.files]) for i in range(0, len(files), self.files)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(partition.files), 64):
            some = partition.files[at : at + 64]
            bodies = [self.head(url, size) for url, size in some]
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in some], pa.string()), pa.array([s for _, s in some], pa.int64()), pa.array(bodies, pa.binary())], schema=_ARROW)

    def head(self, url: str, size: int) -> bytes:
        if self.offset >= size or not self.n:
            return b""
        system, inner, _ = _opened(url)
        with system.open_input_file(inner) as f:
            f.seek(self.offset)
            return f.read(min(self.n, size - self.offset))


class MediaHeads(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_heads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return HeadReader(self.options)
