"""Inventory of stored files as a data source: sizes, times and digests, block by block."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK_BYTES = 8 << 20
TASK_BYTES = 256 << 20  # small files share a task up to this size
TASK_FILES = 10_000
SCHEMA = "path STRING, size_bytes BIGINT, modified_at TIMESTAMP, sha256 STRING"


@dataclass
class Files(InputPartition):
    paths: list[str]


def _system(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


class BlobInventory(DataSource):
    """One row for each file below a folder, whatever its size.

    A task reads its files in blocks of ``BLOCK_BYTES``, so memory does not depend on
    them. Option ``pattern`` keeps files whose name matches. Names that begin with a
    dot or underscore are Spark's own and left out.
    """

    @classmethod
    def name(cls) -> str:
        return "blob_inventory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BlobReader(self.options["path"], self.options.get("pattern", "*"))


class BlobReader(DataSourceReader):
    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern

    def partitions(self) -> list[Files]:
        from fnmatch import fnmatch

        from pyarrow import fs

        system, root = _system(self.path)
        found = [
            f for f in system.get_file_info(fs.FileSelector(root, recursive=True))
            if f.type == fs.FileType.File and fnmatch(f.base_name, self.pattern) and f.base_name[0] not in "._"
        ]
        groups: list[list[str]] = []
        size = 0
        for f in sorted(found, key=lambda f: -f.size):
            if not groups or size + f.size > TASK_BYTES or len(groups[-1]) >= TASK_FILES:
                groups.append([])
                size = 0
            groups[-1].append(f.path)
            size += f.size
        return [Files(g) for g in groups] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _system(self.path)
        rows = []
        for path in partition.paths:
            digest, size = hashlib.sha256(), 0
            with system.open_input_stream(path, buffer_size=0) as stream:
                while block := stream.read(BLOCK_BYTES):
                    digest.update(block)
                    size += len(block)
            at = system.get_file_info(path).mtime
            rows.append((path, size, at, digest.hexdigest()))
        columns = list(zip(*rows)) or [[]] * 4
        kinds = [pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds)], ["path", "size_bytes", "modified_at", "sha256"]
        )
