"""A Spark data source of image sizes that reads headers only.

Files are listed once and dealt out in lists; a task opens each file, reads the few bytes that hold its size and seeks past
everything else, so pixels, thumbnails and colour profiles are never read. Any file system that Arrow opens by path works.
"""

from __future__ import annotations

import csv
import io
import struct
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FILES_PER_TASK = 256
SCHEMA = "path string, file_name string, width long, height long, bytes_read long"
_PNG = b"\x89PNG\r\n\x1a\n"
#: Fixed values of the JPEG format: markers of frames, and of those among the same numbers that are none.
_FRAMES, _OTHER = range(0xC0, 0xD0), (0xC4, 0xC8, 0xCC)


def header_of(file) -> tuple[int, int, int]:
    """(width, height, bytes read) of an open PNG or JPEG file; sizes are -1 for anything else."""
    head = file.read(24)
    seen = len(head)
    if head[:8] == _PNG and len(head) == 24:
        return *struct.unpack(">II", head[16:24]), seen
    if head[:2] != b"\xff\xd8":
        return -1, -1, seen
    at = 2
    while True:
        file.seek(at)
        mark = file.read(9)
        seen += len(mark)
        if len(mark) < 9 or mark[0] != 0xFF:
            return -1, -1, seen
        if mark[1] == 0xFF:  # fill byte
            at += 1
        elif mark[1] in _FRAMES and mark[1] not in _OTHER:
            height, width = struct.unpack(">HH", mark[5:9])
            return width, height, seen
        else:
            at += 2 + struct.unpack(">H", mark[2:4])[0]


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.names = options["path"], options.get("names")
        self.size = int(options.get("filesPerTask", FILES_PER_TASK))
        self.suffixes = tuple(s for s in options.get("suffixes", "").lower().split(",") if s)

    def _listed(self) -> list[str]:
        system, root = fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)
        if self.names:
            with system.open_input_stream(self.names.split("://")[-1]) as file:
                text = file.read().decode("utf-8")
            if self.names.lower().endswith(".csv"):
                rows = list(csv.DictReader(io.StringIO(text)))
                names = [next(iter(r.values())) for r in rows]
            else:
                names = [line.strip() for line in text.splitlines()]
            return [f"{root.rstrip('/')}/{n}" for n in names if n]
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        return sorted(f.path for f in found if f.type == fs.FileType.File and (not self.suffixes or f.path.lower().endswith(self.suffixes)))

    def partitions(self) -> list[InputPartition]:
        paths = self._listed()
        return [_Files(paths[at:at + self.size]) for at in range(0, len(paths), self.size)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        system = fs.FileSystem.from_uri(self.root)[0] if "://" in self.root else fs.LocalFileSystem()
        for path in partition.paths if partition else ():  # without any file Spark makes one empty partition
            with system.open_input_file(path) as file:
                width, height, seen = header_of(file)
            yield path, path.rsplit("/", 1)[-1], width, height, seen


class ImageHeaders(DataSource):
    """``spark.read.format("image_headers").load(folder)``: a row per file below the folder.

    Options: ``suffixes`` (comma-separated), ``names`` (a text file with a name per line, or a CSV file whose first column
    holds names, in the place of listing), ``filesPerTask``. Files that are neither PNG nor JPEG have size -1.
    """

    @classmethod
    def name(cls) -> str:
        return "image_headers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
