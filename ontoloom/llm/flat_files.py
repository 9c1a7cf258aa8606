"""Files outside Spark's own formats: written and read by byte range from tasks, on the shared file system."""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, and the path in it; a path without a scheme is a file's."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class Rotating:
    """A writer of numbered files below a folder, each up to a size.

    Names are new with each attempt of a task, and only the rows that a finished attempt returns name its
    files, so a repeated or lost attempt leaves unreferenced files but no wrong ones.
    """

    def __init__(self, folder: str, suffix: str, limit: int):
        self.fs, self.folder = open_fs(folder)
        self.suffix, self.limit, self.out, self.at, self.name = suffix, limit, None, 0, ""

    def write(self, data: bytes) -> tuple[str, int]:
        """Append data; the name of its file and its offset there. One piece of data never spans files."""
        if self.out is None or self.at and self.at + len(data) > self.limit:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}.{self.suffix}", 0
            self.fs.create_dir(self.folder, recursive=True)
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}", buffer_size=1 << 20)
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return self.name, at

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None
