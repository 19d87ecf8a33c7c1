"""Files by path or address, of any store that both driver and executors reach."""

from __future__ import annotations

import os

from pyarrow import fs


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address (file, hdfs, s3, gs and others), and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path else path.removeprefix("file:") if path.startswith("file:") else os.path.abspath(path))


def names_in(files: fs.FileSystem, folder: str) -> list[str]:
    """Paths of a folder's own entries; none where there is no such folder."""
    return [x.path for x in files.get_file_info(fs.FileSelector(folder, allow_not_found=True))]
