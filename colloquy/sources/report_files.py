"""Reports as files, one a session under its own name, written by the executors.

``reports.write.format("session_reports").option("path", folder).mode("append").save()``
puts each row of (session_id, file_name, html) into
``folder/session_id=<id>/<file_name>``, so that names of one minute do not clash.
Tasks write to a folder of the job's own; its files are moved to their places when
all tasks are done, and deleted if the job fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .files import names_in, store
from .schemas import REPORTS, checked

_STAGED = "_staged-"


@dataclass
class _Written(WriterCommitMessage):
    """What one task wrote: (staged path below the job's folder, place below the target)."""

    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, _STAGED + uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        files, folder = store(self.path)
        own, written = uuid.uuid4().hex, []  # each try of a task has a folder of its own
        files.create_dir(f"{folder}/{self.job}/{own}", recursive=True)
        for row in iterator:
            if not row.file_name or "/" in row.file_name:
                raise ValueError(f"no file name: {row.file_name!r}")
            place = f"session_id={'null' if row.session_id is None else quote(str(row.session_id), safe='')}/{row.file_name}"
            staged = f"{own}/{len(written)}"
            with files.open_output_stream(f"{folder}/{self.job}/{staged}") as out:
                out.write((row.html or "").encode())
            written.append((staged, place))
        return _Written(written)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, folder = store(self.path)
        todo = [pair for m in messages if m is not None for pair in m.files]
        if len({place for _, place in todo}) < len(todo):
            self.abort(messages)
            raise ValueError("two reports of one session have the same name")
        if self.overwrite:
            for old in names_in(files, folder):
                if _STAGED not in old:
                    files.delete_dir(old) if files.get_file_info(old).type.name == "Directory" else files.delete_file(old)

        def move(pair: tuple[str, str]) -> None:
            target = f"{folder}/{pair[1]}"
            files.create_dir(target.rpartition("/")[0], recursive=True)
            files.move(f"{folder}/{self.job}/{pair[0]}", target)

        with ThreadPoolExecutor(16) as pool:  # names only; the texts stay where they are
            list(pool.map(move, todo))
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, folder = store(self.path)
        if f"{folder}/{self.job}" in names_in(files, folder):
            files.delete_dir(f"{folder}/{self.job}")


class ReportFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "session_reports"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if "path" not in self.options:
            raise ValueError("option path is missing")
        return _Writer(self.options["path"], overwrite)


def write_files(reports: DataFrame, path: str, mode: str = "append") -> None:
    """Each of ``reports`` (session_id, file_name, html) as a file of its own below ``path``; see the module."""
    rows = checked(reports, REPORTS)
    rows.sparkSession.dataSource.register(ReportFiles)
    rows.select("session_id", "file_name", "html").write.format("session_reports").option("path", path).mode(mode).save()
