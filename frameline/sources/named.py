"""A sink for files with names: one file a row, those that are there stay, the newest are kept, nothing half done is seen.

Tasks write to a folder of the job's own.  At the commit the driver moves the files of the
attempts that counted to their names; a job that fails removes its folder, and what was
there before is as it was.  The oldest files go only after the commit.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    """(where the bytes are, their file's name) of one task."""

    files: list[tuple[str, str]]


def numbered(name: str) -> tuple[str, int] | None:
    """The text before the last number of a name, with the ending, and the number; null without one."""
    m = re.fullmatch(r"(.*?)(\d+)(\D*)", name)
    return (f"{m[1]}#{m[3]}", int(m[2])) if m else None


def to_go(names: list[str], keep: int) -> list[str]:
    """All but the ``keep`` with the largest numbers, of names that differ in their last number alone; names without one stay."""
    series: dict[str, list[tuple[int, str]]] = {}
    for name in names:
        if of := numbered(name):
            series.setdefault(of[0], []).append((of[1], name))
    return [name for found in series.values() for _, name in sorted(found, reverse=True)[keep:]]


class NamedFileWriter(DataSourceWriter):
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("named_files needs a path")
        self.path, self.keep = options["path"], int(options["keep"]) if "keep" in options else None
        if self.keep is not None and self.keep < 1:
            raise ValueError("keep must be positive")
        self.own = f"_job-{uuid.uuid4().hex}"  # drawn on the driver, the same for all tasks

    def _open(self):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def write(self, iterator: Iterator[Row]) -> Written:
        from pyarrow.fs import FileType

        fs, root = self._open()
        fs.create_dir(f"{root}/{self.own}", recursive=True)
        files = []
        for name, content in iterator:
            if not name or "/" in name or name.startswith("_"):
                raise ValueError(f"not a name of a file here: {name!r}")
            if fs.get_file_info(f"{root}/{name}").type != FileType.NotFound:
                continue
            place = f"{self.own}/{uuid.uuid4().hex}"
            with fs.open_output_stream(f"{root}/{place}") as out:
                out.write(content.encode() if isinstance(content, str) else bytes(content or b""))
            files.append((place, name))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow.fs import FileSelector, FileType

        fs, root = self._open()
        for place, name in sorted((f for m in messages if m for f in m.files), key=lambda f: f[1]):
            # of several rows with one name the first that is moved stays
            if fs.get_file_info(f"{root}/{name}").type == FileType.NotFound:
                fs.move(f"{root}/{place}", f"{root}/{name}")
        self._clear(fs, root)
        if self.keep is not None:
            there = [f.base_name for f in fs.get_file_info(FileSelector(root, allow_not_found=True)) if f.type == FileType.File]
            for name in to_go(there, self.keep):
                fs.delete_file(f"{root}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._open())

    def _clear(self, fs, root: str) -> None:
        from pyarrow.fs import FileType

        if fs.get_file_info(f"{root}/{self.own}").type == FileType.Directory:
            fs.delete_dir(f"{root}/{self.own}")


class NamedFiles(DataSource):
    """Format ``named_files``: rows (name, content), options path and keep."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> NamedFileWriter:
        if [f.dataType.simpleString() for f in schema.fields] not in (["string", "string"], ["string", "binary"]):
            raise ValueError("named_files takes a name and a content, text or binary")
        if overwrite:
            raise ValueError("named_files never writes over files; use append")
        return NamedFileWriter(dict(self.options))


def write(df: DataFrame, name: Column, content: Column, path: str, keep: int | None = None) -> None:
    """Writes a file for each row whose name is not there yet; with ``keep``, only the files with the largest numbers of each series stay."""
    df.sparkSession.dataSource.register(NamedFiles)
    out = df.select(name.alias("name"), content.alias("content")).write.format("named_files").mode("append").option("path", path)
    (out if keep is None else out.option("keep", keep)).save()
