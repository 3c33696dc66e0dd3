"""A data source that writes each row's text as one file under its own name."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def file_system(path: str):
    """The file system of a path or URI (local, or what Arrow knows of remote ones) and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class NamedText(DataSource):
    """``named_text``: columns name and value; ``save`` takes the folder.

    Names are relative to the folder and may hold sub-folders.  Tasks write beside the folder, each file under a name of its own
    first, so that an attempt that is repeated leaves one file.  Commit puts all files in place by one move; abort removes them.
    Names must differ, and rows of one name must be in one partition (``tables.write_text`` sees to that).
    """

    @classmethod
    def name(cls) -> str:
        return "named_text"

    def schema(self) -> str:
        return "name string, value string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return NamedTextWriter(self.options["path"].rstrip("/"), overwrite)


@dataclass
class Written(WriterCommitMessage):
    files: int


class NamedTextWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.staged = path, overwrite, f"{path}.staged-{uuid.uuid4().hex}"
        system, at = file_system(path)
        if not overwrite and system.get_file_info(at).type.name != "NotFound":
            raise FileExistsError(f"{path} is there already")

    def write(self, iterator) -> WriterCommitMessage:
        system, at = file_system(self.staged)
        seen: set[str] = set()
        for row in iterator:
            if not row.name or row.name.startswith("/") or ".." in row.name.split("/"):
                raise ValueError(f"not a name of a file in the folder: {row.name}")
            if row.name in seen:
                raise ValueError(f"two files are named {row.name}")
            seen.add(row.name)
            folder = f"{at}/{row.name}".rpartition("/")[0]
            system.create_dir(folder, recursive=True)
            own = f"{folder}/.{uuid.uuid4().hex}"
            with system.open_output_stream(own) as out:
                out.write((row.value or "").encode("ISO-8859-1", errors="replace"))
            system.move(own, f"{at}/{row.name}")
        return Written(len(seen))

    def commit(self, messages) -> None:
        system, at = file_system(self.staged)
        _, target = file_system(self.path)
        system.create_dir(at, recursive=True)
        if system.get_file_info(target).type.name != "NotFound":
            system.delete_dir(target)
        system.move(at, target)

    def abort(self, messages) -> None:
        system, at = file_system(self.staged)
        if system.get_file_info(at).type.name != "NotFound":
            system.delete_dir(at)
