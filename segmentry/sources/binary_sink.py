"""Rows of (name, content) as files below a shared folder, by a Spark data source with commit.

Each task writes under a folder of its own inside the target folder; the commit moves the files of the tasks that
succeeded to their names and removes the rest, so a task that is run again leaves nothing behind.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


def _local(path: str) -> str:
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"files are written to a folder that all executors mount, not to {path}")
    return path.removeprefix("file://").removeprefix("file:")


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = _local(path), overwrite
        self.parts = os.path.join(self.path, f"_parts-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[Row]) -> Written:
        folder = os.path.join(self.parts, uuid.uuid4().hex)
        os.makedirs(folder)
        names = []
        for i, row in enumerate(iterator):
            name = os.path.normpath(row["name"])
            if os.path.isabs(name) or name.startswith(".."):
                raise ValueError(f"a name outside the folder: {row['name']}")
            with open(os.path.join(folder, str(i)), "wb") as f:
                f.write(row["content"])
            names.append(name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        every = [n for m in done for n in m.names]
        if len(set(every)) < len(every):
            shutil.rmtree(self.parts, ignore_errors=True)
            raise ValueError("one name twice")
        for m in done:
            for i, name in enumerate(m.names):
                to = os.path.join(self.path, name)
                if not self.overwrite and os.path.exists(to):
                    raise FileExistsError(to)
                os.makedirs(os.path.dirname(to), exist_ok=True)
                os.replace(os.path.join(m.folder, str(i)), to)
        shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"], overwrite)


def write_files(rows: DataFrame, path: str, overwrite: bool = True) -> None:
    """Write rows with ``name`` and ``content`` as files; rows without content are an error."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(NamedFiles)
    rows.select("name", "content").write.format("named_files").mode("overwrite" if overwrite else "append").option("path", path).save()
