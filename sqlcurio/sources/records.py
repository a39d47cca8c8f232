"""A sink of one JSON file a record, with the files it names copied beside it; committed as a whole."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """Any store that Arrow reads: a local or mounted folder, or a URI."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: its folder, records and copied files."""

    folder: str
    records: int
    files: int


class RecordSink(DataSource):
    """``path``; ``name``, the column that names a record's file; ``copies``, a column of paths to copy (optional)."""

    @classmethod
    def name(cls) -> str:
        return "record_files"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return RecordWriter(dict(self.options), schema, overwrite)


class RecordWriter(DataSourceWriter):
    """Tasks write to folders of their own attempt below ``_staging``; the commit moves those of the attempts that won.

    A folder moves whole, so the driver renames one a task, not one a record. What killed attempts left
    goes with the staging folder.
    """

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool) -> None:
        self.options, self.overwrite, self.run = options, overwrite, uuid.uuid4().hex

    def _staging(self) -> tuple[fs.FileSystem, str, str]:
        files, root = _located(self.options["path"])
        return files, root, f"{root}/_staging-{self.run}"

    def write(self, rows: Iterator[Row]) -> Written:
        files, _, staging = self._staging()
        context = TaskContext.get()
        folder = f"part-{context.partitionId():05d}-{context.taskAttemptId()}"
        base, names, copied = f"{staging}/{folder}", {}, 0
        own, copies = self.options["name"], self.options.get("copies")
        files.create_dir(base, recursive=True)
        with files.open_output_stream(f"{base}/manifest.jsonl") as manifest:
            for row in rows:
                record = row.asDict(recursive=True)
                name = re.sub(r"[^\w\-]", "_", "null" if record[own] is None else str(record[own])) or "_"
                names[name] = names.get(name, 0) + 1
                name = name if names[name] == 1 else f"{name}.{names[name]}"  # a dot is in no name, so this is nobody else's
                if copies:
                    record[copies] = [self._copy(files, p, base, name, k) for k, p in enumerate(record[copies] or [])]
                    copied += len(record[copies])
                with files.open_output_stream(f"{base}/{name}.json") as out:
                    out.write(json.dumps(record, ensure_ascii=False, default=str).encode())
                manifest.write((json.dumps({"name": record[own], "file": f"{folder}/{name}.json", "copies": record[copies] if copies else []}, default=str) + "\n").encode())
        return Written(folder, sum(names.values()), copied)

    def _copy(self, files: fs.FileSystem, path: str, base: str, name: str, k: int) -> str:
        source, at = _located(path)
        file = f"{name}_files/{k}_{at.rsplit('/', 1)[-1]}"
        files.create_dir(f"{base}/{name}_files", recursive=True)
        with source.open_input_stream(at) as from_, files.open_output_stream(f"{base}/{file}") as to:
            while block := from_.read(1 << 20):
                to.write(block)
        return file

    def commit(self, messages: list[Written | None]) -> None:
        files, root, staging = self._staging()
        done = [m for m in messages if m is not None]
        old = [f.path for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.Directory and not f.base_name.startswith("_staging")] if self.overwrite else []
        files.create_dir(root, recursive=True)
        run = f"{root}/run-{self.run}"
        files.create_dir(run)
        for m in done:
            if m.records:
                files.move(f"{staging}/{m.folder}", f"{run}/{m.folder}")
        with files.open_output_stream(f"{run}/_SUCCESS") as out:  # a run without it is not whole
            out.write(json.dumps({"records": sum(m.records for m in done), "files": sum(m.files for m in done), "parts": sum(m.records > 0 for m in done)}).encode())
        for path in old:
            files.delete_dir(path)
        self._clear(files, staging)

    def abort(self, messages: list[Written | None]) -> None:
        files, _, staging = self._staging()
        self._clear(files, staging)

    def _clear(self, files: fs.FileSystem, staging: str) -> None:
        if files.get_file_info(staging).type == fs.FileType.Directory:
            files.delete_dir(staging)


def write_records(df: DataFrame, path: str, name: str, copies: str | None = None, mode: str = "overwrite") -> None:
    """Each row as ``run-*/part-*/<name>.json`` below ``path``, and the files of its ``copies`` beside it, paths rewritten.

    Nothing is seen before all tasks have ended: they write aside, then each one's folder is moved. Names
    that repeat within a task get a number; a failing copy fails the write, which leaves what was there.
    """
    df.sparkSession.dataSource.register(RecordSink)
    out = df.write.format(RecordSink.name()).mode(mode).option("path", path).option("name", name)
    (out.option("copies", copies) if copies else out).save()
