"""A sink that writes one file for each row, folder/name.json, and what reads such files in the tasks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Names of a folder that are passed on at once, and characters of texts that a task has at a time.
LISTED, READ_CHARS = 10_000, 8 << 20


@dataclass
class Written(WriterCommitMessage):
    """How many files a task wrote. Names stay in the tasks, so nothing of the data's size comes to the driver."""

    files: int


class EntityFiles(DataSource):
    """Rows of folder, name and json. Options: path."""

    @classmethod
    def name(cls) -> str:
        return "entity_files"

    def schema(self) -> str:
        return "folder string, name string, json string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return EntityWriter(self.options["path"])


def files_at(path: str):
    """pyarrow's file system of path, and the path in it."""
    from pyarrow import fs

    path = re.sub("^file:/+", "/", path.rstrip("/"))  # Hadoop writes local addresses with one slash or three
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def lister(path: str):
    """A function for mapInArrow: folder, name of the files of each folder (first column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = files_at(path)
        for folder in (x for b in batches for x in b.column(0).to_pylist()):
            names = [x.base_name[: -len(".json")] for x in files.get_file_info(fs.FileSelector(f"{root}/{folder}", allow_not_found=True)) if x.type == fs.FileType.File and x.base_name.endswith(".json")]
            for i in range(0, len(names), LISTED):
                some = names[i : i + LISTED]
                yield pa.RecordBatch.from_arrays([pa.array([folder] * len(some), pa.string()), pa.array(some, pa.string())], ["folder", "name"])

    return run


def reader(path: str):
    """A function for mapInArrow: folder, name, json of the files that folder and name give, some megabytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = files_at(path)
        for b in batches:
            done, texts, size = [], [], 0
            for folder, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with files.open_input_stream(f"{root}/{folder}/{name}.json") as f:
                    text = f.readall().decode("utf-8", "replace")
                done.append((folder, name))
                texts.append(text)
                size += len(text)
                if size > READ_CHARS:
                    yield _texts(done, texts)
                    done, texts, size = [], [], 0
            yield _texts(done, texts)

    return run


def _texts(done: list[tuple[str, str]], texts: list[str]) -> pa.RecordBatch:
    columns = [[f for f, _ in done], [n for _, n in done], texts]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["folder", "name", "json"])


class EntityWriter(DataSourceWriter):
    """Two phases for each file: a task writes it under a name of its own in a hidden folder and then moves it to its place, which replaces what stands there. A
    repeated task thus gives the same files again, and a lost one leaves no half files outside the hidden folder, which goes when the job ends either way."""

    def __init__(self, path: str) -> None:
        self.path, self.staging = path, f"_staging-{uuid.uuid4().hex}"

    def _files(self):
        return files_at(self.path)

    def write(self, rows: Iterator[Row]) -> Written:
        files, root = self._files()
        own, made, n = f"{root}/{self.staging}/{uuid.uuid4().hex}", set(), 0
        files.create_dir(own)
        for r in rows:
            if r.folder not in made:
                files.create_dir(f"{root}/{r.folder}")
                made.add(r.folder)
            with files.open_output_stream(f"{own}/{n}") as out:
                out.write(r.json.encode("utf-8", "surrogatepass"))
            files.move(f"{own}/{n}", f"{root}/{r.folder}/{r.name}.json")
            n += 1
        return Written(n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        files, root = self._files()
        if files.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/{self.staging}")
