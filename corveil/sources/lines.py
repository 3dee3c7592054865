"""JSON lines by a column as a Spark data source: tasks stage their files, and only the commit moves them into place."""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Fixed value: the folder of rows without a value, as Spark's readers know it.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


@dataclass
class Staged(WriterCommitMessage):
    """What a task has staged: (folder, name, rows) of each file."""

    attempt: str
    files: list[tuple[str, str, int]]


def plain(value: object) -> str:
    return base64.b64encode(value).decode() if isinstance(value, (bytes, bytearray)) else str(value)


class Target:
    """A folder of JSON lines, `by=value/part-....json`, and the hidden folder in which tasks stage their files.

    The path may name any store that pyarrow opens; every machine has to reach it. A failed or repeated attempt leaves
    files in the staging folder only, which readers pass over and the commit and the abort remove. What a straggler
    stages after an abort goes with the next commit that doesn't append.
    """

    def __init__(self, options: dict[str, str], staging: str = "") -> None:
        self.path, self.by = options["path"].rstrip("/"), options["by"]
        self.staging = f"_staging-{staging or uuid.uuid4().hex}"

    def store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def present(self) -> list[fs.FileInfo]:
        """What the folder holds, without hidden files."""
        store, root = self.store()
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return [f for f in found if not f.base_name.startswith(("_", "."))]

    def stage(self, rows: Iterable[dict]) -> Staged:
        """Writes a task's rows; one file is open at a time, so rows should come sorted by the column."""
        store, root = self.store()
        partition, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        files: list[tuple[str, str, int]] = []
        out, last, n = None, None, 0
        try:
            for row in rows:
                value = row.pop(self.by)
                folder = f"{self.by}={NO_VALUE if value is None else quote(str(value), safe=' ')}"
                if out is None or folder != last:
                    if out is not None:
                        out.close()
                        files[-1] = (*files[-1][:2], n)
                    last, n = folder, 0
                    files.append((folder, f"part-{partition:05d}-{len(files)}.json", 0))
                    store.create_dir(f"{root}/{self.staging}/{attempt}/{folder}")
                    out = store.open_output_stream(f"{root}/{self.staging}/{attempt}/{folder}/{files[-1][1]}")
                out.write((json.dumps(row, ensure_ascii=False, default=plain) + "\n").encode())
                n += 1
        finally:
            if out is not None:
                out.close()
        if files:
            files[-1] = (*files[-1][:2], n)
        return Staged(attempt, files)

    def publish(self, messages: list[Staged | None], overwrite: bool, prefix: str = "", alone: bool = False) -> None:
        """Moves the files of the attempts that count into place and notes the rows of each folder."""
        store, root = self.store()
        if overwrite:
            for f in self.present():
                (store.delete_dir if f.type == fs.FileType.Directory else store.delete_file)(f.path)
        store.create_dir(root)
        counts: dict[str, int] = {}
        for message in messages:
            for folder, name, n in message.files if message else ():
                counts[folder] = counts.get(folder, 0) + n
                store.create_dir(f"{root}/{folder}")
                store.move(f"{root}/{self.staging}/{message.attempt}/{folder}/{name}", f"{root}/{folder}/{prefix}{name}")
        with store.open_output_stream(f"{root}/_counts.json") as out:
            out.write(json.dumps(counts, sort_keys=True).encode())
        self.discard(alone)

    def discard(self, alone: bool = False) -> None:
        """Removes the staging folder; a writer that has the target alone removes those of others too."""
        store, root = self.store()
        for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if f.base_name == self.staging or alone and f.base_name.startswith("_staging-"):
                store.delete_dir(f.path)


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, target: Target, overwrite: bool, append: bool) -> None:
        self.target, self.overwrite, self.append = target, overwrite, append

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return self.target.stage(row for batch in iterator for row in batch.to_pylist())

    def commit(self, messages: list[Staged | None]) -> None:
        self.target.publish(messages, self.overwrite, alone=not self.append)

    def abort(self, messages: list[Staged | None]) -> None:
        self.target.discard()


class StreamWriter(DataSourceStreamWriter):
    """One stream a target: a micro-batch that is repeated after a failure writes the same names again."""

    def __init__(self, target: Target) -> None:
        self.target = target

    def write(self, iterator: Iterator[Row]) -> Staged:
        return self.target.stage(row.asDict(recursive=True) for row in iterator)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803 - Spark's name
        self.target.publish(messages, False, f"step-{batchId:06d}-")

    def abort(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803 - Spark's name
        self.target.discard()


class Lines(DataSource):
    """Options: path, the column `by` whose values name the folders, and append (else an existing target is an error)."""

    @classmethod
    def name(cls) -> str:
        return "lines_by"

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        target = Target(dict(self.options))
        append = not overwrite and self.options.get("append", "false") == "true"
        if not overwrite and not append and target.present():
            raise FileExistsError(f"{target.path} exists and holds files")
        return BatchWriter(target, overwrite, append)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:  # noqa: N802 - Spark's name
        return StreamWriter(Target(dict(self.options), "stream"))


def write_lines(df: DataFrame, path: str, by: str, mode: str = "errorifexists") -> dict[str, int]:
    """Writes df as JSON lines in a folder a value of `by`; the rows of each folder, as the commit counted them."""
    df.sparkSession.dataSource.register(Lines)
    out = df.sortWithinPartitions(by).write.format("lines_by").options(path=path, by=by, append=str(mode == "append").lower())
    out.mode("overwrite" if mode == "overwrite" else "append").save()
    store, root = Target({"path": path, "by": by}).store()
    with store.open_input_stream(f"{root}/_counts.json") as f:
        return json.loads(f.read())
