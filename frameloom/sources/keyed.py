"""JSON under keys: a file for each row, or one object of all rows, by a Python data source whose commit makes files visible whole.

Tasks write into a folder of their own beside the target, and the driver moves what the tasks that count have written. A killed
task, a second attempt or a failed job leaves nothing in the target. Any store that pyarrow knows can be the target.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

INDENT = 2
COPY_BYTES = 4 << 20


def _store(path: str) -> tuple[Any, str]:
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    return store, at.rstrip("/")


def shown(value: Any) -> str:
    return json.dumps(value, indent=INDENT)


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    first: str | None = None
    rows: int = 0


@dataclass
class _Options:
    path: str
    key: str
    json_columns: list[str]
    end: str
    whole: bool

    @staticmethod
    def of(options: dict[str, str]) -> _Options:
        return _Options(options["path"], options.get("key", "id"), [c for c in options.get("json", "").split(",") if c], "\n" if options.get("newline") == "true" else "", options.get("layout", "files") == "object")

    def value(self, row: Row) -> tuple[str, Any]:
        """(key, what is written): all columns, or with the layout object the one column `value`, if that is all there is beside the key."""
        fields = row.asDict(recursive=True)
        for c in self.json_columns:
            fields[c] = None if fields[c] is None else json.loads(fields[c])
        key = fields[self.key]
        if not isinstance(key, str) or not key or "/" in key or "\0" in key or key.startswith("."):
            raise ValueError(f"{key!r} can't be a file's name or a key")
        return key, fields["value"] if self.whole and fields.keys() == {self.key, "value"} else fields


class KeyedWriter(DataSourceWriter):
    def __init__(self, options: _Options):
        self.given = options
        target = options.path.rstrip("/")
        self.staging = f"{target.rpartition('/')[0]}/.staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, at = _store(f"{self.staging}/{uuid.uuid4().hex}")
        store.create_dir(at, recursive=True)
        done = _Written(at)
        if self.given.whole:
            with store.open_output_stream(f"{at}/part") as out:
                for row in iterator:
                    key, value = self.given.value(row)
                    lines = shown({key: value})[2:-2]  # between the braces, indented as within an object
                    out.write((("," if done.rows else "") + "\n" + lines).encode())
                    done.first, done.rows = done.first if done.rows else key, done.rows + 1
        else:
            for row in iterator:
                key, value = self.given.value(row)
                with store.open_output_stream(f"{at}/{key}.json") as out:
                    out.write((shown(value) + self.given.end).encode())
                done.rows += 1
        return done

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        store, target = _store(self.given.path)
        parts = [m for m in messages if m is not None and m.rows]
        if self.given.whole:
            _, at = _store(f"{self.staging}/whole")
            store.create_dir(at.rpartition("/")[0], recursive=True)
            with store.open_output_stream(at) as out:
                out.write(b"{")
                for n, part in enumerate(sorted(parts, key=lambda m: m.first)):
                    out.write(b"," if n else b"")
                    with store.open_input_stream(f"{part.folder}/part") as piece:
                        while block := piece.read(COPY_BYTES):
                            out.write(block)
                out.write((("\n}" if parts else "}") + self.given.end).encode())
            store.move(at, target)
        else:
            store.create_dir(target, recursive=True)
            for part in parts:
                for file in store.get_file_info(fs.FileSelector(part.folder)):
                    store.move(file.path, f"{target}/{file.base_name}")
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        store, at = _store(self.staging)
        if store.get_file_info(at).type == fs.FileType.Directory:
            store.delete_dir(at)


class KeyedJson(DataSource):
    """format("keyed_json"), options path, key, layout (files or object), json (columns that hold JSON), newline (true: at a file's end)."""

    @classmethod
    def name(cls) -> str:
        return "keyed_json"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return KeyedWriter(_Options.of(self.options))


def _write(df: DataFrame, path: str, **options: str) -> None:
    df.sparkSession.dataSource.register(KeyedJson)
    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"
    df.write.format("keyed_json").mode("append").options(path=uri, **options).save()


def files(df: DataFrame, path: str, key: str = "id", json_columns: tuple[str, ...] = (), newline: bool = False) -> None:
    """path/<key>.json for each row, its columns in their order; files of other keys stay. Of rows with one key one is written.

    A key that is null, empty, or no name for a file ends the write, and nothing is written. An empty table writes nothing.
    """
    _write(df.dropDuplicates([key]), path, key=key, json=",".join(json_columns), newline=str(newline).lower())


def one_object(df: DataFrame, path: str, key: str = "id", json_columns: tuple[str, ...] = (), newline: bool = False) -> None:
    """One file: an object of all rows under their keys, in the order of the keys; a table (key, value) gives the values alone.

    Tasks write runs of keys, which the driver joins by blocks of bytes: rows never pass through it. Of rows with one key one is written.
    An empty table gives `{}`.
    """
    ordered = df.dropDuplicates([key]).repartitionByRange(F.col(key)).sortWithinPartitions(key)
    _write(ordered, path, key=key, layout="object", json=",".join(json_columns), newline=str(newline).lower())
