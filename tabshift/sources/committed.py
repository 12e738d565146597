"""Files with given names, and one document from many tasks: visible whole or not at all.

Both are Python data sources. Tasks write below a staging folder of their own and report what they wrote; the driver then moves the
reported files to their places, writes a manifest last, and removes the staging folder. A failed job moves nothing; what a lost,
repeated or speculative task left is never moved (a task that is still being killed may leave it in the staging folder, whose name
begins with an underscore, so that Spark's readers pass it over). The driver handles names and sizes alone, no contents.

A document's lines come from the partitions of an ordered table. A task writes its lines with the separator between them; which
parts have lines is known only at the end, so head, separators and tail are small files of their own between the parts, and the
files of a document's folder, in order of their names, are its text. Names are numbers, so that ``cat folder/0*`` or a store's own
concatenation gives it.

Defined results: null texts are empty; two rows of one name fail the job; a document without lines is its head and tail.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def opened(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(root) if re.match(r"\w+:", root) else (pyarrow.fs.LocalFileSystem(), root)


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: (name, staged file, bytes) of each file, or of its part with the number of the partition as name."""

    files: list[tuple[str, str, int]] = field(default_factory=list)


class _Staged(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.root, self.key = options["path"].rstrip("/"), options["key"]
        self.staging = f"_staging-{self.key}"
        self.options = options

    def _mine(self) -> tuple[pyarrow.fs.FileSystem, str]:
        store, folder = opened(self.root)
        mine = f"{folder}/{self.staging}/{uuid.uuid4().hex}"
        store.create_dir(mine, recursive=True)
        return store, mine

    def _settle(self, moves: list[tuple[str, str, int]]) -> None:
        """Move staged files to their names, then say so in the manifest."""
        store, folder = opened(self.root)
        store.create_dir(folder, recursive=True)
        for name, staged, _ in moves:
            if "/" in name:
                store.create_dir(f"{folder}/{name}".rpartition("/")[0], recursive=True)
            store.move(staged, f"{folder}/{name}")
        store.create_dir(f"{folder}/_committed", recursive=True)
        with store.open_output_stream(f"{folder}/_committed/{self.key}.json") as out:
            out.write("".join(json.dumps({"name": name, "bytes": size}) + "\n" for name, _, size in moves).encode())
        self._clear()

    def _clear(self) -> None:
        store, folder = opened(self.root)
        if store.get_file_info(f"{folder}/{self.staging}").type != pyarrow.fs.FileType.NotFound:
            store.delete_dir(f"{folder}/{self.staging}")

    def abort(self, messages: list) -> None:
        self._clear()


class FilesWriter(_Staged):
    """Rows (name, text): each is a file."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, mine = self._mine()
        done = Written()
        for batch in iterator:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data, staged = (text or "").encode(), f"{mine}/{len(done.files)}"
                with store.open_output_stream(staged) as out:
                    out.write(data)
                done.files.append((name, staged, len(data)))
        return done

    def commit(self, messages: list) -> None:
        moves = sorted(f for m in messages if m for f in m.files)
        twice = [a[0] for a, b in zip(moves, moves[1:], strict=False) if a[0] == b[0]]
        if twice:
            self._clear()
            raise ValueError(f"several rows are named {twice[:5]}")
        self._settle(moves)


class DocumentWriter(_Staged):
    """Rows (line) in the order of partitions: all are one document."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, mine = self._mine()
        between, size, staged = self.options["between"].encode(), 0, f"{mine}/part"
        with store.open_output_stream(staged) as out:
            first = True
            for batch in iterator:
                for line in batch.column(0).to_pylist():
                    data = (b"" if first else between) + (line or "").encode()
                    out.write(data)
                    size, first = size + len(data), False
        return Written([] if first else [(f"{TaskContext.get().partitionId():06d}", staged, size)])

    def commit(self, messages: list) -> None:
        parts = sorted(f for m in messages if m for f in m.files)
        store, mine = self._mine()
        texts = [self.options["head"], *[self.options["between"]] * (len(parts) - 1), self.options["tail"]]
        moves = []
        for i, text in enumerate(texts if parts else [self.options["head"] + self.options["tail"]]):
            data, staged = text.encode(), f"{mine}/{i}"
            with store.open_output_stream(staged) as out:
                out.write(data)
            moves.append((f"{2 * i:07d}", staged, len(data)))
        moves += [(f"{2 * i + 1:07d}", staged, size) for i, (_, staged, size) in enumerate(parts)]
        self._settle(sorted(moves))


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(dict(self.options))


class OneDocument(DataSource):
    @classmethod
    def name(cls) -> str:
        return "one_document"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(dict(self.options))


def _save(rows: DataFrame, source: type[DataSource], root: str, **options: str) -> DataFrame:
    spark, key = rows.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(source)
    rows.write.format(source.name()).mode("append").options(path=root, key=key, **options).save()
    return spark.read.schema("name string, bytes long").json(f"{root.rstrip('/')}/_committed/{key}.json")


def write_named_files(files: DataFrame, root: str, name: str = "name", text: str = "text") -> DataFrame:
    """Write each row's text as the file root/name, all or none; (name, bytes) of the files. ``root`` is a folder that all executors see."""
    return _save(files.select(F.col(name).alias("name"), F.col(text).alias("text")), NamedFiles, root)


def write_document(lines: DataFrame, root: str, order: str, line: str = "line", *, head: str = "", between: str = "\n", tail: str = "\n") -> DataFrame:
    """Write lines in order as one document in the folder ``root``; (name, bytes) of its files, whose order by name is the document's."""
    ordered = lines.select(F.col(order).alias("o"), F.col(line).alias("line")).orderBy("o").select("line")
    return _save(ordered, OneDocument, root, head=head, between=between, tail=tail)


def document_files(spark: SparkSession, root: str) -> list[str]:
    """The files of a document, in order."""
    store, folder = opened(root)
    names = sorted(f.base_name for f in store.get_file_info(pyarrow.fs.FileSelector(folder)) if f.is_file and f.base_name.isdigit())
    return [f"{root.rstrip('/')}/{n}" for n in names]


def read_document(spark: SparkSession, root: str) -> str:
    """The whole text of a small document."""
    store, folder = opened(root)
    return b"".join(store.open_input_stream(f"{folder}/{f.rpartition('/')[2]}").read() for f in document_files(spark, root)).decode()
