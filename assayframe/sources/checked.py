"""Data sources of the library's own: Parquet with ordinals and type checks, and JSON Lines whose ledger comes from the write itself.

Register them with :func:`register`. Files are reached through Arrow's file systems, so a path is a local one or a URI that Arrow knows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..operators.identity import canonical_json
from .jsonl import COMPLETE, DATA, LEDGER

#: Rows of a batch, each of which is checked before any of its rows goes on.
BATCH_ROWS = 8192


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def files_below(path: str, suffix: str = "") -> list[str]:
    """Files of a path in the order of their names; those that begin with ``_`` or ``.`` aside."""
    system, at = open_path(path)
    if system.get_file_info(at).type == fs.FileType.File:
        return [at]
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(suffix) and not f.base_name.startswith(("_", ".")))


@dataclass
class RowGroup(InputPartition):
    file: str
    group: int
    ordinal: int


class CheckedParquet(DataSource):
    """``checked_parquet``: the columns that option ``columns`` declares (the JSON of a schema; what may be null counts), with ``file``, ``ordinal`` and ``faults``.

    ``ordinal`` numbers the rows of all files from 0, files by name; it is the data's, so no partitioning changes it. ``faults`` names for each row the columns that its
    file lacks or holds in another type, which are then null, and nulls where none may be. The driver reads footers only; a partition is a row group.
    """

    @classmethod
    def name(cls) -> str:
        return "checked_parquet"

    def declared(self) -> StructType:
        return StructType.fromJson(json.loads(self.options["columns"]))

    def schema(self) -> StructType:
        own = [StructField("file", StringType()), StructField("ordinal", LongType()), StructField("faults", ArrayType(StringType()))]
        return StructType(own + [StructField(f.name, f.dataType) for f in self.declared()])

    def reader(self, schema: StructType) -> DataSourceReader:
        return CheckedReader(self.options["path"], self.declared(), schema)


class CheckedReader(DataSourceReader):
    def __init__(self, path: str, declared: StructType, schema: StructType):
        self.path, self.declared, self.out = path, declared, schema

    def partitions(self) -> list[RowGroup]:
        system, out, ordinal = open_path(self.path)[0], [], 0
        for file in files_below(self.path, ".parquet"):
            footer = pq.read_metadata(file, filesystem=system)
            for group in range(footer.num_row_groups):
                out.append(RowGroup(file, group, ordinal))
                ordinal += footer.row_group(group).num_rows
        return out or [RowGroup("", 0, 0)]

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        system, ordinal = open_path(self.path)[0], partition.ordinal
        kinds = to_arrow_schema(self.out)
        with system.open_input_file(partition.file) as source:
            held = pq.ParquetFile(source)
            names = [f.name for f in self.declared if f.name in held.schema_arrow.names]
            for batch in held.iter_batches(BATCH_ROWS, row_groups=[partition.group], columns=names):
                yield self._checked(batch, partition.file, ordinal, kinds)
                ordinal += len(batch)

    def _checked(self, batch: pa.RecordBatch, file: str, ordinal: int, kinds: pa.Schema) -> pa.RecordBatch:
        n, columns, always, sometimes = len(batch), [], [], []
        for f in self.declared:
            kind = kinds.field(f.name).type
            if f.name not in batch.schema.names:
                always.append(f"{f.name}: missing")
                columns.append(pa.nulls(n, kind))
                continue
            column = batch.column(f.name)
            if column.type != kind and not (pa.types.is_large_string(column.type) and pa.types.is_string(kind)):
                always.append(f"{f.name}: {column.type} for {kind}")
                columns.append(pa.nulls(n, kind))
                continue
            columns.append(column.cast(kind))
            if not f.nullable and column.null_count:
                sometimes.append((f"{f.name}: null", pc.is_null(column).to_pylist()))
        faults = [always + [name for name, at in sometimes if at[i]] for i in range(n)]
        head = [pa.array([file] * n, pa.string()), pa.array(range(ordinal, ordinal + n), pa.int64()), pa.array(faults, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(head + columns, schema=kinds)


@dataclass
class Written(WriterCommitMessage):
    file: str
    bytes: int
    sha256: str


class LedgerLines(DataSource):
    """``ledger_lines``: a table with one string column as lines below option ``path``, in a file for each task.

    A task's commit message holds the bytes and the digest of what it wrote. The driver writes the ledger from the messages, then the marker; a task that fails
    leaves a file under a name that no reader takes, what others had finished is removed, and what ends later goes with the next publication.
    """

    @classmethod
    def name(cls) -> str:
        return "ledger_lines"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if len(schema) != 1 or not isinstance(schema[0].dataType, StringType):
            raise ValueError("ledger_lines takes one column of lines")
        return LedgerWriter(self.options["path"])


class LedgerWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> Written:
        system, root = open_path(self.path)
        system.create_dir(f"{root}/{DATA}")
        name = f"part-{uuid.uuid4().hex}.txt"
        digest, size = sha256(), 0
        with system.open_output_stream(f"{root}/{DATA}/_{name}") as out:
            for row in iterator:
                line = (row[0] + "\n").encode()
                digest.update(line)
                size += len(line)
                out.write(line)
        system.move(f"{root}/{DATA}/_{name}", f"{root}/{DATA}/{name}")
        return Written(name, size, digest.hexdigest())

    def commit(self, messages: list[Written | None]) -> None:
        system, root = open_path(self.path)
        listed = sorted((m.file, m.bytes, m.sha256) for m in messages if m is not None)
        for file in files_below(self.path if ":/" in self.path else f"{root}/{DATA}"):
            if f"/{DATA}/" in file and file.rsplit("/", 1)[1] not in {f for f, _, _ in listed}:
                system.delete_file(file)  # of an attempt that came too late
        ledger = "".join(json.dumps(dict(zip(("file", "bytes", "sha256"), m, strict=True))) + "\n" for m in listed)
        told = sha256("\n".join("|".join(map(str, m)) for m in listed).encode()).hexdigest()
        for part, file, text in ((LEDGER, "part-0.json", ledger), (COMPLETE, "part-0.json", json.dumps({"ledger_sha256": told}) + "\n"), (COMPLETE, "_SUCCESS", "")):
            system.create_dir(f"{root}/{part}")
            with system.open_output_stream(f"{root}/{part}/{file}") as out:
                out.write(text.encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, root = open_path(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{root}/{DATA}/{m.file}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CheckedParquet)
    spark.dataSource.register(LedgerLines)


def typed(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Rows of Parquet files with ``file``, ``ordinal`` and ``faults``; ``columns`` declares names and types (DDL)."""
    register(spark)
    return spark.read.format("checked_parquet").option("path", path).option("columns", StructType.fromDDL(columns).json()).load()


def publish_once(df: DataFrame, path: str, order: list[str]) -> None:
    """Canonical JSON Lines with ledger and marker, as ``jsonl.published`` reads them, in one pass over ``df``."""
    spark = df.sparkSession
    register(spark)
    lines = canonical_json(df, "_json").orderBy(*order).select("_json")
    lines.write.format("ledger_lines").mode("append").option("path", path).save()
