"""Data source ``epochs``: a table of committed epochs, written by streams and read by batches and streams.

A task writes its rows as a Parquet file of a name of its own; the driver then lists an epoch's files in a manifest, which makes them
part of the table. So rows of an aborted epoch are never seen and its files are deleted, and an epoch that is sent again,
as after a lost checkpoint, changes nothing. A stream reads epoch by epoch; its offset is the number of the next epoch. Paths may be
of any file system that pyarrow knows.

    spark.dataSource.register(EpochSource)
    stream.writeStream.format("epochs").option("path", path).option("checkpointLocation", checkpoint).start()
    spark.readStream.format("epochs").schema(schema).load(path)
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


class Table:
    """Files and manifests below a path."""

    def __init__(self, path: str):
        where = path if "://" in path or path.startswith("file:") else f"file://{path}"
        self.files, self.root = fs.FileSystem.from_uri(where)

    def add_file(self, batches: Iterator[pa.RecordBatch]) -> str | None:
        """The name of a new file with the rows; none without rows. A task that fails leaves no file."""
        name, writer, out = f"{uuid.uuid4().hex}.parquet", None, None
        try:
            for batch in batches:
                if batch.num_rows and writer is None:
                    self.files.create_dir(f"{self.root}/data", recursive=True)
                    out = self.files.open_output_stream(f"{self.root}/data/{name}")
                    writer = pq.ParquetWriter(out, batch.schema)
                if batch.num_rows:
                    writer.write_batch(batch)
            if writer is None:
                return None
            writer.close()
            out.close()
        except BaseException:
            if out is not None:
                writer.close()
                out.close()
                self.delete_file(name)
            raise
        return name

    def delete_file(self, name: str) -> None:
        self.files.delete_file(f"{self.root}/data/{name}")

    def epochs(self) -> list[int]:
        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/manifests", allow_not_found=True))
        return sorted(int(x.base_name.removesuffix(".json")) for x in found if x.base_name.endswith(".json"))

    def listed(self, epoch: int) -> list[str]:
        with self.files.open_input_stream(f"{self.root}/manifests/{epoch}.json") as held:
            return json.loads(held.read())

    def commit(self, epoch: int, names: list[str]) -> None:
        """The manifest appears whole, by a rename."""
        self.files.create_dir(f"{self.root}/manifests", recursive=True)
        draft = f"{self.root}/manifests/{epoch}.{uuid.uuid4().hex}"
        with self.files.open_output_stream(draft) as out:
            out.write(json.dumps(names).encode())
        self.files.move(draft, f"{self.root}/manifests/{epoch}.json")

    def read(self, name: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        with self.files.open_input_file(f"{self.root}/data/{name}") as held:
            for batch in pq.ParquetFile(held).iter_batches(columns=schema.names):
                yield batch.cast(schema)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class EpochWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return Written(Table(self.path).add_file(iterator))

    def commit(self, messages: list, batchId: int) -> None:
        table, names = Table(self.path), [m.name for m in messages if m and m.name]
        if batchId in table.epochs():  # sent again
            self.abort(messages, batchId)
        else:
            table.commit(batchId, names)

    def abort(self, messages: list, batchId: int) -> None:
        table = Table(self.path)
        for m in messages:
            if m and m.name:
                table.delete_file(m.name)


@dataclass
class OneFile(InputPartition):
    name: str


class _Files:
    """Reads the file of a partition; shared by both readers."""

    def __init__(self, path: str, schema: StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.path, self.schema = path, to_arrow_schema(schema)

    def files(self, start: int, end: int | None = None) -> list[OneFile]:
        table = Table(self.path)
        return [OneFile(name) for epoch in table.epochs() if epoch >= start and (end is None or epoch < end) for name in table.listed(epoch)]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        return Table(self.path).read(partition.name, self.schema)


class EpochReader(_Files, DataSourceReader):
    def partitions(self) -> list[OneFile]:
        return self.files(0) or [OneFile("")]  # a table without epochs

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        return super().read(partition) if partition.name else iter(())


class EpochStream(_Files, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"epoch": 0}

    def latestOffset(self) -> dict:
        return {"epoch": max(Table(self.path).epochs(), default=-1) + 1}

    def partitions(self, start: dict, end: dict) -> list[OneFile]:
        return self.files(start["epoch"], end["epoch"])

    def commit(self, end: dict) -> None:
        """Nothing is kept for a reader."""


class EpochSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "epochs"

    def schema(self) -> str:
        raise ValueError("the schema of a table of epochs is given by its reader")

    def reader(self, schema: StructType) -> EpochReader:
        return EpochReader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> EpochStream:
        return EpochStream(self.options["path"], schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> EpochWriter:
        return EpochWriter(self.options["path"])
