"""A streaming source over payloads that polls land in a folder, with offsets: a query that stops goes on behind what it has committed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Lines of a record batch, and bytes of the files that one task reads (a larger file is one task's).
_LINES, TASK_BYTES = 1024, 64 << 20


class Files(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(tuple(names))
        self.names = names


class Payloads(DataSource):
    """option path: a folder (of any file system that Arrow knows) of files with a payload a line. Files are taken in the order of their paths, so those of a later poll
    have to sort behind those of earlier ones (their names begin with the time of the poll); names that begin with _ or . are no payloads."""

    @classmethod
    def name(cls) -> str:
        return "landed_payloads"

    def schema(self) -> str:
        return "file string, payload string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PayloadStream(self.options["path"])


class PayloadStream(DataSourceStreamReader):
    """Offsets are file paths: a batch has the files behind its start, up to its end."""

    def __init__(self, path: str):
        self.path = path

    def _files(self) -> list[tuple[str, int]]:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)
        found = where.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "_.")

    def initialOffset(self) -> dict:
        return {"file": ""}

    def latestOffset(self) -> dict:
        return {"file": max((name for name, _ in self._files()), default="")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts, size = [], TASK_BYTES
        for name, n in self._files():
            if start["file"] < name <= end["file"]:
                if size + n > TASK_BYTES:
                    parts.append([])
                    size = 0
                parts[-1].append(name)
                size += n
        return [Files(p) for p in parts]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where = fs.FileSystem.from_uri(self.path)[0] if ":" in self.path else fs.LocalFileSystem()
        for name in partition.names if partition is not None else ():
            with where.open_input_stream(name) as f:
                held, lines = b"", []
                while block := f.read(1 << 20):
                    *whole, held = (held + block).split(b"\n")
                    lines += whole
                    while len(lines) >= _LINES:
                        yield _batch(name, lines[:_LINES])
                        lines = lines[_LINES:]
                lines += [held]
                yield _batch(name, lines)

    def commit(self, end: dict) -> None:
        """Nothing to free: landed files stay."""


def _batch(name: str, lines: list[bytes]) -> pa.RecordBatch:
    said = [x.decode("utf-8", "replace") for x in lines if x.strip()]
    return pa.RecordBatch.from_arrays([pa.array([name] * len(said), pa.string()), pa.array(said, pa.string())], ["file", "payload"])


def polled(spark: SparkSession, path: str, observation: StructType | str) -> DataFrame:
    """A stream with a row an observation of the payloads below path; observation: its fields. A payload without `observations` has no rows."""
    spark.dataSource.register(Payloads)
    rows = spark.readStream.format("landed_payloads").option("path", path).load()
    kind = observation if isinstance(observation, str) else observation.simpleString()[7:-1]
    read = F.from_json("payload", F.lit(f"STRUCT<observations: ARRAY<STRUCT<{kind}>>>"))
    return rows.select(F.explode(read["observations"]).alias("o")).select("o.*")
