"""Members of zip archives as rows, read where the archives lie: a partition a member, lines streamed out of it."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from fnmatch import fnmatch
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from pluvia.sources.paths import created, listed, opened

#: Lines of a record batch.
_LINES = 8192


class Member(InputPartition):
    def __init__(self, archive: str, name: str, size: int):
        super().__init__((archive, name))
        self.archive, self.name, self.size = archive, name, size


class Archives(DataSource):
    """options: path (a zip file or a folder of them); pattern (of members' names, * by default); list ("true": archive, member, size alone).
    Else archive, member, line (from 0) and text of every line, without its end."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, member string, size long" if self.options.get("list") == "true" else "archive string, member string, line long, text string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(dict(self.options))


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Member]:
        """From the archives' directories, which stand at their ends: members aren't read."""
        out = []
        for path in listed(self.options["path"]):
            with opened(path) as stream, zipfile.ZipFile(stream) as z:
                out += [Member(path, m.filename, m.file_size) for m in z.infolist() if not m.is_dir() and fnmatch(m.filename, self.options.get("pattern", "*"))]
        return out

    def read(self, part: Member | None) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        if self.options.get("list") == "true":
            yield pa.RecordBatch.from_arrays([pa.array([part.archive]), pa.array([part.name]), pa.array([part.size], pa.int64())], ["archive", "member", "size"])
            return
        with opened(part.archive) as stream, zipfile.ZipFile(stream) as z, z.open(part.name) as raw:
            lines, at = [], 0
            for text in io.TextIOWrapper(raw, "utf-8-sig", "replace"):
                lines.append(text.rstrip("\n"))
                if len(lines) == _LINES:
                    yield self._batch(part, at, lines)
                    at, lines = at + len(lines), []
            if lines:
                yield self._batch(part, at, lines)

    @staticmethod
    def _batch(part: Member, at: int, lines: list[str]) -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_arrays([pa.array([part.archive] * n), pa.array([part.name] * n), pa.array(range(at, at + n), pa.int64()), pa.array(lines, pa.string())], ["archive", "member", "line", "text"])


def packed(rows: DataFrame, header: str, beside: dict[str, str]) -> None:
    """Writes zip archives from archive (its path), member, text (a line): a header stands first in each member, the members `beside` last in each archive.

    A task takes whole archives, and their rows stream from a sort into them, so it holds a batch of lines.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = name = out = z = member = None

        def close() -> None:
            if z is not None:
                member.close()
                for n, text in beside.items():
                    z.writestr(n, text)
                z.close()
                out.close()

        for b in batches:
            for (to, inside), lines in groupby(zip(*(b.column(c).to_pylist() for c in ("archive", "member", "text"))), lambda r: r[:2]):
                if to != path:
                    close()
                    path, name, out = to, None, created(to)
                    z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                if inside != name:
                    if name is not None:
                        member.close()
                    name, member = inside, z.open(inside, "w", force_zip64=True)
                    member.write(f"{header}\n".encode())
                member.write("".join(f"{text}\n" for _, _, text in lines).encode())
        close()
        yield pa.RecordBatch.from_arrays([pa.array([0 if path is None else 1], pa.int64())], ["n"])

    rows.repartition("archive").sortWithinPartitions("archive", "member").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def members(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """archive, member, size (in bytes, unpacked)."""
    spark.dataSource.register(Archives)
    return spark.read.format("zip_members").options(path=path, pattern=pattern, list="true").load()


def lines(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """archive, member, line, text of the members' lines."""
    spark.dataSource.register(Archives)
    return spark.read.format("zip_members").options(path=path, pattern=pattern).load()


def csv(spark: SparkSession, path: str, schema: StructType | str, pattern: str = "*.csv") -> DataFrame:
    """Rows of members that are CSV with a header in the order of schema, with archive and member beside them."""
    kind = schema if isinstance(schema, str) else schema.simpleString()[7:-1].replace(":", " ")
    rows = lines(spark, path, pattern).where("line > 0 AND text != ''")
    return rows.select("archive", "member", F.from_csv("text", kind, {"mode": "PERMISSIVE"}).alias("r")).select("archive", "member", "r.*")
