"""Filings and engine tables as Spark data sources: spark.read.format("filings"), df.write.format("batches").

register(spark) makes both known. `filings` reads folders of metadata.json and
text.txt, of one filing each or of many (readers.filing_folders says how); its
partitions are ranges of folders, and filters on ticker, form and filed date are
applied to the metadata, so that texts of other filings are never read. `batches` writes rows as JSON lines in files of a bounded number of rows;
a file counts only once the commit has named it, so a failed or repeated task
leaves nothing behind that is read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

FILINGS = "ticker string, form string, filed date, accession string, text string"
#: Folders of a partition, and rows of a file.
FOLDERS, ROWS = 256, 1000
_FIELDS = ("ticker", "form", "filed")


def _system(path: str):
    from pyarrow import fs

    if path.startswith("file:") or path.startswith("/"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _holds(f: Filter, row: dict) -> bool:
    x = row[f.attribute[0]]
    if x is None:
        return False
    if isinstance(f, In):
        return x in f.value
    value = f.value
    tests = {EqualTo: lambda: x == value, GreaterThan: lambda: x > value, GreaterThanOrEqual: lambda: x >= value, LessThan: lambda: x < value, LessThanOrEqual: lambda: x <= value}
    return tests[type(f)]()


@dataclass
class Folders(InputPartition):
    names: list[str]


class FilingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size, self.filters = options["path"], int(options.get("folders", FOLDERS)), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 and f.attribute[0] in _FIELDS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Folders]:
        from pyarrow import fs

        system, base = _system(self.path)
        names = sorted(x.path for x in system.get_file_info(fs.FileSelector(base)) if x.type == fs.FileType.Directory)
        return [Folders(names[i : i + self.size]) for i in range(0, len(names), self.size)] or [Folders([])]

    def read(self, partition: Folders) -> Iterator[tuple]:
        system, _ = _system(self.path)
        for name in partition.names:
            try:
                with system.open_input_stream(f"{name}/metadata.json") as f:
                    told = json.loads(f.read())
            except FileNotFoundError:  # a folder of something else
                continue
            wanted = []
            for said in told if isinstance(told, list) else [told]:
                try:
                    filed = date.fromisoformat(said.get("filed") or "")
                except ValueError:
                    filed = None
                row = {"ticker": said.get("ticker"), "form": said.get("form"), "filed": filed}
                if all(_holds(f, row) for f in self.filters):
                    wanted.append((said, (*row.values(), said.get("accession"))))
            for (_, row), text in zip(wanted, _texts(system, f"{name}/text.txt", [said for said, _ in wanted])):
                yield *row, text


def _texts(system, name: str, wanted: list[dict]) -> Iterator[str | None]:
    """The texts of some filings of a folder: the file's, or their bytes of it."""
    if not wanted:
        return
    try:
        if any(said.get("start") is None for said in wanted):
            with system.open_input_stream(name) as f:
                raw = f.read()
            cut = lambda start, size: raw[start : start + size]
            yield from (_text(said, raw, cut) for said in wanted)
            return
        with system.open_input_file(name) as f:
            yield from (_text(said, None, lambda start, size: f.read_at(size, start)) for said in wanted)
    except FileNotFoundError:
        yield from [None] * len(wanted)


def _text(said: dict, whole: bytes | None, cut: Callable[[int, int], bytes]) -> str | None:
    if said.get("start") is not None and said.get("size") is None:
        return None
    return (whole if said.get("start") is None else cut(said["start"], said["size"])).decode("utf-8", "replace")


class Filings(DataSource):
    """Options: path, the folder of the filings' folders; folders, how many of them a partition has."""

    @classmethod
    def name(cls) -> str:
        return "filings"

    def schema(self) -> str:
        return FILINGS

    def reader(self, schema: StructType) -> FilingReader:
        return FilingReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    files: list[str] = field(default_factory=list)
    rows: int = 0


class BatchWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.size, self.overwrite = options["path"], int(options.get("rows", ROWS)), overwrite
        self.names = schema.fieldNames()

    def write(self, rows: Iterator) -> Written:
        system, base = _system(self.path)
        system.create_dir(base, recursive=True)
        out, held = Written(), []

        def flush() -> None:
            if held:
                name = f"batch-{uuid.uuid4().hex}.jsonl"
                with system.open_output_stream(f"{base}/{name}") as f:
                    f.write("".join(json.dumps(r, default=str) + "\n" for r in held).encode())
                out.files.append(name)
                out.rows += len(held)
                held.clear()

        for row in rows:
            held.append({k: v for k, v in zip(self.names, row) if v is not None and v == v})  # nulls and NaN are left out
            if len(held) == self.size:
                flush()
        flush()
        return out

    def commit(self, messages: list[Written | None]) -> None:
        system, base = _system(self.path)
        system.create_dir(base, recursive=True)
        known = [] if self.overwrite else committed(self.path)
        files = known + [x for m in messages if m for x in m.files]
        fresh = f"{base}/_manifest-{uuid.uuid4().hex}"
        with system.open_output_stream(fresh) as f:
            f.write(json.dumps(files).encode())
        system.move(fresh, f"{base}/_manifest.json")

    def abort(self, messages: list[Written | None]) -> None:
        system, base = _system(self.path)
        for m in messages:
            for x in m.files if m else []:
                system.delete_file(f"{base}/{x}")


def committed(path: str) -> list[str]:
    """The files of a batches folder that commits have named."""
    system, base = _system(path)
    try:
        with system.open_input_stream(f"{base}/_manifest.json") as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return []


@dataclass
class Files(InputPartition):
    names: list[str]


class BatchReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.names = options["path"], schema.fieldNames()

    def partitions(self) -> list[Files]:
        files = committed(self.path)
        return [Files(files[i : i + 16]) for i in range(0, len(files), 16)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, base = _system(self.path)
        for name in partition.names:
            with system.open_input_stream(f"{base}/{name}") as f:
                for line in f.read().decode().splitlines():
                    row = json.loads(line)
                    yield tuple(row.get(c) for c in self.names)


class Batches(DataSource):
    """Options: path; rows, those of a file. Read with a schema; the modes append and overwrite."""

    @classmethod
    def name(cls) -> str:
        return "batches"

    def schema(self) -> str:
        raise ValueError("batches are read with a schema")

    def reader(self, schema: StructType) -> BatchReader:
        return BatchReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Filings, Batches):
        spark.dataSource.register(source)
