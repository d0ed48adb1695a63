"""Spark's data source "codeloom": the files of a code base as rows, parsed where they are read.

    code_source(spark).load("/src")                                          path, source
    code_source(spark).schema("path string, ok boolean, comments array<struct<line:int,text:string>>").load("/src")

The schema names the facts and fields that are wanted (see functions/extract.py), and only these are made; without facts
no file is parsed, without source or facts none is opened. A partition has files of about PARTITION_BYTES.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

from ..functions.extract import FACTS, extract
from .code import python_files

PARTITION_BYTES, BATCH_FILES = 4 << 20, 64


@dataclass
class Files(InputPartition):
    paths: list[str]


class CodeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "codeloom"

    def schema(self) -> str:
        return "path string, source string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return CodeReader(self.options, schema)


class CodeReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.root, self.fields = Path(options["path"]), schema
        self.bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.tests: list[Filter] = []
        self.wanted: dict[str, set[str]] = {}
        for f in schema.fields:
            if f.name in ("path", "source", "ok"):
                continue
            if f.name not in FACTS:
                raise ValueError(f"no such fact: {f.name}")
            inner = f.dataType.elementType if isinstance(f.dataType, ArrayType) else None
            self.wanted[f.name] = set(inner.names) if isinstance(inner, StructType) else set()
            if unknown := self.wanted[f.name] - set(FACTS[f.name] if isinstance(FACTS[f.name], dict) else ()):
                raise ValueError(f"no such fields of {f.name}: {', '.join(sorted(unknown))}")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Tests of a file's path are made as files are listed; all others are Spark's."""
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)) and f.attribute == ("path",):
                self.tests.append(f)
            else:
                yield f

    def _passes(self, path: str) -> bool:
        def one(f: Filter) -> bool:
            if isinstance(f, StringStartsWith):
                return path.startswith(f.value)
            return path.endswith(f.value) if isinstance(f, StringEndsWith) else path in f.value if isinstance(f, In) else path == f.value

        return all(map(one, self.tests))

    def partitions(self) -> list[Files]:
        parts, size = [Files([])], 0
        for path in filter(self._passes, python_files(self.root)):
            try:
                own = os.path.getsize(path)
            except OSError:  # gone meanwhile, or a link to nothing: a row without source
                own = 0
            if parts[-1].paths and size + own > self.bytes:
                parts.append(Files([]))
                size = 0
            parts[-1].paths.append(path)
            size += own
        return parts

    def _row(self, path: str, opened: bool) -> dict:
        source = None
        if opened:
            try:
                source = Path(path).read_text(encoding="utf-8")
            except (OSError, UnicodeDecodeError):
                pass
        row = extract(path, source, self.wanted) if self.wanted else {"path": path, "ok": source is not None}
        return {n: source if n == "source" else row.get(n) for n in self.fields.names}

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema, opened = to_arrow_schema(self.fields), self.fields.names != ["path"]
        for at in range(0, len(partition.paths), BATCH_FILES):
            yield pa.RecordBatch.from_pylist([self._row(p, opened) for p in partition.paths[at : at + BATCH_FILES]], schema=schema)
