"""Spark's data sink "codeloom-text": sorted rows of text as one file. Tasks write pieces; the commit joins them in order, a
block at a time, so neither holds the text. The folder of the file has to be one that driver and executors share."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType


@dataclass
class Piece(WriterCommitMessage):
    partition: int
    path: str
    rows: int


class TextSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "codeloom-text"

    def schema(self) -> str:
        return "text string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return TextWriter(self.options)


class TextWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.file = Path(options["path"])
        self.head, self.separator, self.tail, self.empty = (options[k][1:] for k in ("head", "separator", "tail", "empty"))
        self.pieces = self.file.parent / f".{self.file.name}-{options['run']}"
        self.pieces.mkdir(exist_ok=True)  # on the driver only: tasks that go on after an abort must not make it anew

    def write(self, iterator: Iterator[Row]) -> Piece:
        partition, rows = TaskContext.get().partitionId(), 0
        path = self.pieces / f"{partition:08d}-{uuid.uuid4().hex}"  # an attempt's own
        with path.open("w", encoding="utf-8", newline="") as out:
            for row in iterator:
                out.write((self.separator if rows else "") + (row.text or ""))
                rows += 1
        return Piece(partition, str(path), rows)

    def commit(self, messages: list[Piece | None]) -> None:
        found = sorted((m for m in messages if m and m.rows), key=lambda m: m.partition)
        self.pieces.mkdir(exist_ok=True)
        whole = self.pieces / "whole"
        with whole.open("wb") as out:
            for nth, piece in enumerate(found):
                out.write((self.separator if nth else self.head).encode())
                with open(piece.path, "rb") as part:
                    shutil.copyfileobj(part, out)
            out.write((self.tail if found else self.empty).encode())
        os.replace(whole, self.file)
        shutil.rmtree(self.pieces)

    def abort(self, messages: list[Piece | None]) -> None:
        shutil.rmtree(self.pieces, ignore_errors=True)


def save_text(rows: DataFrame, path: str, head: str = "", separator: str = "\n", tail: str = "", empty: str = "") -> None:
    """rows (text; null is as empty), in their order, as a file: between head and tail, with separators; `empty` if there
    are no rows."""
    rows.sparkSession.dataSource.register(TextSink)
    around = {"head": head, "separator": separator, "tail": tail, "empty": empty}
    # options can't be empty, so each has a mark before it
    options = {k: f"|{v}" for k, v in around.items()} | {"path": os.path.abspath(path), "run": uuid.uuid4().hex}
    rows.select("text").write.format("codeloom-text").mode("overwrite").options(**options).save()
