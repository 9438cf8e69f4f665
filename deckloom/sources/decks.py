"""Deck files as tables: a Python data source, and a binary-file plan."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from deckloom.errors import ParseError
from deckloom.functions.images import VECTOR_EXTENSIONS, image_class
from deckloom.schema import DECKS, RECORDS, SHAPES, names
from deckloom.sources.convert import convert_vector
from deckloom.sources.ooxml import _EMPTY, records
from deckloom.sources.pixels import features

_NAMES = names(RECORDS)
#: Rows of a batch that goes back to Spark.
_BATCH = 5000


@dataclass(frozen=True)
class Deck:
    """The three tables of a set of decks, and files that were no decks."""

    decks: DataFrame
    slides: DataFrame
    shapes: DataFrame
    errors: DataFrame


def parse_files(
    files: DataFrame,
    *,
    path: str = "path",
    content: str = "content",
    deck_id: Column | None = None,
    mode: str = "PERMISSIVE",
    classify: bool = False,
    keep_images: bool = True,
) -> DataFrame:
    """Records of a table of file contents, such as ``binaryFile`` gives.

    Files are parsed where they are read, without a shuffle.  ``FAILFAST``
    fails on the first file that is no deck; ``PERMISSIVE`` gives a row with
    its ``error``.  With ``classify`` images are measured and classified on
    the way, and without ``keep_images`` their bytes go no further.
    """

    schema = to_arrow_schema(StructType.fromDDL(RECORDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for key, where, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows = list(records(key, where, data or b""))
                    if classify:
                        _measure(rows)
                    if not keep_images:
                        rows = [r | {"image_bytes": None} for r in rows]
                except ParseError as e:
                    if mode == "FAILFAST":
                        raise
                    rows = [_EMPTY | {"record": "error", "deck_id": key, "source_path": where, "error": str(e)}]
                out += rows
                if len(out) >= _BATCH:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema)

    key = deck_id if deck_id is not None else F.col(path)
    rows = files.select(key.cast("string").alias("deck_id"), F.col(path), F.col(content)).mapInArrow(run, RECORDS)
    return rows.withColumn("classification", image_class(F.col("features"))) if classify else rows


def _measure(rows: list[dict]) -> None:
    """Features of a deck's images, once for each distinct one."""
    known: dict[tuple[bytes, bool], dict | None] = {}
    for row in rows:
        if row["kind"] == "image" and row["image_bytes"]:
            vector = row["image_ext"] in VECTOR_EXTENSIONS
            key = (hashlib.sha256(row["image_bytes"]).digest(), vector)
            if key not in known:
                raw = convert_vector(row["image_bytes"], row["image_ext"]) if vector else row["image_bytes"]
                known[key] = features(raw) if raw else None
            row["features"] = known[key]


def split_records(rows: DataFrame) -> Deck:
    """The tables of records; a plan for each reads only its columns."""
    of = lambda kind: rows.where(F.col("record") == kind)
    return Deck(
        of("deck").select(*names(DECKS)),
        of("slide").select("deck_id", "slide_index", "title", "notes", F.lit(None).cast("string").alias("reconstructed_md")),
        of("shape").select(*names(SHAPES)),
        of("error").select("deck_id", "source_path", "error"),
    )


def read_decks(spark: SparkSession, paths: str | Iterable[str], *, mode: str = "PERMISSIVE") -> Deck:
    """Decks of files, folders or globs on any file system Spark reads."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.format("binaryFile").load(paths)
    return split_records(parse_files(files, mode=mode))


class DeckDataSource(DataSource):
    """``spark.read.format("deck").option("path", ...)``: records of local or
    mounted files, one partition a file."""

    @classmethod
    def name(cls) -> str:
        return "deck"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _DeckReader(self.options)


class _FilePartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _DeckReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.mode = options.get("path", ""), options.get("mode", "FAILFAST").upper()

    def partitions(self) -> list[InputPartition]:
        from glob import glob
        from pathlib import Path

        where = self.path.removeprefix("file://")
        found = sorted(str(p) for p in Path(where).glob("*.pptx")) if Path(where).is_dir() else sorted(glob(where))
        return [_FilePartition(p) for p in found or [where]]

    def read(self, partition: _FilePartition) -> Iterator[tuple]:
        try:
            try:
                with open(partition.path, "rb") as f:
                    data = f.read()
            except OSError as e:
                raise ParseError(f"file not found: {partition.path}") from e
            for row in records(partition.path, partition.path, data):
                if row["paragraphs"] is not None:
                    row["paragraphs"] = [Row(**p) for p in row["paragraphs"]]
                yield tuple(row[n] for n in _NAMES)
        except ParseError as e:
            if self.mode == "FAILFAST":
                raise
            row = _EMPTY | {"record": "error", "deck_id": partition.path, "source_path": partition.path, "error": str(e)}
            yield tuple(row[n] for n in _NAMES)
