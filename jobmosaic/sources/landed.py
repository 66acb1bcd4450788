"""Landed pages of portals as a Spark data source, one format a portal: the pages are read and parsed where their files
are, and only the fields of their cards reach the JVM.

    register(spark)
    cards = spark.read.format("vagas_pages").load(folder)       # term, page, pos, c
    postings = vagas_postings(cards)

A portal of one's own is a function from a parsed page to the fields of its cards: register(spark, {"mine": fields}).
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from jobmosaic.sources.portals import CARD, CARDS, READERS, Fields, parse

#: Bytes of a file that one task takes, and pages that are parsed before their cards are handed on.
PART_BYTES = 32 << 20
PAGES_AT_ONCE = 64
_CARD = pa.schema([("term", pa.string()), ("page", pa.int64()), ("pos", pa.int64()), ("c", pa.map_(pa.string(), pa.string()))])


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it, for plain local paths and addresses that Arrow knows."""
    at = urlparse(path)
    if at.scheme in ("", "file"):
        return fs.LocalFileSystem(), at.path if at.scheme else path
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


class Part(InputPartition):
    """A range of bytes of a file. It has the row groups that begin there, as in Spark's own reader."""

    def __init__(self, file: str, low: int, high: int):
        super().__init__((file, low, high))
        self.file, self.low, self.high = file, low, high


class PagesReader(DataSourceReader):
    """Planning lists the folder and opens no file; a task that is lost reads its range again."""

    def __init__(self, folder: str, fields: Fields, part_bytes: int):
        self.folder, self.fields, self.part_bytes = folder, fields, part_bytes

    def partitions(self) -> list[Part]:
        system, path = _place(self.folder)
        hidden = lambda f: any(step[0] in "._" for step in f[len(path) :].split("/") if step)
        files = [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and f.size and not hidden(f.path)]
        return [Part(f.path, low, min(low + self.part_bytes, f.size)) for f in sorted(files, key=lambda f: f.path) for low in range(0, f.size, self.part_bytes)]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return  # no files: Spark asks for one part without a place
        system, _ = _place(self.folder)
        with pq.ParquetFile(system.open_input_file(partition.file)) as file:
            groups = [g for g in range(file.metadata.num_row_groups) if partition.low <= _begin(file.metadata.row_group(g)) < partition.high]
            for batch in file.iter_batches(PAGES_AT_ONCE, groups, ["term", "page", "html"]) if groups else ():
                columns = (batch.column(name).to_pylist() for name in ("term", "page", "html"))
                found = [(t, p, n, list(card.items())) for t, p, html in zip(*columns, strict=True) for n, card in enumerate(self.fields(parse(html)))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), _CARD.types, strict=True)], schema=_CARD)


def _begin(group: pq.RowGroupMetaData) -> int:
    first = group.column(0)
    return first.dictionary_page_offset or first.data_page_offset


def source_of(portal: str, fields: Fields) -> type[DataSource]:
    """The class for one portal. It carries its function along, so that tasks need no registry."""

    class Pages(DataSource):
        """Options: path, and partBytes (bytes of a file that one task takes)."""

        @classmethod
        def name(cls) -> str:
            return f"{portal}_pages"

        def schema(self) -> str:
            return CARD

        def reader(self, schema) -> DataSourceReader:
            if not self.options.get("path"):
                raise ValueError(f"{portal}_pages needs a path")
            return PagesReader(self.options["path"], fields, int(self.options.get("partBytes", PART_BYTES)))

    return Pages


def register(spark: SparkSession, portals: dict[str, Fields] | None = None) -> None:
    """Formats <portal>_pages for the portals with pages, or for those given."""
    for portal, fields in (portals if portals is not None else {p: f for p, (f, _) in CARDS.items()}).items():
        spark.dataSource.register(source_of(portal, fields))


def read_portal(spark: SparkSession, portal: str, folder: str) -> DataFrame:
    """Raw postings of one portal from its folder of landed Parquet files: pages (term, page, html; any split into files) by
    the format, records (term, page, pos, json) by Spark's own reader. Null pages have no cards; a folder without files has no rows."""
    if portal in CARDS:
        fields, postings = CARDS[portal]
        register(spark, {portal: fields})
        return postings(spark.read.format(f"{portal}_pages").load(folder))
    return READERS[portal](spark.read.schema("term string, page long, pos long, json string").parquet(folder))
