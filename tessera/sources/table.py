"""One input: a path, its format, and the DataFrame that reads it, opened when first needed."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.types import arrow_name, leaves
from tessera.plans import ordinals
from tessera.sources import csv, footers, xlsx
from tessera.sources.storage import Storage

#: Files whose footers the driver reads one by one; of more files Spark counts the rows.
FEW = 100
#: Of row groups that the driver reads itself for a preview.
PREVIEW_BYTES = 32 << 20
FORMATS = {".csv": "csv", ".parquet": "parquet", ".tsv": "csv", ".xlsx": "xlsx"}


def suffix(path: str) -> str:
    name = path.rstrip("/").rpartition("/")[2]
    return "." + name.rpartition(".")[2].lower() if "." in name else ""


class Table:
    """``path`` must exist; what it holds is looked at later. A Parquet path may be a folder of files."""

    def __init__(self, spark: SparkSession, path: str, delimiter: str = ",", sheet: str | None = None):
        self.spark, self.path, self.sheet = spark, str(path), sheet
        self.storage = Storage(spark, self.path)
        if not self.storage.exists():
            raise FileNotFoundError(f"File not found: {path}")
        kind = suffix(self.path)
        if kind not in FORMATS:
            raise ValueError(f"Unsupported file format: {kind or 'none'}. Supported formats: {', '.join(sorted(FORMATS))}")
        self.format = FORMATS[kind]
        self.delimiter = "\t" if kind == ".tsv" and delimiter == "," else delimiter

    @cached_property
    def _opened(self) -> tuple[DataFrame, dict[str, str]]:
        if self.format == "parquet":
            return self.spark.read.parquet(self.path), {}
        if self.format == "csv":
            return csv.typed(self.texts)
        return xlsx.read(self.spark, self.path, self.sheet)

    @cached_property
    def texts(self) -> DataFrame:
        """Of CSV the cells as they stand, for what needs no types."""
        return csv.texts(self.spark, self.path, self.delimiter)

    @cached_property
    def names(self) -> list[str]:
        """The columns; of CSV from the first line alone."""
        return csv.names(self.spark, self.path, self.delimiter) if self.format == "csv" else [n for n, _, _ in self.fields]

    @property
    def frame(self) -> DataFrame:
        return self._opened[0]

    @cached_property
    def files(self) -> list[tuple[str, int]]:
        return self.storage.files()

    @cached_property
    def footers(self) -> list:
        """Of a Parquet input's files, in their order; many are read at a time."""
        return footers.footers(self.storage, self.files)

    @cached_property
    def first_footer(self):
        return footers.footer(self.storage, *self.files[0])

    @property
    def codec(self) -> str | None:
        """A Parquet input's codec, from the footer of the first file with rows."""
        if self.format == "parquet":
            for path, size in self.files:
                found = footers.footer(self.storage, path, size)
                if found.num_row_groups:
                    return found.row_group(0).column(0).compression.lower()
        return None

    @cached_property
    def count(self) -> int:
        """Rows; of Parquet from the footers alone, on the driver for a few files."""
        if self.format == "parquet" and len(self.files) <= FEW:
            return sum(f.num_rows for f in self.footers)
        return (self.texts if self.format == "csv" else self.frame).count()

    @cached_property
    def fields(self) -> list[tuple[str, str, bool]]:
        """(name, Arrow type, nullable) of each column; of Parquet as the first file's footer has them, then those in folder names."""
        if self.format == "parquet":
            own = [(f.name, str(f.type), f.nullable) for f in self.first_footer.schema.to_arrow_schema()]
            names = {n for n, _, _ in own}
            return own + [(f.name, arrow_name(f.dataType), True) for f in self.frame.schema if f.name not in names]
        return [(f.name, self._opened[1].get(f.name) or arrow_name(f.dataType), True) for f in self.frame.schema]

    @property
    def leaf_count(self) -> int:
        return leaves(self.frame.schema)

    def numbered(self, name: str = ordinals.ORDINAL) -> DataFrame:
        """The frame with each row's number from 0, in the order of files and rows.

        Parquet rows get it from their file's place and their own place in the file. Of a few files the footers tell the
        places; of many one scan without columns counts, and the starts are joined.
        """
        if self.format != "parquet":
            return ordinals.dense(self.frame, name)
        if len(self.files) > FEW:
            path = _plain(F.col("_metadata.file_path"))
            counts = self.frame.groupBy(path.alias("__file")).agg(F.count(F.lit(1)).alias("__rows"))
            before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
            starts = counts.select("__file", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
            tagged = self.frame.withColumns({"__file": path, "__at": F.col("_metadata.row_index")})
            return tagged.join(starts, "__file").withColumn(name, F.col("__start") + F.col("__at")).drop("__file", "__at", "__start")
        begin, starts = 0, {}
        for (path, _), found in zip(self.files, self.footers, strict=True):
            starts[self.storage.plain(path)] = begin
            begin += found.num_rows
        return self.frame.withColumn(name, _start(starts) + F.col("_metadata.row_index"))

    def edge(self, n: int, columns: list[str], last: bool = False) -> DataFrame | None:
        """The first or last n rows from just the row groups that hold them, if the driver can read those as Spark would.

        That is, if they have at most PREVIEW_BYTES and their types are Spark's; folders' names have no columns here.
        """
        if any("." in c for c in columns) or set(columns) - {f.name for f in self.first_footer.schema.to_arrow_schema()}:
            return None
        found = footers.edge(self.storage, self.files, n, columns, last, PREVIEW_BYTES)
        if found is None:
            return None
        wanted = self.frame.select(*columns).schema
        frame = self.spark.createDataFrame(found.select(columns))
        same = [(a.name, a.dataType) for a in frame.schema] == [(b.name, b.dataType) for b in wanted]
        return frame if same else None

    def first_files(self, n: int, last: bool = False) -> tuple[DataFrame, int]:
        """(numbered frame of just those Parquet files that hold the first or last n rows, their rows)."""
        chosen, rows = [], 0
        for path, size in reversed(self.files) if last else self.files:
            if chosen and rows >= n:
                break
            chosen.append(path)
            rows += footers.footer(self.storage, path, size).num_rows
        part = Table(self.spark, self.path)
        part.files = [(p, s) for p, s in self.files if p in chosen]
        reader = self.spark.read.schema(self.frame.schema)
        if self.storage.is_folder():  # the folders' names below it have columns
            reader = reader.option("basePath", self.path)
        part._opened = (reader.parquet(*chosen), {})
        return part.numbered(), rows


def _start(starts: dict[str, int]) -> Column:
    if len(starts) == 1:
        return F.lit(next(iter(starts.values())))
    table = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])
    return F.element_at(table, _plain(F.col("_metadata.file_path")))


def _plain(url: Column) -> Column:
    """What ``Storage.plain`` gives: a file's url without scheme and host, decoded."""
    path = F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
