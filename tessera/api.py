"""The operators on files: what the command-line tool calls."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import checks
from tessera.operators import preview, profile, split
from tessera.operators.diff import Diff
from tessera.operators.merge import merge
from tessera.plans.ordinals import ORDINAL
from tessera.sinks import files
from tessera.sources.storage import Storage
from tessera.sources.table import Table

SUPPORTED_INPUT_FORMATS = (".parquet", ".csv", ".xlsx", ".tsv")
Progress = Callable[[int, int], None]


class Dataset(Table):
    """One input with all that can be asked of it. Nothing is read before it is needed."""

    @property
    def num_rows(self) -> int:
        return self.count

    @property
    def num_columns(self) -> int:
        return len(self.names)

    @property
    def num_physical_columns(self) -> int:
        return self.footers[0].num_columns if self.format == "parquet" else self.leaf_count

    @property
    def num_row_groups(self) -> int:
        return sum(f.num_row_groups for f in self.footers) if self.format == "parquet" else 1

    def metadata(self, fast: bool = False) -> dict:
        """Facts about the input, in a fixed order; ``fast`` leaves out what takes reading the data."""
        size = sum(s for _, s in self.files)
        if self.format != "parquet":
            out = {"file_path": self.path, "input_format": self.format, "num_columns": self.num_columns, "file_size": size, "num_row_groups": 1}
            return out if fast else out | {"num_rows": self.count}
        out = {"file_path": self.path, "num_columns": self.num_columns, "file_size": size, "num_row_groups": self.num_row_groups, "format_version": self.footers[0].format_version}
        if not fast:
            out["num_rows"] = self.count
        if self.num_physical_columns != self.num_columns:
            out["num_physical_columns"] = self.num_physical_columns
        if not fast:
            if self.codecs:
                out["compression"] = ", ".join(self.codecs)
            out |= {"serialized_size": sum(f.serialized_size for f in self.footers), "created_by": self.footers[0].created_by}
        return out

    @cached_property
    def codecs(self) -> list[str]:
        if self.format != "parquet":
            return []
        return sorted({f.row_group(g).column(c).compression for f in self.footers for g in range(f.num_row_groups) for c in range(f.num_columns)})

    def schema_info(self) -> list[dict]:
        return [{"name": n, "type": t, "nullable": x} for n, t, x in self.fields]

    def read_columns(self, columns: Sequence[str]) -> DataFrame:
        return self.frame.select(preview.quoted(checks.columns(columns, self.frame.columns)))

    def head(self, n: int = 5, columns: Sequence[str] | None = None) -> DataFrame:
        checks.rows(n)
        names = checks.columns(columns, self.frame.columns)
        if self.format == "parquet" and n:
            if (found := self.edge(n, names)) is not None:
                return found
            part, _ = self.first_files(n)
            # Row numbers count from the first file on, so the filter leaves the top-n step few rows.
            return preview.head(part.where(F.col(ORDINAL) < n), n, columns, ORDINAL)
        return preview.head(self.frame, n, columns)

    def tail(self, n: int = 5, columns: Sequence[str] | None = None) -> DataFrame:
        checks.rows(n)
        names = checks.columns(columns, self.frame.columns)
        if self.format == "parquet" and n:
            if (found := self.edge(n, names, last=True)) is not None:
                return found
            part, rows = self.first_files(n, last=True)
            return preview.tail(part.where(F.col(ORDINAL) >= rows - n), n, columns, ORDINAL)
        return preview.tail(self.numbered(), n, columns, ORDINAL)

    def stats(self, columns: Sequence[str] | None = None, limit: int = 50, top_n: int = 5) -> DataFrame:
        """The profile of each column; equally frequent values in the order of first appearance."""
        found = profile.stats(self.numbered(), columns, limit, top_n, ORDINAL)
        kinds = {n: t for n, t, _ in self.fields}
        names = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]) if kinds else None
        return found.withColumn("type", F.element_at(names, F.col("name"))) if names is not None else found

    def convert(self, output: str, columns: Sequence[str] | None = None, force: bool = False, progress: Progress | None = None) -> int:
        """Write all rows, or some columns of them, to one file of any supported format; returns the rows.

        An ``output`` that ends in a slash becomes a folder of files, which many tasks write.
        """
        names = checks.columns(columns, self.frame.columns)
        files.check_target(self.storage, str(output), force, [self.path])
        rows = _write(self.spark, self.numbered().select(*preview.quoted(names), ORDINAL), str(output), [ORDINAL], force, self.codec, lambda: self.count, progress)
        if progress:
            progress(rows, rows)
        return rows

    def split(self, pattern: str, file_count: int | None = None, record_count: int | None = None, force: bool = False, progress: Progress | None = None) -> tuple[list[str], int]:
        """Write contiguous ranges of rows to files named by ``pattern``; (paths, rows)."""
        files.check_pattern(pattern)
        files.check_target(self.storage, pattern % 0, True)
        total = None
        if file_count is not None or record_count is None:
            total = self.count
            for i in range(checks.files_needed(total, file_count=file_count, record_count=record_count)):
                files.check_target(self.storage, pattern % i, force, [self.path])
        rows = split.assigned(self.numbered(), ORDINAL, total, file_count, record_count, "__split")
        with files.reported(self.spark, progress, total):
            paths, written = files.write_many(rows, pattern, "__split", force=force, codec=self.codec, inputs=[self.path])
        if progress:
            progress(written, written)
        return paths, written


def _write(spark: SparkSession, df: DataFrame, output: str, order: list[str], force: bool, codec: str | None, count: Callable[[], int], progress: Progress | None) -> int:
    folder = output.endswith("/")
    total = count() if folder or progress else None
    with files.reported(spark, progress, total):
        return files.write_folder(df, output, total, order, force, codec) if folder else files.write_one(df, output, order, force, codec)


def diff_files(spark: SparkSession, left: str, right: str, keys: Sequence[str], columns: Sequence[str] | None = None, limit: int = 20, summary_only: bool = False, delimiter: str = ",", sheet: str | None = None) -> dict:
    """Counters and samples of what differs between two inputs; workbooks must be converted first."""
    a, b = (Dataset(spark, p, delimiter, sheet) for p in (left, right))
    if "xlsx" in (a.format, b.format):
        raise ValueError("diff takes parquet and csv inputs; convert xlsx first: tessera convert input.xlsx output.parquet")
    types = tuple({n: t for n, t, _ in d.fields} for d in (a, b))
    return Diff(a.frame, b.frame, keys, columns, types).result(limit, summary_only)


def merge_files(spark: SparkSession, inputs: Sequence[str], output: str, force: bool = False, delimiter: str = ",", sheet: str | None = None, progress: Progress | None = None) -> int:
    """All rows of all inputs, in their order, in one file, or in a folder if ``output`` ends in a slash; returns the rows."""
    if not inputs:
        raise ValueError("At least one input file must be provided")
    files.check_target(Storage(spark, str(output)), str(output), force, [str(i) for i in inputs])
    found = [Dataset(spark, p, delimiter, sheet) for p in inputs]
    merged = merge([d.frame for d in found])  # the schemas' check, before any work
    numbered = []
    for i, d in enumerate(found):
        cast = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in merged.schema]
        numbered.append(d.numbered().select(*cast, ORDINAL, F.lit(i).alias("__input")))
    rows = _write(spark, merge(numbered), str(output), ["__input", ORDINAL], force, None, lambda: sum(d.count for d in found), progress)
    if progress:
        progress(rows, rows)
    return rows
