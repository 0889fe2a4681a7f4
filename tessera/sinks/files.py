"""Files, numbered files and folders of files as sinks: Spark writes into a staging folder beside the target, and a rename commits."""

from __future__ import annotations

import io
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from datetime import date, datetime
from decimal import Decimal
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.preview import quoted
from tessera.plans.ordinals import ORDINAL
from tessera.sources.storage import Storage
from tessera.sources.table import suffix

#: Rows that a sheet of a workbook can have; more are an error, which bounds what the driver streams into one.
SHEET_ROWS = 1_048_576
#: Rows of a file in a folder of files.
PART_ROWS = 1_000_000
_WRITERS = {".parquet": "parquet", ".csv": "csv", ".tsv": "csv"}


def check_target(storage: Storage, path: str, force: bool, inputs: Sequence[str] = ()) -> None:
    """Unsupported suffixes, existing targets (unless ``force``) and targets that are inputs raise."""
    if suffix(path) not in (*_WRITERS, ".xlsx"):
        raise ValueError(f"Unsupported output file format: {suffix(path) or 'none'}")
    if any(storage.same(path, i) for i in inputs):
        raise ValueError(f"Output file is also an input: {path}")
    if storage.exists(path) and not force:
        raise FileExistsError(f"Output file already exists: {path}")


def check_pattern(pattern: str) -> None:
    """One integer slot in printf style."""
    try:
        if pattern % 0 == pattern % 1:
            raise ValueError("every file would have the same name")
    except (TypeError, ValueError) as e:
        raise ValueError(f"Invalid output pattern format: {e}") from e


def _writer(df: DataFrame, path: str, codec: str | None):
    if suffix(path) == ".parquet":
        return df.write.option("compression", codec or "snappy").format("parquet")
    return df.write.format("text")


def _lined(df: DataFrame, path: str, order: Sequence[str], chunk: str | None = None) -> DataFrame:
    """For CSV and TSV: ``value``, the rows as lines, ``order`` and ``chunk``; a header comes before the rows, one in each chunk.

    Texts, and names in the header, are always quoted; null is an empty cell without quotes.
    """
    separator = "\t" if suffix(path) == ".tsv" else ","
    fields = [f for f in df.schema if f.name not in (*order, chunk)]
    cells = []
    for f in fields:
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.BinaryType, T.VariantType)):
            raise ValueError(f"Column {f.name} of type {f.dataType.simpleString()} cannot be written as text")
        cell = quoted([f.name])[0].cast("string")
        if isinstance(f.dataType, T.StringType):
            cell = F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))
        cells.append(F.coalesce(cell, F.lit("")))
    own = [*order, *[chunk] * bool(chunk)]
    lines = df.select(F.concat_ws(separator, *cells).alias("value"), *own)
    names = separator.join('"' + f.name.replace('"', '""') + '"' for f in fields)
    heads = df.select(chunk).distinct() if chunk else df.sparkSession.range(1)
    heads = heads.select(F.lit(names).alias("value"), *[F.lit(-1).cast(df.schema[c].dataType).alias(c) if c != chunk else F.col(c) for c in own])
    return heads.unionByName(lines)


def _staging(path: str) -> str:
    folder, _, name = path.rpartition("/")
    return f"{folder or '.'}/.{name}.{uuid.uuid4().hex}"


def _part(storage: Storage, folder: str) -> str:
    found = [s.getPath().toString() for s in storage.fs.listStatus(storage.path(folder)) if s.getPath().getName().startswith("part-")]
    if len(found) != 1:
        raise OSError(f"{len(found)} files in {folder}")
    return found[0]


def _commit(storage: Storage, source: str, target: str) -> None:
    """Put the new file, which is whole, in the target's place."""
    _commit_all(storage, [(source, target)])


def _commit_all(storage: Storage, moves: Sequence[tuple[str, str]]) -> None:
    """Put each source in its target's place. What stood there is set aside first, and comes back if any move fails."""
    aside: list[tuple[str, str]] = []
    done: list[str] = []
    try:
        for source, target in moves:
            parent = storage.path(target).getParent()
            if parent is not None:
                storage.fs.mkdirs(parent)
            if storage.exists(target):
                old = _staging(target)
                storage.move(target, old)
                aside.append((old, target))
            storage.move(source, target)
            done.append(target)
    except Exception:
        for target in done:
            storage.delete(target)
        for old, target in aside:
            storage.move(old, target)
        raise
    for old, _ in aside:
        storage.delete(old)


def write_one(df: DataFrame, path: str, order: Sequence[str] = (ORDINAL,), force: bool = False, codec: str | None = None, inputs: Sequence[str] = ()) -> int:
    """Write all rows, by ``order`` (left out of the file), to one file; returns the rows written."""
    storage = Storage(df.sparkSession, path)
    check_target(storage, path, force, inputs)
    order = [c for c in order if c in df.columns]
    if suffix(path) == ".xlsx":
        return _write_xlsx(df.orderBy(*order).drop(*order) if order else df, storage, path)
    staging = _staging(path)
    seen = Observation()
    try:
        df = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        df = df if suffix(path) == ".parquet" else _lined(df, path, order)
        one = df.repartition(1).sortWithinPartitions(*order) if order else df.coalesce(1)
        _writer(one.drop(*order), path, codec).save(staging)
        _commit(storage, _part(storage, staging), path)
    finally:
        storage.delete(staging)
    return seen.get["rows"]


def write_folder(df: DataFrame, path: str, total: int, order: Sequence[str] = (ORDINAL,), force: bool = False, codec: str | None = None, inputs: Sequence[str] = ()) -> int:
    """Write all rows, by ``order``, to a folder of files of about PART_ROWS rows, in parallel; returns the rows written."""
    path = path.rstrip("/")
    storage = Storage(df.sparkSession, path)
    check_target(storage, path, force, inputs)
    if suffix(path) == ".xlsx":
        raise ValueError("a workbook is one file")
    staging = _staging(path)
    seen = Observation()
    try:
        parts = df.repartitionByRange(max(1, -(-total // PART_ROWS)), *order).sortWithinPartitions(*order).drop(*order).observe(seen, F.count(F.lit(1)).alias("rows"))
        if suffix(path) == ".parquet":
            parts.write.option("compression", codec or "snappy").parquet(staging)
        else:
            parts.write.options(header=True, sep="\t" if suffix(path) == ".tsv" else ",", quote='"', escape='"', emptyValue='""', nullValue="").csv(staging)
        _commit(storage, staging, path)
    finally:
        storage.delete(staging)
    return seen.get["rows"]


@contextmanager
def reported(spark: SparkSession, progress: Callable[[int, int], None] | None, total: int | None) -> Iterator[None]:
    """Call ``progress`` with the rows done so far, by the tasks that have ended, and ``total`` while the jobs of the block run."""
    if not progress or not total:
        yield
        return
    context, group, ended = spark.sparkContext, f"tessera-{uuid.uuid4().hex}", threading.Event()
    context.setJobGroup(group, "tessera")

    def follow() -> None:
        told = 0
        tracker = context.statusTracker()
        while not ended.wait(1.0):
            jobs = [j for i in tracker.getJobIdsForGroup(group) if (j := tracker.getJobInfo(i))]
            stages = [s for j in jobs for i in j.stageIds if (s := tracker.getStageInfo(i))]
            tasks = sum(s.numTasks for s in stages)
            done = total * sum(s.numCompletedTasks for s in stages) // max(1, tasks)
            if told < done < total:
                told = done
                progress(done, total)

    thread = threading.Thread(target=follow, daemon=True)
    thread.start()
    try:
        yield
    finally:
        ended.set()
        thread.join()
        context.setLocalProperty("spark.jobGroup.id", None)


def write_many(df: DataFrame, pattern: str, chunk: str, order: str = ORDINAL, force: bool = False, codec: str | None = None, inputs: Sequence[str] = ()) -> tuple[list[str], int]:
    """One file for each chunk, named by ``pattern``; (paths, rows written). No target is touched until all are whole."""
    check_pattern(pattern)
    storage = Storage(df.sparkSession, pattern % 0)
    if suffix(pattern % 0) == ".xlsx":
        chunks = sorted(r[0] for r in df.select(chunk).distinct().collect())
        for i in chunks:
            check_target(storage, pattern % i, force, inputs)
        rows = sum(write_one(df.where(F.col(chunk) == i).drop(chunk), pattern % i, [order], force, codec) for i in chunks)
        return [pattern % i for i in chunks], rows
    check_target(storage, pattern % 0, force, inputs)
    staging = _staging(pattern % 0)
    seen = Observation()
    try:
        lines = df if suffix(pattern % 0) == ".parquet" else _lined(df, pattern % 0, [order], chunk)
        placed = lines.repartition(chunk).sortWithinPartitions(chunk, order).drop(order)
        placed = placed.observe(seen, F.count(F.lit(1)).alias("rows"))
        _writer(placed.withColumnRenamed(chunk, "__chunk"), pattern % 0, codec).partitionBy("__chunk").save(staging)
        chunks = sorted(int(s.getPath().getName().partition("=")[2]) for s in storage.fs.listStatus(storage.path(staging)) if s.isDirectory())
        rows = seen.get["rows"] - (0 if lines is df else len(chunks))
        if not rows:
            raise ValueError("Cannot split empty file")
        for i in chunks:
            check_target(storage, pattern % i, force, inputs)
        _commit_all(storage, [(_part(storage, f"{staging}/__chunk={i}"), pattern % i) for i in chunks])
    finally:
        storage.delete(staging)
    return [pattern % i for i in chunks], rows


def _write_xlsx(df: DataFrame, storage: Storage, path: str) -> int:
    staging = _staging(path)
    data, rows = workbook(df.columns, df.toLocalIterator())
    stream = storage.fs.create(storage.path(staging))
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    try:
        _commit(storage, staging, path)
    finally:
        storage.delete(staging)
    return rows


def workbook(names: Sequence[str], rows: Iterable) -> tuple[bytes, int]:
    """(a workbook of one sheet, its rows without the header). Nested values are written as text."""
    out = io.BytesIO()
    count = 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in _PARTS.items():
            z.writestr(name, content)
        with z.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(f'{_XML}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
            sheet.write(_row(names).encode())
            for row in rows:
                count += 1
                if count >= SHEET_ROWS:
                    raise ValueError(f"a sheet has at most {SHEET_ROWS} rows")
                sheet.write(_row(row).encode())
            sheet.write(b"</sheetData></worksheet>")
    return out.getvalue(), count


def _row(values: Iterable) -> str:
    return f"<row>{''.join(map(_cell, values))}</row>"


def _cell(value: object) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float, Decimal)) and value == value and abs(value) != float("inf"):
        return f"<c><v>{value!r}</v></c>" if not isinstance(value, Decimal) else f"<c><v>{value}</v></c>"
    if isinstance(value, (datetime, date)):
        whole = value if isinstance(value, datetime) else datetime(value.year, value.month, value.day)
        days = (whole.replace(tzinfo=None) - datetime(1899, 12, 30)).total_seconds() / 86400
        return f'<c s="{1 if isinstance(value, datetime) else 2}"><v>{days!r}</v></c>'
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


# The parts that every workbook has, as the format prescribes them (fixed values).
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_PARTS = {
    "[Content_Types].xml": f'{_XML}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    f'<Override PartName="/xl/workbook.xml" ContentType="{_KIND}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{_KIND}.styles+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_KIND}.worksheet+xml"/></Types>',
    "_rels/.rels": f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'{_XML}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets><sheet name={quoteattr("Sheet1")} sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>',
    "xl/styles.xml": f'{_XML}<styleSheet xmlns="{_MAIN}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
    '<cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/><xf numFmtId="14" applyNumberFormat="1"/></cellXfs></styleSheet>',
}
