"""CSV and TSV, with types found by one aggregate over all values.

Every value is read as text first. A type is taken if all values of the column have its exact form (casts alone accept too
much), in the order of ``_FORMS``; null spellings stand for null in all types but text, where an empty cell is ``''``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The spellings of null, and of true and false, that readers of this kind know.
NULLS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null"]
TRUE, FALSE = ["1", "true", "True", "TRUE"], ["0", "false", "False", "FALSE"]
_DATE, _TIME = r"\d{4}-\d{2}-\d{2}", r"\d{2}:\d{2}(:\d{2})?"


def _integer(c: Column) -> Column:
    plain = F.trim(c)
    return F.when(plain.rlike(r"^-?\d+$"), plain.try_cast("bigint")).when(plain.rlike(r"^0x[0-9A-Fa-f]{1,15}$"), F.conv(F.substring(plain, 3, 15), 16, 10).try_cast("bigint"))


def _boolean(c: Column) -> Column:
    return F.when(c.isin(TRUE), True).when(c.isin(FALSE), False)


def _date(c: Column) -> Column:
    return F.when(c.rlike(f"^{_DATE}$"), c.try_cast("date"))


def _instant(c: Column, form: str) -> Column:
    return F.when(c.rlike(form), F.replace(c, F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz"))


#: (Arrow name, value or null where the text does not have the form)
_FORMS = [
    ("int64", _integer),
    ("bool", _boolean),
    ("date32[day]", _date),
    ("timestamp[s]", lambda c: _instant(c, f"^{_DATE}([ T]{_TIME})?$")),
    ("timestamp[ns]", lambda c: _instant(c, rf"^{_DATE}([ T]{_TIME}(\.\d{{1,9}})?)?$")),
    ("double", lambda c: F.when(F.trim(c).rlike(r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|Inf|INF|infinity|Infinity)$"), F.trim(c).try_cast("double"))),
]


def splittable(spark: SparkSession, path: str) -> bool:
    """Whether no cell holds a line break: then every line has an even number of quotes. One scan that itself splits."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).head(1)


def names(spark: SparkSession, path: str, delimiter: str = ",") -> list[str]:
    """The columns, from the first line alone."""
    head = spark.read.options(sep=delimiter, quote='"', escape='"', multiLine=True, header=False).csv(path).head(1)
    if not head:
        raise ValueError(f"Empty CSV file: {path}")
    found = [x or "" for x in head[0]]
    if len(set(found)) < len(found):
        raise ValueError(f"Duplicate column names in {path}: {sorted({n for n in found if found.count(n) > 1})}")
    return found


def texts(spark: SparkSession, path: str, delimiter: str = ",", single_line: bool | None = None) -> DataFrame:
    """All cells as texts. The first line has the names.

    Cells may hold line breaks, which keeps a file in one split; where none does, or ``single_line`` says so, tasks share a
    file. Rows with too many or too few cells, repeated names and files without a header raise.
    """
    columns = names(spark, path, delimiter)
    if single_line is None:
        single_line = splittable(spark, path)
    reader = spark.read.options(header=True, sep=delimiter, quote='"', escape='"', multiLine=not single_line, mode="FAILFAST", inferSchema=False, nullValue="\0", emptyValue="", enforceSchema=False)
    raw = reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in columns])).csv(path)
    return raw.select([F.coalesce(_cell(n), F.lit("")).alias(n) for n in columns])


def typed(raw: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """(the frame of texts with its columns' types, Arrow name of each type), from all values."""
    flags = []
    for i, n in enumerate(raw.columns):
        absent = _cell(n).isin(NULLS)
        flags.append(F.coalesce(F.bool_and(absent), F.lit(True)).alias(f"{i}:null"))
        flags += [F.bool_and(absent | form(_cell(n)).isNotNull()).alias(f"{i}:{kind}") for kind, form in _FORMS]
    found = raw.agg(*flags).first()
    out, kinds = [], {}
    for i, n in enumerate(raw.columns):
        kind = "null" if found[f"{i}:null"] else next((k for k, _ in _FORMS if found[f"{i}:{k}"]), "string")
        kinds[n] = kind
        if kind == "null":
            out.append(F.lit(None).alias(n))
        elif kind == "string":
            out.append(_cell(n).alias(n))
        else:
            out.append(F.when(~_cell(n).isin(NULLS), dict(_FORMS)[kind](_cell(n))).alias(n))
    return raw.select(out), kinds


def _cell(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")
