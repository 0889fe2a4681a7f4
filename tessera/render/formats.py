"""Results as boxes (``rich``), tab-separated lines (``plain``) or JSON."""

from __future__ import annotations

import csv
import json
import sys
from collections.abc import Iterable, Sequence

from tessera.functions.text import file_size, plain_cell

STATS = ["name", "type", "count", "null_count", "min", "max", "mean", "cardinality", "top_values"]
COUNTERS = ["row_count_delta", "only_left_count", "only_right_count", "changed_count"]
SECTIONS = ["schema_only_left", "schema_only_right", "schema_type_mismatches", "changed_rows", "only_left", "only_right"]


def say(text: str, to=None) -> None:
    """Print; characters that the console cannot show become question marks."""
    to = to or sys.stdout
    try:
        print(text, file=to)
    except UnicodeEncodeError:
        kind = to.encoding or "ascii"
        print(text.encode(kind, "replace").decode(kind), file=to)


def box(title: str, header: Sequence[str], rows: Iterable[Sequence[object]]) -> str:
    cells = [[str(x) for x in r] for r in ([header] if header else [])] + [[str(x) for x in r] for r in rows]
    widths = [max((len(r[i]) for r in cells), default=0) for i in range(max(map(len, cells), default=0))]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    lines = ["| " + " | ".join(x.ljust(w) for x, w in zip(r, widths, strict=True)) + " |" for r in cells]
    body = [lines[0], rule, *lines[1:]] if header and lines else lines
    return "\n".join([title, rule, *body, rule])


class Rich:
    name = "rich"

    def metadata(self, found: dict) -> None:
        rows = []
        for key, value in found.items():
            if key in ("file_size", "serialized_size"):
                value = file_size(value)
            elif key == "num_columns" and "num_physical_columns" in found:
                value = f"{value:,} (logical)"
            elif key == "num_physical_columns":
                value = f"{value:,} (storage)"
            elif isinstance(value, int):
                value = f"{value:,}"
            rows.append((key, value))
        say(box("File Metadata", [], rows))

    def schema(self, fields: list[dict]) -> None:
        say(box("Schema Information", ["Column Name", "Data Type", "Nullable"], [(f["name"], f["type"], "yes" if f["nullable"] else "no") for f in fields]))

    def table(self, names: Sequence[str], rows: list[Sequence[object]], title: str = "Preview") -> None:
        say(box(f"{title} ({len(rows)} rows)", names, rows))

    def count(self, n: int) -> None:
        say(box("Total Rows", [], [(f"{n:,}",)]))

    def error(self, message: str) -> None:
        say(f"Error: {message}")

    def success(self, message: str) -> None:
        say(f"OK {message}")

    def stats(self, rows: list[dict]) -> None:
        def cells(r: dict) -> list:
            top = ", ".join(f"{x['value']}({x['count']})" for x in r["top_values"] or [])
            return ["" if r[c] is None else r[c] for c in STATS[:-1]] + [top]

        say(box("Column Statistics", [*STATS[:-1], "top values"], map(cells, rows)))

    def diff(self, found: dict) -> None:
        say(box("Diff Summary", [], [(c, found[c]) for c in COUNTERS]))
        for section in SECTIONS:
            if rows := found.get(section):
                say(box(section, list(rows[0]), [list(r.values()) for r in rows]))

    def written(self, kind: str, facts: dict, rows: int, seconds: float, files: list[tuple[str, int]] | None = None) -> None:
        lines = [*facts.items(), ("Total rows", f"{rows:,}")]
        if files is not None:
            lines += [("Output files", len(files)), ("Rows per file", f"~{rows // max(1, len(files)):,}"), ("Total output size", file_size(sum(s for _, s in files)))]
        say(box(f"{kind.capitalize()} Complete", [], [*lines, ("Time elapsed", f"{seconds:.2f}s")]))
        if files is not None:
            say(box("Output Files", ["#", "File Name", "Size"], [(i, p, file_size(s)) for i, (p, s) in enumerate(files)]))


class Plain:
    name = "plain"

    def _lines(self, rows: Iterable[Sequence[object]]) -> None:
        out = csv.writer(sys.stdout, delimiter="\t", lineterminator="\n")
        for r in rows:
            out.writerow([plain_cell(x) for x in r])

    def metadata(self, found: dict) -> None:
        self._lines(found.items())

    def schema(self, fields: list[dict]) -> None:
        self._lines([["name", "type", "nullable"], *[[f["name"], f["type"], f["nullable"]] for f in fields]])

    def table(self, names: Sequence[str], rows: list[Sequence[object]], title: str = "") -> None:
        self._lines([names, *rows])

    def count(self, n: int) -> None:
        say(str(n))

    def error(self, message: str) -> None:
        say(f"Error: {message}", sys.stderr)

    def success(self, message: str) -> None:
        say(message)

    def stats(self, rows: list[dict]) -> None:
        self._lines([STATS, *[[*[r[c] for c in STATS[:-1]], json.dumps(r["top_values"]) if r["top_values"] else ""] for r in rows]])

    def diff(self, found: dict) -> None:
        self._lines([(c, found[c]) for c in COUNTERS])

    def written(self, kind: str, facts: dict, rows: int, seconds: float, files: list[tuple[str, int]] | None = None) -> None:
        short = {"Source file": "source", "Output file": "output", "Input files": "inputs"}
        lines: list = [(short[k], v) for k, v in facts.items()] + [("total_rows", rows)]
        lines += [("output_files", len(files))] if files is not None else []
        self._lines([*lines, ("elapsed", f"{seconds:.2f}s"), *[("file", p) for p, _ in files or []]])


class Json:
    name = "json"

    def _say(self, value: object, to=None) -> None:
        say(json.dumps(value, default=str), to)

    def metadata(self, found: dict) -> None:
        self._say(found)

    def schema(self, fields: list[dict]) -> None:
        self._say({"columns": fields})

    def table(self, names: Sequence[str], rows: list[Sequence[object]], title: str = "") -> None:
        self._say({"rows": [dict(zip(names, r, strict=True)) for r in rows]})

    def count(self, n: int) -> None:
        self._say({"count": n})

    def error(self, message: str) -> None:
        self._say({"error": message}, sys.stderr)

    def success(self, message: str) -> None:
        self._say({"message": message})

    def stats(self, rows: list[dict]) -> None:
        self._say({"columns": rows})

    def diff(self, found: dict) -> None:
        self._say(found)

    def written(self, kind: str, facts: dict, rows: int, seconds: float, files: list[tuple[str, int]] | None = None) -> None:
        short = {"Source file": "source", "Output file": "output", "Input files": "inputs"}
        out = {short[k]: v for k, v in facts.items()} | {"total_rows": rows}
        if files is not None:
            out["output_files"] = [p for p, _ in files]
        self._say(out | {"elapsed_seconds": round(seconds, 2)})


FORMATTERS = {f.name: f for f in (Rich(), Plain(), Json())}
