"""``tessera COMMAND``: inspect, compare, merge, split and convert files."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Sequence

from tessera import __version__
from tessera.functions.checks import column_list
from tessera.render.formats import FORMATTERS


def parser() -> argparse.ArgumentParser:
    shared = argparse.ArgumentParser(add_help=False)
    for flags, more in (
        (("--output", "-o"), {"choices": list(FORMATTERS), "help": "form of the result (rich)"}),
        (("--delimiter", "-d"), {"help": "separator of CSV inputs (,)"}),
        (("--sheet",), {"help": "sheet of a workbook, by name or place from 0"}),
    ):
        shared.add_argument(*flags, default=argparse.SUPPRESS, **more)
    top = argparse.ArgumentParser(prog="tessera", description=__doc__, parents=[shared])
    top.add_argument("--version", "-v", action="version", version=f"tessera {__version__}")
    commands = top.add_subparsers(dest="command")

    def command(name: str, help: str, *paths: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=help, parents=[shared])
        for path in paths:
            p.add_argument(path)
        return p

    command("meta", "facts about a file", "file").add_argument("--fast", action="store_true", help="only what needs no reading of data")
    command("schema", "columns and types", "file")
    for name in ("head", "tail"):
        p = command(name, f"{'first' if name == 'head' else 'last'} rows", "file")
        p.add_argument("-n", type=int, default=5)
        p.add_argument("--columns", "-c")
    command("count", "number of rows", "file")
    p = command("split", "contiguous parts as files", "file")
    p.add_argument("--file-count", "-f", type=int)
    p.add_argument("--record-count", "-r", type=int)
    p.add_argument("--name-format", "-n", default="result-%06d.parquet")
    p.add_argument("--force", "-F", action="store_true")
    p = command("stats", "profile of each column", "file")
    p.add_argument("--columns", "-c")
    p.add_argument("--limit", type=int, default=50)
    p.add_argument("--top-n", type=int, default=5)
    p = command("convert", "another format", "source", "target")
    p.add_argument("--columns", "-c")
    p.add_argument("--force", "-F", action="store_true")
    p = command("diff", "compare two files by key", "left", "right")
    p.add_argument("--key", required=True)
    p.add_argument("--columns", "-c")
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--summary-only", action="store_true")
    p = command("merge", "rows of several files in one")
    p.add_argument("paths", nargs="*")
    p.add_argument("--force", "-F", action="store_true")
    return top


def main(argv: Sequence[str] | None = None, spark=None) -> int:
    """Run one command; known errors are told and give 1. A Spark session is only started for a valid command line."""
    top = parser()
    args = top.parse_args(argv)
    if not args.command:
        top.print_help()
        return 0
    say = FORMATTERS[getattr(args, "output", "rich")]
    try:
        if args.command == "split" and (args.file_count is None) == (args.record_count is None):
            both = args.file_count is not None
            raise ValueError("--file-count and --record-count are mutually exclusive" if both else "Either --file-count or --record-count must be specified")
        if args.command == "merge" and len(args.paths) < 2:
            raise ValueError("Provide at least one input file followed by an output path")
        if spark is None:
            from tessera.session import session

            spark = session()
            spark.sparkContext.setLogLevel("ERROR")
        return _run(args, say, spark)
    except (FileNotFoundError, FileExistsError, ValueError) as e:
        say.error(str(e))
    except Exception as e:  # noqa: BLE001
        say.error(f"Failed to {args.command}: {e}")
    return 1


def _run(args: argparse.Namespace, say, spark) -> int:
    from tessera.api import Dataset, diff_files, merge_files
    from tessera.sources.storage import Storage

    options = {"delimiter": getattr(args, "delimiter", ","), "sheet": getattr(args, "sheet", None)}
    columns = column_list(getattr(args, "columns", None))
    began = time.time()
    if args.command == "diff":
        say.diff(diff_files(spark, args.left, args.right, column_list(args.key) or [], columns, args.limit, args.summary_only, **options))
        return 0
    if args.command == "merge":
        *inputs, output = args.paths
        rows = merge_files(spark, inputs, output, args.force, **options)
        facts = {"Input files": inputs if say.name == "json" else len(inputs), "Output file": output}
        say.written("merge", facts, rows, time.time() - began)
        return 0
    data = Dataset(spark, args.source if args.command == "convert" else args.file, **options)
    if args.command == "meta":
        say.metadata(data.metadata(args.fast))
    elif args.command == "schema":
        say.schema(data.schema_info())
    elif args.command in ("head", "tail"):
        found = getattr(data, args.command)(args.n, columns)
        say.table(found.columns, [list(r) for r in found.collect()], args.command.capitalize())
    elif args.command == "count":
        say.count(data.num_rows)
    elif args.command == "stats":
        say.stats([r.asDict(recursive=True) for r in data.stats(columns, args.limit, args.top_n).collect()])
    elif args.command == "convert":
        rows = data.convert(args.target, columns, args.force)
        say.written("convert", {"Source file": args.source, "Output file": args.target}, rows, time.time() - began)
    elif args.command == "split":
        paths, rows = data.split(args.name_format, args.file_count, args.record_count, args.force)
        sizes = [(p, Storage(spark, p).files()[0][1]) for p in paths]
        say.written("split", {"Source file": args.file}, rows, time.time() - began, sizes)
    return 0


if __name__ == "__main__":
    sys.exit(main())
