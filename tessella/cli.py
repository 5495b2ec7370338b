"""Command line: extract, status, init-ids, compose, verify and seed over a working tree."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tessella.plans import commands
from tessella.sources.workspace import Exit, WorkspaceError


class _Usage(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        raise WorkspaceError(Exit.USAGE, f"{message}\n{self.format_usage()}")


def parser() -> argparse.ArgumentParser:
    top = _Usage(prog="tessella", description="Localization catalogs of a working tree.")
    todo = top.add_subparsers(dest="command", required=True, parser_class=_Usage)
    commands_ = {
        "extract": "extract units and update the catalogs", "status": "report translation state; --policy gates", "init-ids": "insert explicit ids; --check lints them",
        "compose": "write a locale's tree", "verify": "gate terms, lengths, fences and overrides", "seed": "draft from a translated tree",
    }
    for name, text in commands_.items():
        own = todo.add_parser(name, help=text)
        own.add_argument("--root", default=".")
        if name in ("extract", "init-ids"):
            own.add_argument("--check", action="store_true")
        else:
            own.add_argument("--locale", required=name in ("compose", "seed"))
        if name in ("status", "seed"):
            own.add_argument("--json", action="store_true")
        if name == "status":
            own.add_argument("--policy")
        if name == "compose":
            own.add_argument("--out")
            own.add_argument("--strict", action="store_true")
        if name == "seed":
            own.add_argument("--from", dest="source", required=True)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None, err=None) -> int:
    """Runs one command and returns its exit code; errors of the workspace are said, others are bugs."""
    out = out or (lambda s: print(s))
    err = err or (lambda s: print(s, file=sys.stderr))
    try:
        args = parser().parse_args(argv)
        spark = spark or SparkSession.builder.appName("tessella").getOrCreate()
        if args.command == "extract":
            return commands.extract(spark, args.root, out, err, args.check)
        if args.command == "status":
            return commands.status(spark, args.root, out, err, args.json, args.policy, args.locale)
        if args.command == "compose":
            return commands.compose(spark, args.root, out, err, args.locale, args.out, args.strict)
        if args.command == "verify":
            return commands.verify(spark, args.root, out, err, args.locale)
        if args.command == "seed":
            return commands.seed(spark, args.root, out, err, args.source, args.locale, args.json)
        return commands.init_ids(spark, args.root, out, err, args.check)
    except WorkspaceError as error:
        err(f"error: {error}")
        return int(error.code)
    except OSError as error:
        err(f"error: {error}")
        return int(Exit.IO)


if __name__ == "__main__":
    sys.exit(main())
