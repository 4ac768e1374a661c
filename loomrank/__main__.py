"""python -m loomrank build DUMP INDEX | ask INDEX [QUERY...] [--stop-words FILE] [--low] [--fields] [--lower-bound]

build reads the XML files of the folder DUMP whose names begin with x. ask answers the queries given, else one per line
of the standard input until it ends, and prints the rank and title of the results and the time taken.
"""

from __future__ import annotations

import argparse
import dataclasses
import sys
import time
from collections.abc import Iterable

from pyspark.sql import SparkSession

from loomrank.config import DEFAULT
from loomrank.operators.search import Engine
from loomrank.sources.dump import numbered, read_dump, read_stop_words
from loomrank.sources.tables import temporary


def ask(engine: Engine, queries: Iterable[str], out=None) -> None:
    out = out or sys.stdout
    for query in queries:
        began = time.monotonic()
        for r in engine.search(query.rstrip("\n")).collect():  # 10 rows at most
            print(f"{r['rank']} : {r['title']}", file=out)
        print(f"Time {(time.monotonic() - began) * 1000:.0f}ms\n", file=out, flush=True)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="loomrank", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build")
    build.add_argument("dump")
    build.add_argument("index")
    build.add_argument("--stop-words")
    asking = commands.add_parser("ask")
    asking.add_argument("index")
    asking.add_argument("query", nargs="*")
    for flag in ("--low", "--fields", "--lower-bound"):
        asking.add_argument(flag, action="store_true")
    got = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("loomrank").getOrCreate()
    if got.command == "build":
        cfg = dataclasses.replace(DEFAULT, stop_words=read_stop_words(spark, got.stop_words)) if got.stop_words else DEFAULT
        with temporary(spark):
            engine = Engine(spark, cfg).build(numbered(read_dump(spark, got.dump)))
            engine.save(got.index)
            engine.counters().show()
    else:
        engine = Engine.load(spark, got.index)
        engine.cfg = dataclasses.replace(engine.cfg, include_low=got.low, enforce_fields=got.fields, lower_bound=got.lower_bound)
        ask(engine, got.query or sys.stdin)


if __name__ == "__main__":
    main()
