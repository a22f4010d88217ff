"""Command line: convert, inspect, tail, export."""

from __future__ import annotations

import argparse
import json
import sys

from turnstore.session import get_spark
from turnstore.store import Session, Store


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="turnstore")
    sub = parser.add_subparsers(dest="command", required=True)
    convert = sub.add_parser("convert", help="take in JSONL session logs")
    convert.add_argument("inputs", nargs="+")
    convert.add_argument("-o", "--out", required=True)
    convert.add_argument("--session-id")
    convert.add_argument("--overwrite", action="store_true")
    inspect = sub.add_parser("inspect", help="summary of a store as JSON")
    inspect.add_argument("store")
    tail = sub.add_parser("tail", help="last turns of a session")
    tail.add_argument("store")
    tail.add_argument("session")
    tail.add_argument("-n", type=int, default=20)
    export = sub.add_parser("export", help="a session as JSONL")
    export.add_argument("store")
    export.add_argument("out")
    export.add_argument("--session-id")
    export.add_argument("--overwrite", action="store_true")
    for p in (convert, inspect, tail, export):
        p.add_argument("--format", default="parquet", choices=["parquet", "orc"])
    args = parser.parse_args(argv)
    if args.command == "convert" and args.session_id and len(args.inputs) > 1:
        print("--session-id goes with one input only", file=sys.stderr)
        return 2
    spark = get_spark()
    if args.command == "convert":
        print(json.dumps(Store(spark, args.out, args.format).convert(args.inputs, args.session_id, args.overwrite)))
    elif args.command == "inspect":
        for row in Store(spark, args.store, args.format).inspect().toLocalIterator():
            print(json.dumps(row.asDict()))
    elif args.command == "tail":
        for row in Session(Store(spark, args.store, args.format), args.session).get_recent_context(args.n).toLocalIterator():
            print(f"[{row['role']}] {row['content']}")
    else:
        Store(spark, args.store, args.format).export(args.out, args.session_id, args.overwrite)
    return 0


if __name__ == "__main__":
    sys.exit(main())
