"""Command line: list the named queries, run one into a folder, or print its plan.

python -m folioweave list | run NAME TABLES OUT [--format parquet|json|csv] | show NAME TABLES [--rows N] | explain NAME TABLES"""

from __future__ import annotations

import argparse


def main(given: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="folioweave", description="Named queries over a folder of tables.")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    for name, said in (("run", "write a query's rows"), ("show", "print some rows"), ("explain", "print the plan")):
        command = commands.add_parser(name, help=said)
        command.add_argument("name")
        command.add_argument("tables", help="folder of <table>.parquet")
        if name == "run":
            command.add_argument("out")
            command.add_argument("--format", default="parquet", choices=("parquet", "json", "csv"))
        if name == "show":
            command.add_argument("--rows", type=int, default=20)
    args = parser.parse_args(given)
    from .plans import catalogue

    found = catalogue.queries()
    if args.command == "list":
        print("\n".join(sorted(found)))
        return 0
    if args.name not in found:
        parser.error(f"no query {args.name}")
    from .session import local_session

    df = found[args.name](local_session(), args.tables)
    if args.command == "run":
        df.write.mode("overwrite").format(args.format).save(args.out)
    elif args.command == "show":
        df.show(args.rows, truncate=60)
    else:
        df.explain("formatted")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
