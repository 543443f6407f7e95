"""The command line: ``python -m tempolake STORE ingest | worklist | themes | report ...``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .plans import chain, report
from .sources import pgn
from .sources.store import Store


def _parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tempolake")
    out.add_argument("store", help="folder of the store")
    sub = out.add_subparsers(dest="command", required=True)
    one = sub.add_parser("ingest", help="games, moves, positions and themes of PGN files")
    one.add_argument("pgn", help="file or folder")
    one.add_argument("--subject", required=True)
    one.add_argument("--evals", help="Parquet table of evaluations")
    one.add_argument("--depth", type=int, default=12)
    one = sub.add_parser("worklist", help="positions that are yet to be evaluated, as Parquet")
    one.add_argument("out")
    one.add_argument("--depth", type=int, default=12)
    sub.add_parser("themes", help="how often each theme is marked")
    one = sub.add_parser("report", help="the report on a player")
    one.add_argument("subject")
    one.add_argument("--json", action="store_true")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tempolake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, args.store)
    if args.command == "ingest":
        evals = spark.read.parquet(args.evals) if args.evals else None
        print(json.dumps(chain.ingest(store, pgn.read_games(spark, args.pgn), args.subject, evals, args.depth)))
    elif args.command == "worklist":
        chain.work_list(store, args.depth).write.mode("overwrite").parquet(args.out)
    elif args.command == "themes":
        for theme, n in store.read("move_themes").groupBy("theme").count().orderBy("theme").collect():  # a row a theme
            print(theme, n)
    else:
        made = chain.prepare_report(store, args.subject)
        print(json.dumps(report.to_dict(made), default=str) if args.json else report.render_markdown(made["claims"], args.subject))


if __name__ == "__main__":
    main()
