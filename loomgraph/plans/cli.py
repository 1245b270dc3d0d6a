"""Command line: scan, query, expand, eval, stats and config validation over a stored graph."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os
import sys

from pyspark.sql import SparkSession

from loomgraph.plans import evaluate as E
from loomgraph.plans.engine import Engine, rendered
from loomgraph.sources.config import ConfigError, load_config, load_judgments, validate_config


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="loomgraph")
    out.add_argument("--store", default="graph", help="folder of the stored graph")
    todo = out.add_subparsers(dest="command", required=True)
    for name, arguments in {
        "scan": [("config", {}), ("--force", {"action": "store_true"})],
        "query": [("hint", {}), ("--top", {"type": int, "default": 5}), ("--json", {"action": "store_true"})],
        "expand": [("name", {})],
        "eval": [("judgments", {}), ("--top", {"type": int, "default": 5}), ("--min-hit-rate", {"type": float}), ("--min-mrr", {"type": float})],
        "stats": [],
        "validate": [("config", {})],
    }.items():
        sub = todo.add_parser(name)
        for flag, options in arguments:
            sub.add_argument(flag, **options)
    return out


def main(argv: list[str] | None = None) -> int:
    """0: done; 1: a gate or a configuration failed; 2: a file can't be used."""
    args = parser().parse_args(argv)
    if args.command == "validate":
        with open(args.config, encoding="utf-8") as f:
            errors, warnings = validate_config(json.load(f), os.path.dirname(os.path.abspath(args.config)))
        for line in (*errors, *warnings):
            print(line)
        return int(bool(errors))
    spark = SparkSession.builder.appName("loomgraph").getOrCreate()
    engine, now = Engine(spark, args.store), dt.datetime.now(dt.UTC)
    try:
        if args.command == "scan":
            engine.scan(load_config(args.config), now, args.force)
            for what in ("read", "reused", "dropped", "missing"):
                for name in getattr(engine.report, what):
                    print(f"{what}: {name}")
            print("\n".join(engine.report.warnings + engine.store.diagnose()), file=sys.stderr)
            return int(bool(engine.store.diagnose()))
        elif args.command == "query":
            answer = engine.ask(args.hint, now, args.top)
            print(json.dumps(answer) if args.json else rendered(answer))
        elif args.command == "expand":
            _show(engine.expand(spark.createDataFrame([(args.name,)], "name string")).orderBy("source_id", "rank"))
        elif args.command == "stats":
            _show(engine.stats().orderBy("kind", "n", ascending=[True, False]))
        else:
            scores = E.gate(E.metrics(engine.evaluate(load_judgments(spark, args.judgments), args.top)), args.min_hit_rate, args.min_mrr)
            _show(scores)
            return int(not scores.first()["passed"])
    except (ConfigError, OSError) as e:
        print(e, file=sys.stderr)
        return 2
    return 0


def _show(rows) -> None:
    for line in rows.toJSON().toLocalIterator():
        print(line)


if __name__ == "__main__":
    sys.exit(main())
