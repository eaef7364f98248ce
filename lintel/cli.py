"""python -m lintel.cli check --rules FILE --root DIR [--format human|json|github] [--range SPEC | --staged] [--cost-max C] [--gitignore]
python -m lintel.cli check-content --rules FILE (--path PATH | --batch) [--all-findings] < content
python -m lintel.cli test --rules FILE --root FIXTURES (a folder for each rule id)

Exit code 0: no error was found; 1: some were; 2: the rules can't be used or the run failed.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from lintel.plans import content, engine, fixtures, rules
from lintel.sources import corpus, reports


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lintel", description=__doc__)
    parser.add_argument("verb", choices=["check", "check-content", "test", "list", "rules-for"])
    parser.add_argument("paths", nargs="*")
    parser.add_argument("--rules", required=True)
    parser.add_argument("--root", default=".")
    parser.add_argument("--format", default="human", choices=["human", "json", "github"])
    parser.add_argument("--range")
    parser.add_argument("--staged", action="store_true")
    parser.add_argument("--cost-max", default="heavy", choices=rules.COSTS)
    parser.add_argument("--gitignore", action="store_true")
    parser.add_argument("--path")
    parser.add_argument("--batch", action="store_true")
    parser.add_argument("--all-findings", action="store_true")
    parser.add_argument("--generated", action="append", default=[])
    parser.add_argument("--tests", action="append", default=[])
    args = parser.parse_args(argv)
    try:
        known = rules.load(open(args.rules).read())  # noqa: SIM115
        kept, dropped = rules.up_to_cost(known, args.cost_max)
        spark = SparkSession.builder.appName("lintel").getOrCreate()
        if args.verb == "list":
            rules.as_table(spark, known).show(len(known), False)
            return 0
        if args.verb == "rules-for":
            rows = spark.createDataFrame([(p,) for p in args.paths], "path string")
            for r in known:
                print(*[r.id for _ in engine.in_scope(rows, r, args.tests).limit(1).collect()])
            return 0
        if args.verb == "check-content":
            if args.batch == bool(args.path):
                raise rules.ConfigError("either --path or --batch")
            records = corpus.records(sys.stdin.read()) if args.batch else [(args.path, sys.stdin.buffer.read())]
            documents = content.check(spark, records, kept, args.tests, args.generated)
            print(*(json.dumps(d if args.all_findings else content.shortened(d)) for d in documents), sep="\n")
            return int(content.failed(documents))
        if args.verb == "test":
            arms = [a for r in kept if os.path.isdir(os.path.join(args.root, r.id)) for a in fixtures.run(spark, r, os.path.join(args.root, r.id), args.tests, args.generated)]
            if not arms:
                raise rules.ConfigError("no fixture was found")
            print(json.dumps(fixtures.report(arms)))
            return int(not all(a.passed for a in arms))
        files, _ = corpus.tree(spark, args.root)
        if args.gitignore:
            files = corpus.prune(files, corpus.ignored(args.root))
        changed = corpus.staged(args.root) if args.staged else corpus.in_range(args.root, args.range) if args.range else None
        part = None if changed is None else corpus.restrict(files, changed).select("path")
        found = reports.collected(engine.evaluate(files, kept, part, args.tests, generated=args.generated))
        print({"human": reports.human, "json": reports.as_json, "github": reports.github}[args.format](kept, found), end="")
        if dropped:
            print(f"not run: {', '.join(r.id for r in dropped)}", file=sys.stderr)
        return int(any(f["severity"] == "error" for f in found))
    except Exception as e:  # whatever stops a run must not look like a verdict
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
