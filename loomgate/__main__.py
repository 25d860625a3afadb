"""Command line: ``python -m loomgate list | query NAME SF_DIR [--out PATH] [--limit N] | audit SF_DIR | replay SF_DIR [--out FOLDER]``.

Any query by its name, all rule suites at once, or the replay with its metrics
and gates.  ``audit`` ends with status 1 where a rule is broken.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgate.session import get_session
from loomgate.sources import write_json_document

_CORE = ("anomaly", "scalar", "aggregates", "queueing", "audits", "selections")
#: Rule suites: one row a rule, with ``n_failed``.
SUITES = ("v_cache_rules", "v_cache_fields", "v_cross_tier", "v_measurement_rules", "v_selection_rules", "v_manifest_rules")
REPLAY = ("c_threshold", "m_method_metrics", "m_serial_metrics", "m_tenant_fairness", "t_gates", "t_gate_serial", "v_replay")


def all_queries() -> dict[str, Callable]:
    """Queries of the core by name."""
    out: dict[str, Callable] = {}
    for m in _CORE:
        out.update(importlib.import_module(f"loomgate.plans.{m}").QUERIES)
    return out


def _as_rows(df: DataFrame, limit: int) -> list[dict]:
    return [json.loads(x) for x in df.limit(limit).toJSON().collect()]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomgate", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    one = commands.add_parser("query", help="run one query")
    one.add_argument("name")
    one.add_argument("sf_dir")
    one.add_argument("--out", help="folder for Parquet; else rows are printed as JSON lines")
    one.add_argument("--limit", type=int, default=50, help="rows to print")
    for name in ("audit", "replay"):
        c = commands.add_parser(name)
        c.add_argument("sf_dir")
        c.add_argument("--out", help="file (audit) or folder (replay) for JSON")
    args = parser.parse_args(argv)
    queries = all_queries()
    if args.command == "list":
        print("\n".join(f"{n}  {(queries[n].__doc__ or '').strip().splitlines()[0] if queries[n].__doc__ else ''}".rstrip() for n in sorted(queries)))
        return 0
    if args.command == "query" and args.name not in queries:
        print(f"unknown query: {args.name}", file=sys.stderr)
        return 2
    spark = get_session()
    if args.command == "query":
        df = queries[args.name](spark, args.sf_dir)
        if args.out:
            df.write.mode("errorifexists").parquet(args.out)
        else:
            for row in _as_rows(df, args.limit):
                print(json.dumps(row, ensure_ascii=False))
        return 0
    if args.command == "audit":
        broken = []
        for suite in SUITES:
            rows = queries[suite](spark, args.sf_dir).filter(F.col("n_failed") > 0)  # a few rows a suite
            broken += [{"suite": suite, **r} for r in _as_rows(rows, 10_000)]
        report = {"status": "fail" if broken else "pass", "broken": broken}
        if args.out:
            write_json_document(report, args.out)
        print(json.dumps(report, ensure_ascii=False))
        return 1 if broken else 0
    for name in REPLAY:
        rows = _as_rows(queries[name](spark, args.sf_dir), 10_000)  # a few rows a scenario
        if args.out:
            write_json_document(rows, f"{args.out}/{name}.json")
        print(json.dumps({"query": name, "n_rows": len(rows)}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
