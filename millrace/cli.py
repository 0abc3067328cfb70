"""Command line: python -m millrace.cli COMMAND ... ; results are JSON lines, exit code 2 for advice against a run."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from millrace.plans.api import Engine
from millrace.plans.model import CostRates, Intent, NotRecommended, RuntimeContext
from millrace.session import session


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace")
    p.add_argument("--store", default="./millrace-store")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("profile", "plan", "execute", "benchmark", "replay", "inspect", "history"):
        c = sub.add_parser(name)
        c.add_argument("object")
        c.add_argument("--source", default="parquet")
        c.add_argument("--config", default="{}", help="JSON of the source")
        c.add_argument("--key")
        c.add_argument("--output", default="./output")
        c.add_argument("--format", default="parquet", choices=["parquet", "csv", "s3", "gcs"])
        c.add_argument("--context", help="JSON file of the runtime context")
        c.add_argument("--priority")
        c.add_argument("--max-workers", type=int)
        c.add_argument("--force", action="store_true")
        c.add_argument("--run")
        c.add_argument("--compute-rate", type=float, default=0.0)
        c.add_argument("--egress-rate", type=float, default=0.0)
        c.add_argument("--connection-rate", type=float, default=0.0)
    for name in ("explain", "diagnose", "metrics"):
        sub.add_parser(name).add_argument("run")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    a = _parser().parse_args(argv)
    engine = Engine(spark or session(), a.store)
    show = lambda x: print(json.dumps(x, default=str))
    if a.command in ("explain", "diagnose", "metrics"):
        try:
            show(getattr(engine, a.command)(a.run))
        except KeyError as e:
            print(e, file=sys.stderr)
            return 1
        return 0
    if a.command in ("inspect", "history"):
        out = getattr(engine, a.command)(a.source, a.object)
        show(out)
        return {"HEALTHY": 0, "NEEDS ATTENTION": 1, "DEGRADED": 2}.get(out["verdict"], 0) if a.command == "inspect" else 0
    from millrace.plans.model import Constraints

    intent = Intent(a.source, json.loads(a.config), a.object, a.key, target_type=a.format, target_config={"path": a.output}, constraints=Constraints(max_workers=a.max_workers))
    if a.command == "profile":
        show(engine.profile(intent))
        return 0
    if a.command == "benchmark":
        show(engine.benchmark(intent))
        return 0
    if a.command == "replay":
        out = engine.replay(intent, a.run, a.force)
        show(asdict(out))
        return 0 if out.status == "success" else 1
    declared = json.load(open(a.context)) if a.context else None
    context = RuntimeContext.build(declared, priority=a.priority)
    planned = engine.plan(intent, context, CostRates(a.compute_rate, a.egress_rate, a.connection_rate))
    if a.command == "plan":
        show({"plan": planned.plan.to_dict(), "origin": planned.origin, "verdict": planned.verdict, "advisories": planned.advisories, "cost": planned.cost, "options": planned.options})
        return 0
    try:
        out = engine.execute(intent, planned, a.force)
    except NotRecommended as e:
        print(e, file=sys.stderr)
        return 2
    show(asdict(out))
    return 0 if out.status == "success" else 1


if __name__ == "__main__":
    sys.exit(main())
