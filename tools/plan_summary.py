"""Summarise what every registered query executes into PLANS.md.

usage: python tools/plan_summary.py [sf_dir]

Every query is forced with a ``noop`` write while Spark writes its event log into a scratch
folder; the final (adaptive) plans of all jobs that ran meanwhile are counted, those that
run while the frame is being built included. Queries of the separate part are left out.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time
from collections import Counter, defaultdict
from pathlib import Path

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

OPERATORS = re.compile(r"Join|Exchange$|Aggregate|Window|TakeOrdered|Python|Pandas|Arrow|Expand|CartesianProduct|^Scan parquet")


def nodes(plan: dict) -> list[str]:
    return [re.sub(r"\s+$|\s*\(.*", "", plan["nodeName"]), *[n for c in plan["children"] for n in nodes(c)]]


def executed(log_dir: str, spans: list[tuple[str, float, float]]) -> dict[str, tuple[int, Counter]]:
    """Of every query, the number of executions and the operators in their final plans."""
    begun, plans = {}, {}
    for path in Path(log_dir).rglob("*"):
        for line in path.open(errors="replace") if path.is_file() else ():
            if "sparkPlanInfo" not in line:
                continue
            event = json.loads(line)
            plans[event["executionId"]] = nodes(event["sparkPlanInfo"])  # the last is the one that ran
            if "time" in event:
                begun[event["executionId"]] = event["time"] / 1000
    out = defaultdict(lambda: (0, Counter()))
    for execution, at in begun.items():
        for name, start, end in spans:
            if start <= at <= end:
                n, counts = out[name]
                out[name] = (n + 1, counts + Counter(x for x in plans[execution] if OPERATORS.search(x)))
    return out


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    log_dir = tempfile.mkdtemp(prefix="carelake-events-")
    os.environ["PYSPARK_SUBMIT_ARGS"] = (f"--conf spark.eventLog.enabled=true --conf spark.eventLog.dir=file://{log_dir} "
                                         "--conf spark.eventLog.compress=false pyspark-shell")
    from carelake.plans import catalog  # noqa: F401
    from carelake.plans.registry import REGISTRY
    from carelake.session import get_session
    spark = get_session("plan-summary")
    spans = []
    for name, query in REGISTRY.items():
        start = time.time()
        query.run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        spans.append((name, start, time.time()))
    spark.stop()
    found = executed(log_dir, spans)
    lines = ["# Executed plans (final adaptive plans, sf0.01)", "",
             "Operators in the plans of everything a query executes, jobs that run while its frame is built included.",
             "A stream's first query holds its run; the others read what it has stored.", "",
             "| query | executions | operators |", "| --- | --- | --- |"]
    for name, _, _ in spans:
        n, counts = found[name]
        lines.append(f"| {name} | {n} | {', '.join(f'{k}×{v}' for k, v in sorted(counts.items()))} |")
    out = os.path.join(ROOT, "PLANS.md")
    with open(out, "w") as f:
        f.write("\n".join(lines) + "\n")
    print(out)


if __name__ == "__main__":
    main()
