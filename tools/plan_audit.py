"""Scan the physical plans of registered queries for shapes that do not scale:
nested-loop / cartesian joins, single-partition exchanges, windows without a
partition key and shuffle joins keyed by the tenant alone, with size-based broadcasts switched off
(small test data would hide every shuffle join). Streams and the ingest run are left out: their result is a plain read
of what their jobs wrote, and tests/test_scale.py looks at those jobs.

usage: python tools/plan_audit.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

BAD = {
    "nested-loop join": re.compile(r"BroadcastNestedLoopJoin|CartesianProduct"),
    "single-partition exchange": re.compile(r"Exchange SinglePartition"),
    "window without partition key": re.compile(r"windowspecdefinition\((?:[^,()]+ (?:ASC|DESC)[^,()]*,\s*)+specifiedwindowframe"),
    # a shuffle join on the tenant alone sends each tenant's rows to one reducer
    "shuffle join on tenant alone": re.compile(r"(?:SortMergeJoin|ShuffledHashJoin) \[tenant_id#\d+\], \[tenant_id#\d+\]"),
}
# The feature itself joins on the tenant: a job without target branches goes to all recipients of its tenant.
ACCEPTED = {("r9_dispatch_plan", "shuffle join on tenant alone"), ("f1_sql_views_overview", "shuffle join on tenant alone")}


JOBS = ("st1_", "st2_", "ingest_run")


def audit(spark, sf_dir, keys=None):
    from sessionscope.registry import ALIASES, QUERIES
    problems = {}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for k, (fn, _sql) in QUERIES.items():
            if (keys and k not in keys) or k in ALIASES or k.startswith(JOBS):
                continue
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
            df = fn(spark, sf_dir)
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
            hits = [name for name, rx in BAD.items() if rx.search(plan) and (k, name) not in ACCEPTED]
            if hits:
                problems[k] = hits
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    return problems


if __name__ == "__main__":
    from sessionscope.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    found = audit(build_session("local[4]", shuffle_partitions=4), sf)
    for k, v in sorted(found.items()):
        print(f"{k}: {', '.join(v)}")
    print("queries with findings:", len(found))
