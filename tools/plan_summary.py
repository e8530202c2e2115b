"""Per-query physical plan summary: shuffles, join strategies, top-k operators and
scan pruning (partition / pushed filters). Prints a markdown table.

usage: python tools/plan_summary.py [sf_dir] [key ...]
"""
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402


def summary(plan: str) -> dict:
    joins = sorted(set(re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin)"
                                  r" \[[^\]]*\], \[[^\]]*\], (\w+)", plan)))
    shuffles = set(re.findall(r"\bExchange (?:hashpartitioning|rangepartitioning|RoundRobin|SinglePartition)[^\n]*"
                              r"\[plan_id=(\d+)\]", plan))
    return {
        "shuffles": len(shuffles),
        "joins": ", ".join(f"{a.replace('Join', '')}:{b}" for a, b in joins) or "-",
        "topk": "yes" if re.search(r"WindowGroupLimit|TakeOrderedAndProject", plan) else "-",
        "partition filters": "yes" if re.search(r"PartitionFilters: \[(?!\])", plan) else "-",
    }


def main():
    from sessionscope.registry import QUERIES
    from sessionscope.session import build_session
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    keys = [a for a in args if not a.startswith("/")] or [k for k in HEADLINE if not k.startswith("i8")]
    spark = build_session("local[4]", shuffle_partitions=8)
    print("| query | shuffles | joins (strategy:type) | partial top-k | partition filters |")
    print("|---|---|---|---|---|")
    for k in keys:
        plan = QUERIES[k][0](spark, sf)._jdf.queryExecution().executedPlan().toString()
        s = summary(plan)
        print(f"| {k} | {s['shuffles']} | {s['joins']} | {s['topk']} | {s['partition filters']} |")


if __name__ == "__main__":
    main()
