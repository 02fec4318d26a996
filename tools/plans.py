"""Print the physical operator tree of the headline queries (no expressions).

Usage: python tools/plans.py [sf_dir] > PLANS.md
"""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KEYS = ["ndjson_scan", "typed_documents", "first_error", "text_postings", "term_dictionary",
        "bm25_topk", "fetch_stored", "version_state_fold", "resolve_versions", "register_indexes",
        "integrity_check", "archive_entry_audit"]


def compact(plan: str) -> str:
    out = []
    for line in plan.splitlines():
        m = re.match(r"^([\s:+\-|]*)(\*\(\d+\) )?([A-Za-z]+)(.*)$", line)
        if not m:
            continue
        indent, cg, op, rest = m.groups()
        extra = ""
        if op in ("Exchange",):
            extra = " " + rest.strip().split(",")[0].split("(")[0]
        if op in ("FileScan", "Scan"):
            pf = re.search(r"PushedFilters: \[([^\]]*)\]", rest)
            extra = " " + rest.strip().split(" ")[0] + (f" PushedFilters=[{pf.group(1)[:120]}]" if pf and pf.group(1) else "")
        out.append(f"{indent}{cg or ''}{op}{extra}")
    return "\n".join(out)


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from lexidx.plans import registry
    from lexidx.session import build_session
    spark = build_session("local[8]")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # show the static plan
    print("# Physical plans of the headline queries\n")
    print(f"Generated by `python tools/plans.py {sf_dir}` (AQE off to show the static plan;")
    print("`*(n)` marks whole-stage codegen). Operators only, expressions omitted.\n")
    for k in KEYS:
        df = registry.QUERIES[k](spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"## {k}\n\n```\n{compact(plan)}\n```\n")


if __name__ == "__main__":
    main()
