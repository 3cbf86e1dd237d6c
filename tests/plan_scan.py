"""List queries whose physical plan holds a row-pair join or a window in a single task."""

from __future__ import annotations

import re
import sys

from tonearm import plans
from tonearm.session import local_session


def problems(df) -> list[str]:
    text = df._jdf.queryExecution().executedPlan().toString()
    found = [name for name in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython") if name in text]
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if re.search(r"Window .*windowspecdefinition", line) and any("SinglePartition" in x for x in lines[i + 1 : i + 6]):
            found.append("Window in one task")
    return sorted(set(found))


def main() -> None:
    spark = local_session(shuffle_partitions=4)
    for name in sys.argv[1:] or plans.queries():
        bad = problems(plans.queries()[name](spark, "/root/testdata/sf0.001"))
        if bad:
            print(name, bad, flush=True)
    print("scanned")


if __name__ == "__main__":
    main()
