"""Show what a query's final plan does: exchanges, reuse, scans, joins, Python steps.

    python tools/plan.py /root/testdata/sf0.01 name ...     (PLAN=1 prints the whole plan)
"""

import os
import re
import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from trialspark.plans import catalog  # noqa: E402
from trialspark.session import build  # noqa: E402

spark = build("plan", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false",
                                     "spark.sql.autoBroadcastJoinThreshold": os.environ.get("BROADCAST", "10485760")})
spark.sparkContext.setLogLevel("ERROR")
for name in sys.argv[2:] or catalog.QUERIES:
    df = catalog.QUERIES[name](spark, sys.argv[1])
    df.write.format("noop").mode("overwrite").save()
    text = df._jdf.queryExecution().toString()
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString()
    final = final.split("+- == Initial Plan ==")[0]
    ops = re.findall(r"(ReusedExchange|Exchange|BroadcastExchange|FileScan|Scan parquet|SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin|"
                     r"BroadcastNestedLoopJoin|CartesianProduct|Window(?:GroupLimit)?|ArrowEvalPython|MapInArrow|BatchEvalPython|Sort|Generate) ", final)
    print(name, dict(Counter(ops)), flush=True)
    if os.environ.get("PLAN"):
        print(final)
