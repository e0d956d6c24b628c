"""`python tests/check.py [sf_dir] [name prefix ...]`: run registered queries against their SQL."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402
from __spark_entry__ import oracle_sql, queries  # noqa: E402
from tabulon.session import build_session  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = oracle.connect(sf), oracle_sql()
    bad = 0
    for name, build in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = build(spark, sf)
            if name in sql:
                problems = oracle.compare(name, df, con, sql[name])
            else:
                problems = [] if df.collect() else [f"{name}: no rows"]
        except Exception as e:
            problems = [f"{name}: {type(e).__name__} {str(e)[:1500]}"]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += bool(problems)
        print("BAD " if problems else "ok  ", name, "" if name in sql else "(rows only)", f"{time.time() - start:.1f}s", flush=True)
        for p in problems:
            print("   ", p, flush=True)
    print("failed:", bad)
