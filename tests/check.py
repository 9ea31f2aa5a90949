"""python tests/check.py [folder] [name ...]: compare queries with their SQL twins, with timings."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry
from harness import compare, duck
from panelwright.session import build_session

if __name__ == "__main__":
    folder = sys.argv[1]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, q, sql = duck(folder), entry.queries(), entry.oracle_sql()
    names = [n for n in q if not sys.argv[2:] or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in sys.argv[2:])]
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = q[n](spark, folder)
            got = compare(df, con, sql[n]) if n in sql else ("rows " + str(len(df.collect())) + " (no twin)")
        except Exception as e:
            got = "ERROR " + str(e)[:600]
            if os.environ.get("TB"):
                traceback.print_exc()
        spark.catalog.clearCache()
        ok = got is None or "no twin" in got
        bad += not ok
        print(f"{'ok  ' if ok else 'BAD '} {time.time() - t0:6.1f}s {n} {got or ''}", flush=True)
    print("bad:", bad, "of", len(names))
