"""Compare every registered query (or those named) with its SQL: python -m tests.check [names...]"""

import sys
import time

sys.path.insert(0, "/root/repo")


def main(names):
    import os

    from tests.harness import compare, connect
    from veilgauge.plans import all_queries
    from veilgauge.session import build

    spark = build(master="local[8]", partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    con = connect(sf)
    queries, oracles = all_queries()
    picked = [n for n in queries if not names or any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in names)]
    bad = 0
    for n in picked:
        t = time.time()
        try:
            df = queries[n](spark, sf)
            if n in oracles:
                problem = compare(df, oracles[n], con)
                state = "ok" if problem is None else "DIFF " + problem
            else:
                state = f"rows {df.count()}"
        except Exception as e:  # noqa: BLE001 - report and go on
            state = "ERROR " + str(e)[:1500]
        if state.startswith(("DIFF", "ERROR")):
            bad += 1
        if names or state.startswith(("DIFF", "ERROR")) or time.time() - t > 3:
            print(f"{n:28s} {time.time() - t:5.1f}s {state}", flush=True)
    print(f"{len(picked) - bad}/{len(picked)} fine", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
