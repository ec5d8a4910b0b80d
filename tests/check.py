"""``python tests/check.py [sf] [query …]``: run queries next to their SQL."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from reviewlake.session import local_session  # noqa: E402
from tests.harness import difference, views  # noqa: E402

if __name__ == "__main__":
    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{scale}"
    spark, con = local_session(), views(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[2:] or list(queries)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                problem = difference(df, con, oracles[name])
            else:
                n = df.count()
                problem = None if n else "no rows"
                name += f" (rows only: {n})"
        except Exception as error:
            problem = "".join(traceback.format_exception_only(error))[:1500]
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(wanted)} queries, {bad} bad")
