"""Command line check: python tests/check.py <folder> [name prefix ...]"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
sys.path.insert(0, os.path.dirname(__file__))

from conftest import make_session  # noqa: E402
from oracle import compare  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def main() -> int:
    folder, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark = make_session()
    sql, bad = entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            if name in sql:
                problem = compare(spark, folder, build, sql[name])
            else:
                problem = None if build(spark, folder).count() else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += problem is not None
        kind = "sql" if name in sql else "rows"
        print(f"{'FAIL' if problem else 'ok':4} {kind} {time.time() - start:5.1f}s {name} {problem or ''}", flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
