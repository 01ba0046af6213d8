"""Compare queries with their oracles: python -m catalog [sf_dir] [name ...]."""

from __future__ import annotations

import sys
import time

import catalog
from catalog.compare import compare, connect
from catalog.registry import ORACLES, QUERIES
from postsift.session import local_session


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    catalog.load()
    names = argv[1:] or list(QUERIES)
    spark, con, failed = local_session(), connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            wrong = compare(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001 - the report goes on with the next query
            wrong = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += wrong is not None
        kind = "" if name in ORACLES else " (rows only)"
        print(f"{'FAIL' if wrong else 'ok':4} {name}{kind} {time.time() - start:.1f}s {wrong or ''}")
        sys.stdout.flush()
    print(f"{len(names) - failed} of {len(names)} equal")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
