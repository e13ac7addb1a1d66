"""``python -m orewright.check [--data DIR] [--warehouse DIR] [names]``: rows in files against rows in tables; exit code 0 or 1."""

from __future__ import annotations

import sys

from .operators.store import Store
from .plans import bronze, checks
from .run import parser
from .settings import load_env, session


def main(args: list[str] | None = None) -> int:
    a = parser(__doc__).parse_args(args)
    bronze.chosen(a.names)
    load_env()
    rows = checks.completeness(Store(session(), a.warehouse), a.data, a.names).collect()
    for r in rows:
        told = f"{r.in_table:>10,} / {r.in_file:>10,} rows  {r.status} {r.difference:+,}" if r.in_file is not None else r.status
        print(f"  {r.table:<32} {told}")
    failed = sum(not r.ok for r in rows)
    print(f"{failed} of {len(rows)} sources incomplete." if failed else f"All {len(rows)} sources complete.")
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
