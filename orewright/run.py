"""``python -m orewright.run [--data DIR] [--warehouse DIR] [--silver] [names]``: loads sources into bronze, and silver on demand."""

from __future__ import annotations

import argparse
import sys

from .operators.store import Store
from .plans import bronze, silver
from .settings import load_env, session


def parser(text: str | None) -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=text)
    p.add_argument("names", nargs="*", help="sources; all if none is named")
    p.add_argument("--data", default="data")
    p.add_argument("--warehouse", default="warehouse")
    return p


def main(args: list[str] | None = None) -> int:
    p = parser(__doc__)
    p.add_argument("--silver", action="store_true", help="build the silver schools afterwards")
    a = p.parse_intermixed_args(args)
    bronze.chosen(a.names)
    load_env()
    store = Store(session(), a.warehouse)
    for name in bronze.chosen(a.names):
        done = bronze.load(store, bronze.SOURCES[name], a.data)
        print(f"{done.table}: {done.rows} rows from {done.source}")
    if a.silver:
        print(f"silver.school: {silver.build_schools(store)} rows")
    return 0


if __name__ == "__main__":
    sys.exit(main())
