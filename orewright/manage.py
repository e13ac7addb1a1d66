"""``python -m orewright.manage reset|purge [--warehouse DIR] [names]``: drops the tables of sources (all if none is named), or with
``purge`` the whole warehouse. Asks first unless ``--yes`` is given."""

from __future__ import annotations

import argparse
import sys

from .operators.store import Store
from .plans import bronze
from .settings import load_env, session


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("what", choices=("reset", "purge"))
    p.add_argument("names", nargs="*", help="sources; all if none is named")
    p.add_argument("--warehouse", default="warehouse")
    p.add_argument("--yes", action="store_true")
    a = p.parse_intermixed_args(args)
    names = bronze.chosen(a.names)
    goal = a.warehouse if a.what == "purge" else ", ".join(names)
    if not a.yes and input(f"{a.what} {goal}? [y/N] ").strip().lower() not in ("y", "yes"):
        return 1
    load_env()
    store = Store(session(), a.warehouse)
    if a.what == "purge":
        store.files.delete(store.root)
    else:
        for name in names:
            store.drop(bronze.SOURCES[name].table)
    print(f"{a.what}: {goal}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
