"""Run registered queries against their oracles: python tests/check_catalog.py [sf_dir] [name or module ...]"""

import sys

sys.path.insert(0, ".")

from pollwarden import catalog  # noqa: E402
from pollwarden.session import local_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    mods = [m for m in catalog.MODULES if m in wanted]
    if mods:
        catalog.MODULES[:] = mods
    queries, oracles = catalog.load()
    if wanted and not mods:
        queries = {k: v for k, v in queries.items() if k in wanted}
    spark = local_session("check")
    con = connect(sf_dir)
    bad = []
    for name, fn in queries.items():
        try:
            ok, note, took = compare(spark, name, fn, oracles.get(name), sf_dir, con)
        except Exception as exc:  # noqa: BLE001
            ok, note, took = False, f"{type(exc).__name__}: {str(exc)[:700]}", 0.0
        if not ok:
            bad.append(name)
        print(("ok  " if ok else "BAD ") + f"{name} {took:.2f}s {note}", flush=True)
    print(f"{len(queries) - len(bad)}/{len(queries)} ok; bad: {bad}")
    spark.stop()


if __name__ == "__main__":
    main()
