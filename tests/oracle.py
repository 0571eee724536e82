"""Run a registered query and its SQL side by side and compare.

    python -m tests.oracle [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else float(f"{v:.12g}"))
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return v


def compare(spark, sf_dir: str, query, sql: str | None) -> tuple[bool, str]:
    t0 = time.time()
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    mine = [tuple(canon(r[c]) for c in cols) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return len(mine) > 0, f"rows-only {len(mine)} spark {t1 - t0:.1f}s"
    con = connect(sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    duck_types = {d[0]: str(d[1]) for d in cur.description}
    if sorted(names) != cols:
        return False, f"columns {cols} != {sorted(names)}"
    at = [names.index(c) for c in cols]
    theirs = [tuple(canon(r[i]) for i in at) for r in cur.fetchall()]
    t2 = time.time()
    note = f"rows {len(mine)}/{len(theirs)} spark {t1 - t0:.1f}s sql {t2 - t1:.1f}s"
    want = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    bad_types = [
        (n, t, duck_types[n]) for n, t in df.dtypes if t in want and duck_types[n] not in (want[t], "STRING", "NUMBER", "bool")
        and want[t] != duck_types[n]
    ]
    if bad_types:
        return False, f"types {bad_types} {note}"
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a, b = sorted(mine, key=key), sorted(theirs, key=key)
    if a == b:
        return len(a) > 0, note if a else "EMPTY " + note
    sa, sb = set(a), set(b)
    return False, f"{note} only spark {sorted(sa - sb, key=key)[:3]} only sql {sorted(sb - sa, key=key)[:3]}"


def main(argv: list[str]) -> int:
    sf = "0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2 :]
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tallyloom.session import local_session

    spark = local_session()
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, query in queries.items():
        if argv and not any(name == a or name.startswith(a + "_") for a in argv):
            continue
        try:
            ok, note = compare(spark, f"/root/testdata/sf{sf}", query, sqls.get(name))
        except Exception as e:  # noqa: BLE001
            text = str(e)
            ok, note = False, f"{type(e).__name__} {text[:700]}"
        failed += not ok
        print(("ok  " if ok else "FAIL"), name, note, flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
