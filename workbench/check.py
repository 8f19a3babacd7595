"""Run registered queries on both engines and compare their rows.

    python -m workbench.check SF_DIR [key ...]
"""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(sf_dir, name)}.parquet'")
    return con


def shown(value) -> str:
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    return str(value)


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(shown(row[i]) for i in order) for row in rows)


def difference(spark, con, registered, sf_dir: str) -> tuple[str, float, float]:
    """('' if equal, seconds in Spark, seconds in the other engine)"""
    start = time.time()
    df = registered.run(spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    ours_took = time.time() - start
    if registered.sql is None:
        return "", ours_took, 0.0
    start = time.time()
    cursor = con.execute(registered.sql)
    columns = [d[0] for d in cursor.description]
    theirs = rows_of(columns, cursor.fetchall())
    took = time.time() - start
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}", ours_took, took
    if ours != theirs:
        only_ours, only_theirs = ours - theirs, theirs - ours
        return (
            f"{sum(ours.values())} rows against {sum(theirs.values())};"
            f" only ours {sum(only_ours.values())}: {list(only_ours)[:3]};"
            f" only theirs {sum(only_theirs.values())}: {list(only_theirs)[:3]}"
        )[:1500], ours_took, took
    return ("" if ours else "EMPTY"), ours_took, took


def main() -> None:
    from reviewlytics.session import local_session
    from workbench.registry import REGISTRY

    sf_dir, keys = sys.argv[1], sys.argv[2:] or list(REGISTRY)
    spark = local_session()
    con = duck(sf_dir)
    bad = 0
    for key in keys:
        try:
            problem, ours, theirs = difference(spark, con, REGISTRY[key], sf_dir)
        except Exception as error:  # report and go on with the next query
            problem, ours, theirs = f"{type(error).__name__}: {str(error)[:1200]}", 0.0, 0.0
        bad += bool(problem)
        print(f"{'ok  ' if not problem else 'BAD '} {key} {ours:.1f}s {theirs:.1f}s {problem}", flush=True)
    print(f"{len(keys) - bad} of {len(keys)} equal")


if __name__ == "__main__":
    main()
