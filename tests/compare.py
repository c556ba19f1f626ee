"""Compare a registered query with its DuckDB SQL: python tests/compare.py [SF_DIR] NAME..."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return repr([plain(v) for v in value])
    if value is None or isinstance(value, bool):
        return repr(value)
    return str(value)


def rows_of(names: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def difference(spark, sf_dir: str, query, sql: str, con=None) -> str:
    """Empty if both give the same rows under the same names."""
    got = query(spark, sf_dir)
    ours = rows_of(got.columns, [tuple(r) for r in got.collect()])
    cur = (con or connection(sf_dir)).execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} and {sorted(names)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    bad = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    return f"{len(bad)} of {len(ours)} rows differ, as {bad[0]}" if bad else ""


def main(args: list[str]) -> int:
    from tests.session import session

    import __spark_entry__ as entry

    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con, failed = session(), connection(sf_dir), 0
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in args or queries:
        began = time.time()
        if name in oracle:
            try:
                said = difference(spark, sf_dir, queries[name], oracle[name], con)
            except Exception as e:  # noqa: BLE001
                said = f"{type(e).__name__}: {str(e)[:1500]}"
        else:
            said = "" if queries[name](spark, sf_dir).count() else "no rows"
        failed += bool(said)
        print(f"{name}: {said or 'same' if name in oracle else said or 'rows only'} ({time.time() - began:.1f} s)", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
