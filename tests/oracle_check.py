"""Run registered queries in Spark and their SQL in DuckDB on the same files and compare schema and rows.

    python tests/oracle_check.py [sf_dir] [name ...]
"""
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(rows):
    def cell(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, float):
            return "NaN" if math.isnan(v) else repr(v + 0.0)
        return f"{type(v).__name__}:{v}"

    return sorted(tuple(cell(v) for v in row) for row in rows)


def compare(con, df, sql):
    """None if equal, else a text saying what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {df.columns} != {names}"
    order = sorted(names)
    mine = [tuple(row[c] for c in order) for row in df.collect()]
    index = [names.index(c) for c in order]
    theirs = [tuple(row[i] for i in index) for row in theirs]
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    a, b = canonical(mine), canonical(theirs)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} of {len(a)} rows differ, columns {order}, first {bad[0]}"
    return None if mine else "EMPTY"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from visitlake.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("oracle-check", master="local[8]")
    con, sqls = connect(sf), entry.oracle_sql()
    bad = []
    for name, build in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = build(spark, sf)
            if name in sqls:
                problem = compare(con, df, sqls[name])
            else:
                problem = None if df.count() else "EMPTY"
        except Exception as error:  # keep going: the list of failures is the result
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        if problem:
            bad.append(name)
        print(f"{'ok  ' if not problem else 'FAIL'} {name:28s} {time.time() - start:6.1f}s {'' if name in sqls else '(rows only) '}{problem or ''}", flush=True)
    print(f"{len(bad)} failing: {bad}")
