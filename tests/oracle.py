"""Compare registered queries with their SQL on DuckDB over the same parquet files.

Command line: ``python tests/oracle.py SF_DIR [name ...]``.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(repr(r[i]) for i in order) for r in rows))


def compare(spark, con, name: str, queries, oracle, sf_dir: str) -> tuple[bool, str]:
    df = queries[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if name not in oracle:
        return True, f"{len(got)} rows, no SQL"
    rel = con.execute(oracle[name])
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return True, f"{len(a)} rows"
    only_a = [x for x in a if x not in set(b)][:2]
    only_b = [x for x in b if x not in set(a)][:2]
    return False, f"{sorted(names)}\n   spark {len(a)} rows, sql {len(b)} rows\n   spark only {only_a}\n   sql only   {only_b}"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from vigilspark.session import local_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session("oracle", 8)
    con = connect(sf_dir)
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name in wanted or sorted(qs):
        begin = time.time()
        try:
            ok, text = compare(spark, con, name, qs, sqls, sf_dir)
        except Exception as exc:  # noqa: BLE001
            ok, text = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - begin:.1f}s {text}", flush=True)
    print("failures:", bad)
