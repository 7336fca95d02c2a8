"""Runs registered queries next to their SQL and compares the rows as multisets."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(str, map(_value, v))) + "]"
    if isinstance(v, bool) or v is None:
        return str(v)
    return str(v)


def rows(columns: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in data)


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = query(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    theirs = rows(columns, cur.fetchall())
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}; first only here {sorted(set(mine) - set(theirs))[:2]}; only there {sorted(set(theirs) - set(mine))[:2]}"
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(wrong)} rows differ, e.g. {wrong[:2]}" if wrong else None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from pactlens.session import local_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2].split(",") if len(sys.argv) > 2 else [""]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    for name, query in entry.queries().items():
        if not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                result = compare(spark, con, name, query, oracles[name], sf_dir) or "ok"
            else:
                result = f"rows {query(spark, sf_dir).count()}"
        except Exception as error:  # report and go on with the next query
            result = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        print(f"{name}\t{time.time() - start:.1f}s\t{result[:700]}", flush=True)
