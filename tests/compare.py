"""Compare registered queries with their SQL: ``python tests/compare.py <sf_dir> [names...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


def key(row):
    return tuple((x is None, "" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x)) for x in row)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=key)


def close(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def compare(df, con, sql) -> tuple[str, str]:
    """``exact``, ``close`` or ``differs``, with a remark."""
    s_names, s_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    types = {c[0]: str(c[1]) for c in cur.description}
    o_names, o_rows = rows_of([c[0] for c in cur.description], cur.fetchall())
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
            "boolean": "BOOLEAN"}
    note = ",".join(f"{n}:{kinds.get(n)}/{types[n]}" for n in o_names if same.get(kinds.get(n)) != types[n])
    if s_names != o_names:
        return "differs", f"columns {s_names} vs {o_names}"
    if len(s_rows) != len(o_rows):
        return "differs", f"rows {len(s_rows)} vs {len(o_rows)} {note}"
    if s_rows == o_rows:
        return "exact", f"{len(s_rows)} rows {note}"
    bad = [(a, b) for a, b in zip(s_rows, o_rows) if not all(close(x, y) for x, y in zip(a, b))]
    if bad:
        return "differs", f"{len(bad)} of {len(s_rows)} rows, e.g. {s_names}\n   {bad[0][0]}\n   {bad[0][1]} {note}"
    first = next((n, x, y) for a, b in zip(s_rows, o_rows) for n, x, y in zip(s_names, a, b) if x != y)
    return "close", f"{len(s_rows)} rows, {first} {note}"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from shelfline.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, qs = duck(sf_dir), oracle_sql(), queries()
    tally: dict[str, int] = {}
    for name in names or qs:
        start = time.time()
        try:
            df = qs[name](spark, sf_dir)
            if name in sqls:
                state, note = compare(df, con, sqls[name])
            else:
                state, note = "no-sql", f"{df.count()} rows {df.columns}"
        except Exception as e:  # report and go on with the next query
            state, note = "error", str(e)[:700]
        tally[state] = tally.get(state, 0) + 1
        print(f"{state:8} {name:28} {time.time() - start:5.1f}s {note}", flush=True)
    print(tally)


if __name__ == "__main__":
    main()
