"""Run queries on Spark and their twins on DuckDB, and compare every value.

    python tests/compare.py <folder of tables> [name prefix ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        return repr(v + 0.0 if isinstance(v, float) else v)

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return canonical(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    return canonical([c[0] for c in cur.description], cur.fetchall())


def difference(left, right) -> str | None:
    if left[0] != right[0]:
        return f"columns {left[0]} / {right[0]}"
    if left[1] == right[1]:
        return None
    a, b = set(left[1]), set(right[1])
    return (f"{len(left[1])} / {len(right[1])} rows; only Spark {len(a - b)}: {sorted(a - b)[:3]}; "
            f"only twin {len(b - a)}: {sorted(b - a)[:3]}")


def main(folder: str, prefixes: list[str]) -> None:
    import __spark_entry__ as entry
    from harvestlens.session import build_session

    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("OFF")
    con, oracles, bad = connect(folder), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            got = spark_rows(fn(spark, folder))
            took = time.time() - start
            problem = difference(got, duck_rows(con, oracles[name])) if name in oracles else None
            note = "ok" if name in oracles else "no twin"
        except Exception as exc:  # noqa: BLE001
            took, problem, got = time.time() - start, f"{type(exc).__name__}: {str(exc)[:600]}", ([], [])
        bad += problem is not None
        print(f"{'FAIL' if problem else note:8}{name:32}{took:7.1f}s {len(got[1])} rows {problem or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
