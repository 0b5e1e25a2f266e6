"""Run the registered queries and their SQL side by side and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return db


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dt.date):
        return value.isoformat()
    return value


def bag(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(
        tuple(plain(row[i]) for i in order) for row in rows
    )


def compare(spark, db, folder: str, run, sql: str | None) -> dict:
    start = time.time()
    df = run(spark, folder)
    mine = bag(df.columns, df.collect())
    out = {"rows": sum(mine[1].values()), "sec": round(time.time() - start, 2)}
    if sql is None:
        return {**out, "match": None}
    result = db.execute(sql)
    theirs = bag([d[0] for d in result.description], result.fetchall())
    out["match"] = mine == theirs
    if not out["match"]:
        out["columns"] = (mine[0], theirs[0])
        out["types"] = (df.dtypes, [(d[0], str(d[1])) for d in result.description])
        out["theirs"] = sum(theirs[1].values())
        out["only_mine"] = list((mine[1] - theirs[1]).items())[:3]
        out["only_theirs"] = list((theirs[1] - mine[1]).items())[:3]
    return out


if __name__ == "__main__":
    import __spark_entry__ as entry_module
    from rillcask.session import get_session

    folder = f"/root/testdata/{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = get_session(master="local[8]", conf={
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(folder)
    sql = entry_module.oracle_sql()
    bad = []
    for name, run in entry_module.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            got = compare(spark, db, folder, run, sql.get(name))
        except Exception as exc:
            got = {"match": False, "error": str(exc)[:700]}
        if got["match"] is False:
            bad.append(name)
        flag = {True: "ok", None: "rows", False: "BAD"}[got.pop("match")]
        print(flag, name, got, flush=True)
    print("bad:", bad)
