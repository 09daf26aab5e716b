"""Runs named queries and their SQL on the same tables and compares the rows.

    python tests/oracle_check.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return "NULL"
    if isinstance(value, float):
        if math.isnan(value):
            return "NULL"
        return f"{value:.6f}"
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(_cell(r[n]) for n in names) for r in df.collect())


def duck_rows(con, sql):
    con.execute(sql)
    names = [c[0] for c in con.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(tuple(_cell(r[i]) for i in order) for r in con.fetchall())


SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "boolean": "BOOLEAN",
}


def type_problems(con, sql, df):
    want = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return [
        f"{c}: {t} vs {want.get(c)}" for c, t in df.dtypes if SPARK_TO_DUCK.get(t) != want.get(c)
    ]


def compare(df, con, sql):
    """None when equal, else a message."""
    names, mine = spark_rows(df)
    other_names, theirs = duck_rows(con, sql)
    if names != other_names:
        return f"columns {names} vs {other_names}"
    if mine != theirs:
        only_mine = [r for r in mine if r not in set(theirs)][:3]
        only_theirs = [r for r in theirs if r not in set(mine)][:3]
        return f"{len(mine)} rows vs {len(theirs)}; only spark {str(only_mine)[:900]}; only sql {str(only_theirs)[:900]}"
    types = type_problems(con, sql, df)
    if types:
        return f"types differ: {types}"
    return None


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def main() -> int:
    from placelore.plans import registry

    args = sys.argv[1:]
    sf = "0.01"
    if "--sf" in args:
        at = args.index("--sf")
        sf = args[at + 1]
        del args[at : at + 2]
    folder = f"/root/testdata/sf{sf}"
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    sqls = registry.oracle_sql()
    bad = 0
    for name, query in registry.queries().items():
        if args and name not in args:
            continue
        begin = time.time()
        try:
            df = query(spark, folder)
            if name in sqls:
                problem = compare(df, con, sqls[name])
            else:
                n = len(df.collect())
                problem = None if n else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = "".join(traceback.format_exception_only(error))[:1500]
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - begin:.1f}s {problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
