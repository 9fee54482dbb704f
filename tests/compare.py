"""Runs queries next to their SQL and reports differences: python tests/compare.py [folder] [name ...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    return v


def compare(spark, query, sql: str, folder: str) -> str:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = query(spark, folder)
    cols = sorted(df.columns)
    mine = sorted((tuple(_cell(r[c]) for c in cols) for r in df.collect()), key=str)
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    at = [names.index(c) for c in cols]
    other = sorted((tuple(_cell(r[i]) for i in at) for r in res.fetchall()), key=str)
    if mine == other:
        types = {type(v).__name__ for r in mine[:50] for v in r} - {"str", "int", "float", "bool", "NoneType"}
        return f"ok {len(mine)} rows" + (f" (types {types})" if types else "")
    a, b = set(mine), set(other)
    return f"DIFF {len(mine)} vs {len(other)} rows; only spark {[x for x in mine if x not in b][:2]}; only sql {[x for x in other if x not in a][:2]}"


if __name__ == "__main__":
    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = session()
    queries, sqls = entry.queries(), entry.oracle_sql()
    for name, query in queries.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in sqls:
                answer = compare(spark, query, sqls[name], folder)
            else:
                answer = f"rows only: {query(spark, folder).count()}"
        except Exception as e:  # noqa: BLE001
            answer = f"ERROR {type(e).__name__} {str(e)[:400]}"
        print(f"{name}: {answer} [{time.time() - start:.1f}s]"[:900], flush=True)
