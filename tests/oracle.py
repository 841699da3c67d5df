"""Compare registered queries with their SQL in DuckDB: python tests/oracle.py [sf dir] [name ...]."""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda v: None if isinstance(v, float) and math.isnan(v) else round(float(v), 5) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted((tuple(fix(r[i]) for i in order) for r in data), key=repr)


def differs(df, con, sql):
    """None if both have the same columns and rows."""
    rel = con.sql(sql)
    want, have = rows(rel.columns, rel.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(rel.columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    if len(want) != len(have):
        return f"{len(have)} rows and {len(want)}"
    close = lambda a, b: a == b or (isinstance(a, float) and isinstance(b, (float, int)) and abs(a - b) <= 2e-5 * max(1, abs(b)))
    for x, y in zip(have, want):
        if not all(close(a, b) for a, b in zip(x, y)):
            return f"{x} and {y}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql = connect(sf), entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        t = time.time()
        try:
            said = differs(queries[name](spark, sf), con, sql[name]) if name in sql else f"no SQL: {queries[name](spark, sf).count()} rows"
        except Exception as e:
            said = f"FAILED {str(e)[:600]}"
        print(f"{name}: {said or 'same'} ({time.time() - t:.1f} s)", flush=True)
