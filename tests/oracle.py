"""Compare queries with their SQL in DuckDB: python tests/oracle.py SF_DIR [NAME...]"""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def one(x):
        if isinstance(x, (list, tuple)) or hasattr(x, "tolist") and getattr(x, "ndim", 0):
            return "[" + ",".join(map(one, x)) + "]"
        if x is None or x is pd.NaT or isinstance(x, float) and x != x or x is pd.NA:
            return "~"
        if isinstance(x, float):
            return f"{x:.9g}"
        if hasattr(x, "item"):
            return one(x.item())
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, int):
            return f"{float(x):.9g}" if abs(x) < 2**53 else str(x)
        return str(x)

    return sorted(tuple(one(x) for x in row) for row in df.itertuples(index=False, name=None))


def compare(spark, d: str, name: str, f, sql: str | None) -> str:
    t = time.time()
    frame = f(spark, d)
    kinds = {k: v for k, v in frame.dtypes}
    got = frame.toPandas()
    took = time.time() - t
    if sql is None:
        return f"rows {len(got)} (no SQL) {took:.1f}s"
    con = duckdb.connect()
    for p in Path(d).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p if p.is_file() else str(p) + '/*.parquet'}'")
    want = con.execute(sql).fetch_df()
    same = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    types = {r[0]: r[1] for r in con.execute("describe " + sql).fetchall()}
    off = {k: (v, types.get(k)) for k, v in kinds.items() if same.get(v) != types.get(k) and v in same}
    if sorted(got.columns) != sorted(want.columns):
        return f"DIFF columns {sorted(got.columns)} {sorted(want.columns)}"
    a, b = normal(got), normal(want)
    if a != b:
        sa, sb = set(a), set(b)
        return f"DIFF rows {len(a)} {len(b)} only here {list(sa - sb)[:3]} only SQL {list(sb - sa)[:3]}"
    return f"ok {len(a)} {took:.1f}s" + (f" TYPES {off}" if off else "")


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    qs, sql = e.queries(), e.oracle_sql()
    for name in [n for n in qs if not sys.argv[2:] or any(n == x or x.endswith("*") and n.startswith(x[:-1]) for x in sys.argv[2:])]:
        try:
            print(name, compare(spark, sys.argv[1], name, qs[name], sql.get(name)), flush=True)
        except Exception as x:  # noqa: BLE001
            print(name, "ERROR", str(x)[:1500], flush=True)
