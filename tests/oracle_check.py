"""Run registered queries against their SQL in DuckDB.

    python tests/oracle_check.py SF_DIR [name ... | --sql]
"""

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        f = float(v)
        return repr(0.0 if f == 0 else f)
    return str(v)


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(cell(v) for v in r) for r in pdf.itertuples(index=False, name=None))


def kind(dtype):
    s = str(dtype)
    return "int" if s.startswith(("int", "uint", "Int")) else "float" if s.startswith("float") else "bool" if s == "bool" else "other"


def compare(spark_pdf, duck_pdf):
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} != {sorted(duck_pdf.columns)}"
    if len(spark_pdf) != len(duck_pdf):
        return f"rows {len(spark_pdf)} != {len(duck_pdf)}"
    for c in spark_pdf.columns:
        a, b = kind(spark_pdf[c].dtype), kind(duck_pdf[c].dtype)
        if a != b:
            return f"type of {c}: {spark_pdf[c].dtype} != {duck_pdf[c].dtype}"
    a, b = rows(spark_pdf), rows(duck_pdf)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} of {len(a)} rows differ ({sorted(spark_pdf.columns)}), first: {str(bad[0])[:1500]}"
    return None


def main(sf_dir, names):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    con = connect(sf_dir)
    failed = []
    for name in queries:
        if names == ["--sql"]:
            if name not in oracles:
                continue
        elif names and not any(n in name for n in names):
            continue
        t = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            dt = time.time() - t
            if name not in oracles:
                print(f"rows  {name:34} {len(got):7} {dt:6.2f}s", flush=True)
                continue
            t = time.time()
            want = con.execute(oracles[name]).df()
            du = time.time() - t
            problem = compare(got, want)
        except Exception as e:  # noqa: BLE001
            problem, dt, du, got = f"{type(e).__name__}: {str(e)[:1500]}", time.time() - t, 0, []
        print(f"{'ok   ' if problem is None else 'FAIL '} {name:34} {len(got):7} {dt:6.2f}s duck {du:5.2f}s {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
