"""Run registered queries next to their SQL and compare all rows."""

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda row: [(v is None, str(type(v)), v if v is not None else 0) for v in row]
    return sorted(columns), sorted((tuple(row[i] for i in order) for row in rows), key=key)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return type(a) is type(b) and a == b


def difference(con, sql, df):
    """None if both results hold the same rows, else a short account."""
    res = con.execute(sql)
    want_cols, want = table([c[0] for c in res.description], res.fetchall())
    got_cols, got = table(df.columns, [tuple(r) for r in df.collect()])
    if want_cols != got_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(want) != len(got):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if not all(map(same, g, w))]
    return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0]}" if bad else None


if __name__ == "__main__":
    import os
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    sf = sys.argv[1]
    names = sys.argv[2:] or list(entry.queries())
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g")
             .config("spark.ui.showConsoleProgress", "false").config("spark.ui.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(sf), entry.oracle_sql()
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, sf)
            text = difference(con, sqls[name], df) if name in sqls else f"rows only: {len(df.collect())}"
        except Exception as e:
            text = f"{type(e).__name__}: {str(e)[:300]}"
        print(f"{time.time() - start:7.1f}s {name}: {text or 'ok'}", flush=True)
