"""Run registered queries and their SQL side by side and compare whole results."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, int)):
        return v
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return str(v)


def kind(v):
    return type(v).__name__


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> str:
    """Empty string when equal, else what differs."""
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want_cols, want = rows_of(cols, cur.fetchall())
    got_cols, got = rows_of(df.columns, df.collect())
    if want_cols != got_cols:
        return f"columns {got_cols} vs {want_cols}"
    if len(want) != len(got):
        return f"rows {len(got)} vs {len(want)}; first {got[:1]} vs {want[:1]}"
    if not got:
        return "no rows on either side: nothing was compared"
    for g, w in zip(got, want):
        if g != w:
            return f"row {g} vs {w}"
        if [kind(a) for a in g if a is not None] != [kind(b) for b in w if b is not None] and None not in g:
            return f"types {[kind(a) for a in g]} vs {[kind(b) for b in w]}"
    return ""


def session(cores: str = "8"):
    import tempfile

    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("refrain")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", os.environ.get("REFRAIN_CHECKPOINTS") or tempfile.mkdtemp(prefix="refrain-test-"))
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    sf = sys.argv[1]
    wanted = sys.argv[2:]
    import __spark_entry__ as entry
    spark, con = session(), connect(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in qs:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            if name in sqls:
                t1 = time.time()
                msg = compare(qs[name](spark, sf), con, sqls[name])
            else:
                msg = "" if len(qs[name](spark, sf).collect()) > 0 else "no rows"
        except Exception as e:  # report and go on
            msg = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(msg)
        print(f"{'FAIL' if msg else 'ok  '} {name} {time.time() - t0:.1f}s {msg}", flush=True)
    print("failures:", bad)
