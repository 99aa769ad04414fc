"""Run catalog queries in Spark and their oracle SQL in DuckDB, compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Compare rule (like the driver's): row count, column names, and an
order-insensitive multiset of rounded row tuples.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 4)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def compare(spark_df, oracle_df):
    s_cols = sorted(spark_df.columns)
    o_cols = sorted(oracle_df.columns)
    if s_cols != o_cols:
        return False, f"columns differ: spark={s_cols} oracle={o_cols}"
    if len(spark_df) != len(oracle_df):
        return False, f"rows differ: spark={len(spark_df)} oracle={len(oracle_df)}"
    s = sorted((tuple(_norm(r[c]) for c in s_cols) for r in spark_df.to_dict("records")), key=repr)
    o = sorted((tuple(_norm(r[c]) for c in s_cols) for r in oracle_df.to_dict("records")), key=repr)
    bad = [(a, b) for a, b in zip(s, o) if a != b]
    if bad:
        return False, f"{len(bad)} rows differ, e.g. spark={bad[0][0]} oracle={bad[0][1]}"
    return True, f"{len(s)} rows ok"


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from qualityspark.session import get_spark
    import __spark_entry__ as entry

    spark = get_spark("local[8]", 8)
    con = duckdb.connect()
    from qualityspark.sources.tables import TABLES
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, sqls = entry.queries(), entry.oracle_sql()
    ok_all = True
    for name in names or list(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            ok_all = False
            continue
        t1 = time.time()
        if name not in sqls:
            print(f"ROWS {name}: {len(sdf)} rows (no oracle) spark {t1 - t0:.1f}s")
            continue
        try:
            odf = con.execute(sqls[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            ok_all = False
            continue
        ok, msg = compare(sdf, odf)
        ok_all &= ok
        print(f"{'OK  ' if ok else 'FAIL'} {name}: {msg} spark {t1 - t0:.1f}s")
    spark.stop()
    return 0 if ok_all else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv))
