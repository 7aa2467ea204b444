"""Runs queries on Spark and their SQL on DuckDB and compares rows, as multisets, by column name.

python tests/compare.py SF_DIR [NAME...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings anchor_node inode iedge match_edge node_record feed_trust test_node test_edge eval_item".split()


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.sql.maxMetadataStringLength": "1000"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        c.execute(f"create view {t} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return str(v) if hasattr(v, "isoformat") else v


def rows(names: list[str], records) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in records)


def main(sf_dir: str, *names: str) -> int:
    import __spark_entry__ as e

    spark, c, bad = session(), duck(sf_dir), 0
    sql = e.oracle_sql()
    for name in names or e.queries():
        t = time.time()
        try:
            df = e.queries()[name](spark, sf_dir)
            got = rows(df.columns, df.collect())
            s, t = time.time() - t, time.time()
            if name not in sql:
                print(f"{name}: {sum(got.values())} rows, {s:.1f} s, no SQL", flush=True)
                continue
            r = c.execute(sql[name])
            cols = [x[0] for x in r.description]
            want = rows(cols, r.fetchall())
            kinds = sorted(cols) == sorted(df.columns)
            ok = got == want and kinds
            print(f"{name}: {'ok' if ok else 'DIFFERENT'} {sum(got.values())} rows, {s:.1f} s, SQL {time.time() - t:.1f} s" + ("" if kinds else f" columns {df.columns} {cols}"), flush=True)
            if not ok:
                bad += 1
                print("   only Spark:", list((got - want).items())[:4], "\n   only SQL:", list((want - got).items())[:4], flush=True)
        except Exception as x:  # noqa: BLE001
            bad += 1
            print(f"{name}: FAILED {str(x)[:1500]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
