"""Side-by-side check of the catalogue against DuckDB: python tests/check_catalog.py [sf] [name-prefix ...]"""

import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
import __spark_entry__ as entry  # noqa: E402
from riskloom.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "None"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return str(v)


def compare(spark, con, name, sf_dir):
    started = time.time()
    df = entry.queries()[name](spark, sf_dir)
    rows = df.collect()
    seconds = time.time() - started
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "ROWS", f"{len(rows)} rows, {df.columns}", seconds
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return "FAIL", f"columns {sorted(df.columns)} vs {sorted(names)}", seconds
    order = sorted(names)
    pos = [names.index(c) for c in order]
    a = sorted(tuple(norm(r[c]) for c in order) for r in rows)
    b = sorted(tuple(norm(r[i]) for i in pos) for r in want)
    if a == b:
        return "OK", f"{len(a)} rows", seconds
    left, right = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return "FAIL", f"{len(a)} vs {len(b)} rows, {len(left)} differ\n   {order}\n   spark {left[:2]}\n   sql   {right[:2]}", seconds


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = 0
    for name in entry.queries():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            status, text, seconds = compare(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001
            status, text, seconds = "ERROR", str(e)[:700], 0.0
        bad += status in ("FAIL", "ERROR")
        print(f"{status:5} {name} {seconds:.1f}s {text}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
