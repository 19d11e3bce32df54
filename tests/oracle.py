"""Compare every registered query with its SQL on DuckDB."""

from __future__ import annotations

import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        if math.isnan(v):
            return "~"
        return repr(v + 0.0)
    return str(v)


def normalise(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    """None when equal, else a description of the difference."""
    df = fn(spark, sf_dir)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    scols, srows = normalise(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    dcols_raw = [d[0] for d in cur.description]
    dtypes = {d[0]: str(d[1]) for d in cur.description}
    dcols, drows = normalise(dcols_raw, cur.fetchall())
    if scols != dcols:
        return f"columns differ: {scols} vs {dcols}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    bad = {c: (types[c], dtypes[c]) for c in scols if types[c] in kinds and kinds[types[c]] != dtypes[c].upper() and "NUMBER" not in dtypes[c].upper()}
    if bad:
        return f"types differ: {bad}"
    if len(srows) != len(drows):
        return f"row counts differ: {len(srows)} vs {len(drows)}"
    diff = [(a, b) for a, b in zip(srows, drows) if a != b]
    if diff:
        only_s, only_d = set(srows) - set(drows), set(drows) - set(srows)
        return f"{len(diff)} rows differ, e.g. spark {sorted(only_s)[:2]} duckdb {sorted(only_d)[:2]}"
    return None if srows else "empty on both sides"


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from gradus.session import local_session

    sf_dir = argv[0]
    wanted = argv[1:]
    spark = local_session(cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t0 = time.time()
        try:
            if name in oracle:
                issue = compare(spark, con, fn, oracle[name], sf_dir)
            else:
                rows = fn(spark, sf_dir).collect()
                issue = None if rows else "no rows"
        except Exception as e:  # noqa: BLE001
            import traceback
            issue = f"{type(e).__name__}: {str(e)[:700]}"
            if "--trace" in argv:
                traceback.print_exc()
        dt = time.time() - t0
        mark = "ok " if issue is None else "BAD"
        bad += issue is not None
        print(f"{mark} {dt:6.2f}s {name}{'' if name in oracle else ' (rows only)'}{'' if issue is None else ': ' + issue}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
