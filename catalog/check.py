"""Run queries beside their SQL: ``python -m catalog.check [--sf 0.01] [name ...]``."""

from __future__ import annotations

import argparse
import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def rows_of(frame, columns):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        if hasattr(v, "tolist"):
            v = v.tolist()
        if hasattr(v, "asDict"):
            v = tuple(v)
        if isinstance(v, (list, tuple)):
            return tuple(plain(x) for x in v)
        if isinstance(v, dict):
            return tuple(sorted((k, plain(x)) for k, x in v.items()))
        return v

    return sorted((tuple(plain(r[c]) for c in columns) for r in frame), key=repr)


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, name, fn, sql, sf_dir) -> tuple[bool, str]:
    start = time.time()
    df = fn(spark, sf_dir)
    got = [r.asDict() for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return bool(got), f"{len(got)} rows, no SQL, {took:.1f}s"
    start = time.time()
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    kinds = {d[0]: str(d[1]) for d in rel.description}
    want = [dict(zip(names, r)) for r in rel.fetchall()]
    told = f"{len(got)} rows, spark {took:.1f}s, sql {time.time() - start:.1f}s"
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    family = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    odd = [f"{f.name}:{f.dataType.simpleString()}!={kinds[f.name]}" for f in df.schema
           if family.get(f.dataType.simpleString(), kinds[f.name]) != kinds[f.name]]
    columns = sorted(names)
    a, b = rows_of(got, columns), rows_of(want, columns)
    if a != b:
        only = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return False, f"{told}; {len(want)} wanted; {columns}\n   spark {str(only[0])[:900]}\n   sql   {str(only[1])[:900]}"
    if not a:
        return False, told + "; EMPTY"
    return True, told + (f"; types {odd}" if odd else "")


def main() -> None:
    from catalog import ORACLE, QUERIES
    from cueloom.session import build_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--hot", default=None, help="rows above which a key is split")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session()
    if args.hot:
        spark.conf.set("cueloom.hotRows", args.hot)
        spark.conf.set("spark.sql.shuffle.partitions", "128")
    sf_dir = f"/root/testdata/sf{args.sf}"
    con = connect(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        try:
            ok, told = compare(spark, con, name, fn, ORACLE.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            ok, told = False, f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, told, flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
