"""Run registered queries next to their SQL twin in DuckDB and compare."""

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v, digits=9):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ in ("Decimal",):
        f = float(v)
        if math.isnan(f):
            return None
        return float(f"{f:.{digits}g}") + 0.0
    return str(v)


def rows_of(names, rows, digits=9):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(norm(r[i], digits) for i in order) for r in rows]
    return sorted(names), sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, name, fn, sql, sf_dir):
    """Returns (ok, message)."""
    df = fn(spark, sf_dir)
    raw = [tuple(r) for r in df.collect()]
    got_names, got = rows_of(df.columns, raw)
    if sql is None:
        return (len(got) > 0, f"rows={len(got)} (no oracle)")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    wanted = cur.fetchall()
    want_names, want = rows_of(names, wanted)
    if got_names != want_names:
        return False, f"columns {got_names} vs {want_names}"
    if got != want:
        bad = [(a, b) for a, b in zip(got, want) if a != b][:2]
        return False, f"rows {len(got)} vs {len(want)}; first differences {bad}"
    same = rows_of(df.columns, raw, 17)[1] == rows_of(names, wanted, 17)[1]
    return True, f"rows={len(got)}" + ("" if same else " (equal to 9 digits)")


def main(pattern="", sf="sf0.01"):
    from designstats.plans import catalog
    from designstats.session import local_session

    spark = local_session(4)
    sf_dir = f"/root/testdata/{sf}"
    con = connect(sf_dir)
    failed = []
    for name, fn in catalog.QUERIES.items():
        if pattern and not any(name.startswith(p) for p in pattern.split(",")):
            continue
        start = time.time()
        try:
            ok, msg = compare(spark, con, name, fn, catalog.ORACLES.get(name), sf_dir)
        except Exception as e:  # report and go on
            ok, msg = False, f"{type(e).__name__}: {str(e)[:400]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {msg}", flush=True)
        if not ok:
            failed.append(name)
    print(len(failed), "failed:", failed)
    spark.stop()


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    main(*sys.argv[1:])
