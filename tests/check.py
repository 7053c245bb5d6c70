"""Compare registered queries with their SQL: ``python tests/check.py [sf] [name ...]``."""

import hashlib
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def canon(value):
    if isinstance(value, float):
        return f"{value:.6f}"
    if isinstance(value, dict):
        return str({k: canon(v) for k, v in value.items()})
    if isinstance(value, (list, tuple)):
        return str([canon(v) for v in value])
    return str(value)


def digest(rows):
    h = hashlib.sha256()
    for row in sorted("\x1f".join(r) for r in rows):
        h.update(row.encode())
    return h.hexdigest()[:12]


def spark_rows(df):
    cols = sorted(df.columns)
    def plain(v):
        if hasattr(v, "asDict"):
            return {k: plain(x) for k, x in v.asDict().items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        return v
    return cols, [[canon(plain(r[c])) for c in cols] for r in df.collect()]


def duck_rows(con, query):
    cur = con.execute(query)
    names = [d[0] for d in cur.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, [[canon(r[i]) for i in at] for r in cur.fetchall()]


def connect(sf):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def main():
    import __spark_entry__ as entry
    from colloquy.plans.store import local_session
    args = sys.argv[1:]
    sf = "/root/testdata/sf" + (args.pop(0) if args and args[0].startswith("0") else "0.01")
    spark, con = local_session("8"), connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    names = [n for n in queries if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    for name in names:
        t = time.time()
        try:
            cols, got = spark_rows(queries[name](spark, sf))
            took = time.time() - t
            if name not in oracles:
                print(f"rows  {name:28} {len(got):7} rows {took:6.2f}s", flush=True)
                continue
            wcols, want = duck_rows(con, oracles[name])
            same = cols == wcols and digest(got) == digest(want)
            print(f"{'ok   ' if same else 'DIFF '} {name:28} {len(got):7} rows {took:6.2f}s", flush=True)
            if not same:
                bad += 1
                g, w = sorted(map(tuple, got)), sorted(map(tuple, want))
                print("   ", cols, wcols, len(g), len(w))
                gs, ws = set(g), set(w)
                for r in sorted(gs - ws)[:3]: print("    spark", str(r)[:600])
                for r in sorted(ws - gs)[:3]: print("    duck ", str(r)[:600])
        except Exception as e:
            bad += 1
            print(f"FAIL  {name}: {str(e)[:1500]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
