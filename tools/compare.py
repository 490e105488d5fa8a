"""Run registered queries and their SQL twins side by side: ``python tools/compare.py SF_DIR [name ...]``."""

from __future__ import annotations

import hashlib
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from celstack.plans import load  # noqa: E402
from celstack.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_digest(names: list[str], rows) -> tuple[int, str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    lines = sorted(repr(tuple(row[i] for i in order)) for row in rows)
    return len(lines), hashlib.sha256("\n".join(lines).encode()).hexdigest()


def main() -> int:
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    registry = load()
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    bad = 0
    for name, item in registry.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            df = item.run(spark, sf_dir)
            rows = df.collect()
            n, digest = rows_digest(df.columns, rows)
        except Exception as exc:  # report and continue with the next query
            print(f"ERROR  {name}: {str(exc)[:900]}")
            bad += 1
            continue
        took = time.time() - start
        text = item.oracle()
        if text is None:
            print(f"ROWS   {name}: {n} rows {took:.1f}s")
            continue
        try:
            result = con.execute(text)
            names = [c[0] for c in result.description]
            other = result.fetchall()
        except Exception as exc:
            print(f"SQLERR {name}: {str(exc)[:900]}")
            bad += 1
            continue
        m, other_digest = rows_digest(names, other)
        if (n, digest) == (m, other_digest) and n > 0:
            print(f"ok     {name}: {n} rows {took:.1f}s")
        else:
            bad += 1
            print(f"DIFF   {name}: spark {n} rows, sql {m} rows")
            order = sorted(names)
            left = {repr(tuple(r[c] for c in order)) for r in rows}
            right = {repr(tuple(r[names.index(c)] for c in order)) for r in other}
            print("   cols", order)
            print("   spark only", sorted(left - right)[:4])
            print("   sql only  ", sorted(right - left)[:4])
    print("bad", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
