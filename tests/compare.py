"""Runs registered queries beside their SQL twins and compares the rows.

    python -m tests.compare 0.001 [name ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from decimal import Decimal

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, (int, Decimal, float)):
        number = float(value)
        return None if math.isnan(number) else round(number, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, list):
        return tuple(plain(x) for x in value)
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    found = [tuple(plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(found, key=repr)


def kinds(df_types):
    """Types by family, so that an int beside a double shows up."""
    out = {}
    for name, kind in df_types:
        kind = kind.lower()
        if "int" in kind:
            out[name] = "int"
        elif "double" in kind or "float" in kind:
            out[name] = "double"
        elif "decimal" in kind:
            out[name] = "decimal"
        elif "char" in kind or "string" in kind:
            out[name] = "text"
        elif "timestamp" in kind:
            out[name] = "timestamp"
        else:
            out[name] = kind
    return out


def compare(spark, con, sf_dir, query, sql):
    """None when rows agree, else what differs."""
    df = query(spark, sf_dir)
    ours, mine = rows_of(df.columns, df.collect())
    result = con.execute(sql)
    types = [(d[0], str(d[1])) for d in result.description]
    theirs, other = rows_of([d[0] for d in result.description], result.fetchall())
    if ours != theirs:
        return f"columns {ours} against {theirs}"
    if kinds(df.dtypes) != kinds(types):
        a, b = kinds(df.dtypes), kinds(types)
        return f"types differ: { {k: (a[k], b[k]) for k in a if a[k] != b[k]} }"
    if mine != other:
        gone = [r for r in mine if r not in set(other)][:3]
        new = [r for r in other if r not in set(mine)][:3]
        return f"{len(mine)} rows against {len(other)}; columns {ours}; only ours {gone}; only theirs {new}"
    return None if mine else "EMPTY"


def main(argv):
    from oracle import all_sql
    from titletide.plans.registry import ALL
    from titletide.session import local_session

    sf_dir = f"/root/testdata/sf{argv[0]}"
    spark, con, sql = local_session("8"), duck(sf_dir), all_sql()
    names = argv[1:] or list(ALL)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, sf_dir, ALL[name], sql[name])
            else:
                df = ALL[name](spark, sf_dir)
                rows = df.collect()
                problem = None if rows else "EMPTY"
                print(f"     {name}: rows only, {len(rows)}", rows[:2])
        except Exception as error:  # noqa: BLE001 - a report, not a handler
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main(sys.argv[1:])
