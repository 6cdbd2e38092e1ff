"""Run registered queries next to their SQL counterparts and compare the rows.

``python -m tests.compare <sf_dir> [query ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value: object) -> object:
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if hasattr(value, "item"):
        return _plain(value.item())
    return value


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    names = sorted(frame.columns)
    rows = [tuple(_plain(v) for v in r) for r in frame[names].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def difference(mine: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} != {sorted(theirs.columns)}"
    a, b = rows_of(mine), rows_of(theirs)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)} rows"
    for x, y in zip(a, b):
        if x != y:
            return f"{x} != {y}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    from tidemark.session import local_session

    sys.path.insert(0, str(Path(__file__).parents[1]))
    from __spark_entry__ import oracle_sql, queries

    spark, con, oracle, bad = local_session(8), connect(sf_dir), oracle_sql(), 0
    for name, run in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            mine = run(spark, sf_dir).toPandas()
            took = time.time() - start
            if name in oracle:
                verdict = difference(mine, con.execute(oracle[name]).df()) or f"equal ({len(mine)} rows)"
            else:
                verdict = f"rows only ({len(mine)} rows)"
        except Exception as error:  # report and go on with the next query
            took, verdict = time.time() - start, f"ERROR {str(error)[:600]}"
        bad += not verdict.startswith(("equal", "rows only"))
        print(f"{name:28s} {took:6.2f}s  {verdict}", flush=True)
    print(f"{bad} differing or failing")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
