"""Run registered queries on Spark and their SQL on DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

from testbed.oracles import ORACLES
from testbed.queries import REGISTRY


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.6f}") + 0.0
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None when both agree, else what differs."""
    frame = REGISTRY[name](spark, sf_dir)
    got = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}"
    want = _rows(columns, cursor.fetchall())
    if len(got) != len(want):
        extra, lost = [r for r in got if r not in set(want)][:3], [r for r in want if r not in set(got)][:3]
        return f"{len(got)} rows != {len(want)}; only Spark {extra}; only SQL {lost}"
    diffs = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(diffs)} of {len(got)} rows differ, first {sorted(columns)}: {diffs[0]}" if diffs else None
