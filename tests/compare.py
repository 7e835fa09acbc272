"""Spark's result against DuckDB's: same columns, same rows in any order."""

from __future__ import annotations

import math
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(con, sf_dir: str) -> None:
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"create or replace view {name} as select * from read_parquet('{path if path.is_file() else path / '*.parquet'}')")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    return float(value) if type(value).__name__ == "Decimal" else value


def difference(df, con, sql: str) -> str:
    """Empty if both agree."""
    columns = sorted(df.columns)
    cursor = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({sql})")
    theirs = sorted(map(repr, (plain(r) for r in cursor.fetchall())))
    mine = sorted(map(repr, (plain(tuple(r)) for r in df.select(*columns).collect())))
    if mine == theirs:
        return ""
    odd = [x for x in zip(mine, theirs) if x[0] != x[1]][:3]
    return f"{len(mine)} rows here, {len(theirs)} there; {odd or (mine[:2], theirs[:2])}"
