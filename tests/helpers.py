"""Comparing a registered query with its oracle in DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame) -> list[tuple]:
    frame = frame.reindex(sorted(frame.columns), axis=1)
    clean = lambda v: None if v is None or v != v else round(v, 9) if isinstance(v, float) else str(v)
    return sorted((tuple(clean(v) for v in row) for row in frame.itertuples(index=False)), key=str)


def oracle_rows(sql: str, folder: str = DATA) -> list[tuple]:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(folder, f"{name}.parquet")
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return rows_of(con.execute(sql).df())


def agree(spark, query, sql: str, folder: str = DATA) -> None:
    assert rows_of(query(spark, folder).toPandas()) == oracle_rows(sql, folder)
