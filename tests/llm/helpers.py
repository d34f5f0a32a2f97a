"""Comparison of a Spark result with its DuckDB oracle."""

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> list[tuple]:
    cell = lambda v: "null" if v is None or v is pd.NA or v != v else str(v) if isinstance(v, (bool, str)) else repr(float(v))
    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


def same_as_duckdb(spark_df, sql: str, **tables) -> None:
    con = duckdb.connect()
    for name, t in tables.items():
        if isinstance(t, str):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{t}'")
        else:
            con.register(name, t)
    got, want = spark_df.toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
