"""Runs queries beside their SQL and says where the results differ."""

from __future__ import annotations

import os
import time

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    def cell(v):  # noqa: ANN001, ANN202
        if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
            return None
        if isinstance(v, float):
            return f"{v + 0.0:.10g}"
        return str(v.item() if hasattr(v, "item") else v)

    columns = sorted(pdf.columns)
    return sorted((tuple(cell(v) for v in row) for row in pdf[columns].astype(object).itertuples(index=False)), key=repr)


def compare(spark, sf_dir: str, query, sql: str) -> str | None:  # noqa: ANN001
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    want = db.execute(sql).df()
    got = query(spark, sf_dir).toPandas()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if a == b:
        return None
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    odd = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(odd)} of {len(a)} rows differ, first {sorted(got.columns)}: {odd[0]}"


def main() -> None:
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sf, names = sys.argv[1], sys.argv[2:]
    queries, sqls = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    for name in names or sqls:
        t = time.time()
        try:
            said = compare(spark, sf, queries[name], sqls[name]) if name in sqls else f"{queries[name](spark, sf).count()} rows (no SQL)"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{name}: {said or 'equal'} ({time.time() - t:.1f} s)", flush=True)


if __name__ == "__main__":
    main()
