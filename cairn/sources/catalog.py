"""Catalog surface: load CSV / parquet / pandas data under a name, run SQL,
run SQL scripts, persist results.  The SparkSession catalog is the one place
tables live, so every call sees every registered table.
"""

from __future__ import annotations

from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from cairn.session import get_session


def session(db_path: str | None = None) -> SparkSession:
    """The session handle.  ``db_path`` (optional) becomes the warehouse
    directory, so :func:`load_csv` with ``persist=True`` writes managed tables there."""
    extra = {"spark.sql.warehouse.dir": db_path} if db_path else None
    return get_session(extra_conf=extra)


def load_csv(spark: SparkSession, path: str, table_name: str, header: bool = True,
             sep: str = ",", infer_schema: bool = True, persist: bool = False) -> DataFrame:
    """CSV -> named table (replaced if it exists); types inferred unless disabled.

    ``persist=False`` registers a temp view; ``persist=True`` writes a managed
    parquet table.
    """
    df = (spark.read.option("header", header).option("sep", sep)
          .option("inferSchema", infer_schema).csv(path))
    return register(df, table_name, persist=persist)


def load_parquet(spark: SparkSession, path: str, table_name: str, persist: bool = False) -> DataFrame:
    return register(spark.read.parquet(path), table_name, persist=persist)


def load_dataframe(spark: SparkSession, df: DataFrame | pd.DataFrame, table_name: str) -> DataFrame:
    """Register a Spark or pandas DataFrame under ``table_name`` (temp view)."""
    if isinstance(df, pd.DataFrame):
        df = spark.createDataFrame(df)
    df.createOrReplaceTempView(table_name)
    return df


def register(df: DataFrame, table_name: str, persist: bool = False) -> DataFrame:
    if persist:
        df.write.mode("overwrite").format("parquet").saveAsTable(table_name)
        return df.sparkSession.table(table_name)
    df.createOrReplaceTempView(table_name)
    return df


def query(spark: SparkSession, sql: str, args: dict | None = None) -> DataFrame:
    """Run one SQL statement; the result stays a lazy DataFrame."""
    return spark.sql(sql, args=args) if args else spark.sql(sql)


def split_statements(script: str) -> list[str]:
    """Split a SQL script on ``;`` outside quotes and comments; drop empty parts."""
    out, buf = [], []
    i, n = 0, len(script)
    quote = None
    while i < n:
        ch = script[i]
        nxt = script[i + 1] if i + 1 < n else ""
        if quote:
            buf.append(ch)
            if ch == quote:
                if nxt == quote:          # doubled quote inside a literal
                    buf.append(nxt)
                    i += 1
                else:
                    quote = None
        elif ch in ("'", '"', "`"):
            quote = ch
            buf.append(ch)
        elif ch == "-" and nxt == "-":
            j = script.find("\n", i)
            i = n if j < 0 else j
            continue
        elif ch == "/" and nxt == "*":
            j = script.find("*/", i + 2)
            i = n if j < 0 else j + 2
            continue
        elif ch == ";":
            out.append("".join(buf))
            buf = []
        else:
            buf.append(ch)
        i += 1
    out.append("".join(buf))
    return [s.strip() for s in out if s.strip()]


def run_sql_file(spark: SparkSession, path: str) -> list[DataFrame]:
    """Run every statement of a SQL script file in order; return their DataFrames."""
    return run_sql_script(spark, Path(path).read_text())


def run_sql_script(spark: SparkSession, script: str) -> list[DataFrame]:
    """Run every statement of a SQL script in order; return their DataFrames."""
    return [spark.sql(stmt) for stmt in split_statements(script)]


def table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def to_pandas_bounded(df: DataFrame, limit: int) -> pd.DataFrame:
    """Materialise a *bounded* result on the driver; refuses results over ``limit`` rows."""
    head = df.limit(limit + 1).toPandas()
    if len(head) > limit:
        raise ValueError(f"result has more than {limit} rows; keep it as a DataFrame")
    return head


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
