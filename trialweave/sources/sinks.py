"""Exports of a finished table."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files


def numeric(df: DataFrame) -> DataFrame:
    """Only the numeric columns: no booleans, no text."""
    return df.select(*[f.name for f in df.schema if isinstance(f.dataType, T.NumericType)])


def long_layout(df: DataFrame, key: str = "run_dir") -> DataFrame:
    """(run, column, value) for every numeric column: a matrix with its header in one table."""
    names = [c for c in numeric(df).columns if c != key]
    return df.select(F.col(key).alias("run"), *[F.col(c).cast("double").alias(c) for c in names]).unpivot("run", names, "column", "value")


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; ``single`` makes one file, for tables that one machine can hold."""
    keys = [c for c in ("depth", "batch", "sample") if c in df.columns]
    out = df.orderBy(*keys) if keys else df
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_long(df: DataFrame, path: str) -> None:
    long_layout(df).write.mode("overwrite").parquet(path)


def write_hdf5(df: DataFrame, path: str, max_rows: int = 1_000_000, metadata: dict[str, Any] | None = None) -> None:
    """data/aggregated/{values, columns} and metadata in an HDF5 file on the driver, if h5py is installed.

    HDF5 is a single machine's format: tables above ``max_rows`` are refused
    (``write_long`` has no such limit).
    """
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("HDF5 export needs h5py; write_long keeps the same data as Parquet") from e
    rows = numeric(df).limit(max_rows + 1).toPandas()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows; use write_long")
    with h5py.File(path, "a") as file:
        if "data/aggregated" in file:
            del file["data/aggregated"]
        group = file.create_group("data/aggregated")
        group.create_dataset("values", data=rows.to_numpy(float))
        group.create_dataset("columns", data=[c.encode() for c in rows.columns])
        for name, value in (metadata or {}).items():
            file.require_group("metadata").attrs[name] = json.dumps(value)


def write_metadata(df: DataFrame, path: str, metadata: dict[str, Any]) -> None:
    files.write_text(df.sparkSession, path, json.dumps(metadata, indent=1, sort_keys=True))


