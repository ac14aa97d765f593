"""Comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@dataclass
class Comparison:
    same: bool
    rows: int
    only_spark: list[str]
    only_duck: list[str]
    type_differences: list[str]


def oracle_connection(folder: str):
    import duckdb

    duck = duckdb.connect()
    for name in TABLES:
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return duck


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return value


def _rows(table: pa.Table) -> list[str]:
    columns = [table.column(n).to_pylist() for n in sorted(table.column_names)]
    return sorted(repr([_plain(v) for v in row]) for row in zip(*columns, strict=True))


def _kind(arrow_type: pa.DataType) -> str:
    return str(arrow_type).replace("large_", "").split("[")[0]


def compare(spark_result: pa.Table, duck_result: pa.Table) -> Comparison:
    """Same columns and the same bag of rows; types are reported apart."""
    if sorted(spark_result.column_names) != sorted(duck_result.column_names):
        return Comparison(False, spark_result.num_rows, spark_result.column_names, duck_result.column_names, [])
    left, right = _rows(spark_result), _rows(duck_result)
    in_left, in_right = set(left), set(right)
    types = [
        f"{n}: {_kind(spark_result.schema.field(n).type)} / {_kind(duck_result.schema.field(n).type)}"
        for n in spark_result.column_names
        if _kind(spark_result.schema.field(n).type) != _kind(duck_result.schema.field(n).type)
    ]
    return Comparison(
        left == right, len(left), [r for r in left if r not in in_right], [r for r in right if r not in in_left], types
    )
