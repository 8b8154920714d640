"""What the operators of this subpackage share: reading tables and running a Python function over rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marginalia.plans.session import widen


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat_map(df: DataFrame, fn: Callable[..., Iterable[tuple]], schema: str | T.StructType, chunk: int = 20_000) -> DataFrame:
    """``fn(*row)`` for every row of ``df``; each tuple it yields becomes a row of ``schema``.

    Rows travel in Arrow batches, stay in their partitions unless these are fewer than the cores, and are never gathered.
    """
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def run(batches):
        rows: list[tuple] = []
        for batch in batches:
            for values in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                rows.extend(fn(*values))
                if len(rows) >= chunk:
                    yield _batch(rows, arrow)
                    rows = []
        if rows:
            yield _batch(rows, arrow)

    return widen(df).mapInArrow(run, out)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def sources(df: DataFrame, *extra: str) -> DataFrame:
    """The columns of ``dataset`` that the operators on source files read; rows without an id or text are left out.

    Rows delivered twice stay: their results are the same, so deduplicating the small result is enough.
    """
    return df.select("file_id", *extra, "new_path", "source_code").where(F.col("file_id").isNotNull() & F.col("source_code").isNotNull())
