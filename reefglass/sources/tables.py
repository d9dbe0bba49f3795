"""Table access: one Parquet file or folder per table under a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession


def read_table(spark: SparkSession, data_dir: str, name: str, *columns: str) -> DataFrame:
    """Read ``{data_dir}/{name}.parquet``; with ``columns`` only those reach the scan."""
    df = spark.read.parquet(f"{data_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


MAX_FIXED_ROWS = 100_000


def fixed_rows(df: DataFrame, most: int = MAX_FIXED_ROWS) -> list[Row]:
    """The rows of a table of fixed size; a table that has outgrown ``most`` rows is refused, not gathered."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of fixed size has more than {most} rows")
    return rows


def local_table(spark: SparkSession, rows: list[tuple], **columns: str) -> DataFrame:
    """A small table held in the plan itself (a local relation); columns are name=arrow type alias."""
    import pyarrow as pa

    names = list(columns)
    kinds = [pa.type_for_alias(t) for t in columns.values()]
    arrays = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=names))
