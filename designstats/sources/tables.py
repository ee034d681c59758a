"""Reading survey tables and writing reports."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    labels: Mapping[str, Mapping] | None = None,
    schema: str | None = None,
) -> DataFrame:
    """Load a table (parquet, csv, orc or json) and attach value labels as column metadata."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    df = reader.load(path)
    for name, codes in (labels or {}).items():
        meta = {"labels": {str(k): str(v) for k, v in codes.items()}}
        df = df.withMetadata(name, meta)
    return df


def value_labels(df: DataFrame, name: str) -> dict[str, str]:
    return dict(df.schema[name].metadata.get("labels", {}))


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small in-memory table."""
    return spark.createDataFrame(list(rows), schema)


def write_report(table: DataFrame, path: str) -> None:
    """Write a (small) result table as one UTF-8 CSV with header; cells may hold newlines.

    Report tables have one row per model term or variable, so a single file is intended.
    """
    (
        table.repartition(1)
        .write.mode("overwrite")
        .option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .csv(path)
    )


def save_fit_table(table: DataFrame, path: str) -> None:
    """Keep a tidy coefficient or covariance table for later use."""
    table.write.mode("overwrite").parquet(path)


def load_fit_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def counts_from_wide(wide: DataFrame, key_names: Sequence[str], sep: str = "_") -> DataFrame:
    """One-row population table with columns ``<key1><sep><key2>`` turned into long counts."""
    long = wide.unpivot([], list(wide.columns), "name", "value")
    parts = F.split("name", sep)
    keys = [parts.getItem(i).alias(k) for i, k in enumerate(key_names)]
    return long.select(*keys, F.col("value").cast("double").alias("value"))
