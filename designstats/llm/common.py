"""Reading, storing and numbering, as the operators of this folder share them."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from designstats.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them again: the lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plain_names(docs: DataFrame, kept: tuple[str, ...]):
    """docs with every column but the kept ones under a number, and what to select to have the old names back."""
    names = [c if c in kept else f"column {i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(f"`{n}`").alias(c) for n, c in zip(names, docs.columns)]


def free_name(df: DataFrame, stem: str) -> str:
    """The stem, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def fold(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts))


def parts_of(rows: int, each: int) -> int:
    return max(1, -(-rows // each))


def map_rows(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow over dictionaries of plain Python columns; fn gets and gives one per batch."""

    def run(batches):
        for out in fn(dict(zip(b.schema.names, b.columns)) for b in batches):
            yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def totals_before(df: DataFrame, cell: str, order: list, value: Column, out: str, within: list[str] = ()) -> DataFrame:
    """Adds out: the sum of the value over all earlier rows, by (cell, order), of the same ``within`` group.

    Two levels: a sum for each cell, added up over the cells, and a running sum inside each cell. Rows that
    tie in the order are taken one after the other.
    """
    within = list(within)
    sums = df.groupBy(*within, cell).agg(F.sum(value).alias("_in_cell"))
    by_cell = Window.partitionBy(*within).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*within, cell, F.coalesce(F.sum("_in_cell").over(by_cell), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*within, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(before, [*within, cell])
        .withColumn(out, (F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long"))
        .drop("_before")
    )
