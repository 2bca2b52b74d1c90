from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table, or a parquet path if the name holds a slash. Filters and column choice reach the scan."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def read_text_with_header(spark: SparkSession, path: str, header: str, sep: str = ",") -> DataFrame:
    """Delimited text without quoting and without a header row; `header` names the columns, names are trimmed.

    All columns are strings. Empty fields stay empty strings, at the end of a line too; fields a line lacks are null and
    fields beyond the header are dropped.
    """
    names = [n.strip() for n in header.split(",")]
    parts = F.split("value", f"\\Q{sep}\\E", -1)
    return spark.read.text(path).select(*(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)))


def read_csv_ints(spark: SparkSession, path: str, names: list[str], kind: str = "int") -> DataFrame:
    """Integer columns without a header row; what isn't an integer is null."""
    schema = T.StructType([T.StructField(n, T._parse_datatype_string(kind)) for n in names])
    return spark.read.schema(schema).option("mode", "PERMISSIVE").csv(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 32, **options) -> DataFrame:
    """A JDBC table; with a key and its bounds it is read in `parts` ranges. The driver jar is the caller's."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)
