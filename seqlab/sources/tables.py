"""Sources and sinks (S-01..S-09).

Reads are plain ``spark.read`` calls so that Catalyst prunes columns and
pushes filters into the parquet scan; nothing is materialised here.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, root: str, name: str, schema: StructType | None = None) -> DataFrame:
    """S-01 / S-03: one parquet table ``{root}/{name}.parquet`` (file or folder)."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(f"{root.rstrip('/')}/{name}.parquet")


def read_distinct_view(spark: SparkSession, path: str, view: str) -> DataFrame:
    """S-02: parquet folder scan + full-row distinct, registered as a temp view.

    The distinct is one hash aggregate with map-side combine, so duplicates
    are dropped before the shuffle.
    """
    df = spark.read.parquet(path).distinct()
    df.createOrReplaceTempView(view)
    return df


def _structure(schema: StructType | str) -> StructType:
    return schema if isinstance(schema, StructType) else StructType.fromDDL(schema)


def read_csv_table(spark: SparkSession, path: str, schema: StructType | str | None = None, corrupt: str | None = None) -> DataFrame:
    """S-04: CSV with header (a UTF-8 byte-order mark in the header is stripped).

    With a schema nothing is inferred, and the header must have its names in
    order (an error otherwise).  A row that does not fit the schema is an error
    too, unless ``corrupt`` names a column: then its fields that can be read are
    kept, the others are null, and that column holds the whole line (null in good rows).
    """
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    if schema is None:
        df = reader.option("inferSchema", True).csv(path)
        renamed = [c.lstrip("\ufeff") for c in df.columns]
        return df.toDF(*renamed) if renamed != df.columns else df
    schema = _structure(schema)
    header = [c.lstrip("\ufeff") for c in reader.csv(path).columns]
    if header != schema.names:
        raise ValueError(f"the header of {path} is {header}, the schema has {schema.names}")
    if corrupt is None:
        return reader.schema(schema).option("mode", "FAILFAST").csv(path)
    bad = StructType([*schema.fields, StructField(corrupt, StringType())])
    return reader.schema(bad).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt).csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str, corrupt: str | None = None) -> DataFrame:
    """S-05: JSON-lines scan with an explicit schema (no inference pass).

    A line that is no JSON, or does not fit the schema, is an error, unless ``corrupt`` names a column for it (as in S-04).
    """
    schema = _structure(schema)
    if corrupt is None:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    bad = StructType([*schema.fields, StructField(corrupt, StringType())])
    return spark.read.schema(bad).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt).json(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """S-06: parquet sink; nested arrays are kept as they are."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def sample_rows(df: DataFrame, fraction: float = 1 / 3, seed: int = 42) -> DataFrame:
    """S-08: Bernoulli row sample (a sampling operator: the sample is the feature)."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def hash_sample(df: DataFrame, keys: list[str], buckets: int = 3, keep: int = 0) -> DataFrame:
    """S-08, stable variant: keep rows whose key hash falls in one of ``buckets``."""
    return df.filter(F.pmod(F.xxhash64(*keys), F.lit(buckets)) == keep)


def list_tables(spark: SparkSession) -> DataFrame:
    """S-09: registered tables and views as a DataFrame."""
    return spark.sql("SHOW TABLES")
