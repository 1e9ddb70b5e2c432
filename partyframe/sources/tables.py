"""Parquet test tables and the CSV shapes of the reference's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> dict[str, DataFrame]:
    return {n: read_table(spark, sf_dir, n) for n in names}


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast text columns to the schema's types the way pandas parses numbers: surrounding
    blanks are ignored; text columns keep theirs (`` Private``)."""
    out = []
    for f in schema.fields:
        c = F.col(f.name)
        out.append(c.alias(f.name) if isinstance(f.dataType, T.StringType)
                   else F.trim(c).try_cast(f.dataType).alias(f.name))
    return df.select(*out)


def read_csv_no_header(spark: SparkSession, path: str, schema: T.StructType,
                       sep: str = ",", banner_prefix: str | None = None) -> DataFrame:
    """Headerless CSV with names given by ``schema``.

    Text keeps its leading blank (``ignoreLeadingWhiteSpace`` is off, as in
    pandas); numbers are parsed after trimming (``", 77516"`` is 77516, as
    pandas reads it).  With ``banner_prefix``, a row in a file's first block is
    left out if its first field starts with the prefix and all others are
    missing; data lines that begin with the mark stay.
    """
    text = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])
    reader = (spark.read.schema(text).option("header", False).option("sep", sep)
              .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
              .option("mode", "PERMISSIVE"))
    df = reader.csv(path)
    if banner_prefix:
        first, *others = df.columns
        banner = (F.col("_metadata.file_block_start") == 0) & F.col(first).startswith(banner_prefix)
        for c in others:
            banner = banner & F.col(c).isNull()
        df = df.filter(~F.coalesce(banner, F.lit(False)))
    return _typed(df, schema)


def read_csv_header(spark: SparkSession, path: str, sep: str = ";",
                    schema: T.StructType | None = None) -> DataFrame:
    """S3: CSV with a header line and a custom separator (wine files use ``;``)."""
    reader = spark.read.option("header", True).option("sep", sep).option("inferSchema", False)
    df = reader.csv(path)
    if schema is None:
        return df
    return _typed(df.toDF(*[f.name for f in schema.fields]), schema)


def normalise_names(df: DataFrame) -> DataFrame:
    """Lower-case column names, blanks to underscores."""
    return df.toDF(*[c.lower().replace(" ", "_") for c in df.columns])


def with_source(df: DataFrame, name: str, value) -> DataFrame:
    """Add a literal source column (e.g. ``color`` = 0 / 1)."""
    return df.withColumn(name, F.lit(value))
