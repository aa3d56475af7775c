"""Sources: CSV with the usual missing-value tokens, Parquet, and train / validation / test sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a data frame library reads as missing by default.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
ROW_KEY = "_row_key"


@dataclass(frozen=True)
class Dataset:
    """A table to learn from and, optionally, tables to validate and test on."""

    train: DataFrame
    validation: DataFrame | None = None
    test: DataFrame | None = None


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def with_row_key(df: DataFrame, file_order: bool = False) -> DataFrame:
    """df with its row order as a column: for Parquet scans (file_order) the file and the row's place in
    it, else the order of partitions as read."""
    if file_order:
        return df.select("*", F.concat_ws(":", F.col("_metadata.file_path"), F.lpad(F.col("_metadata.row_index").cast("string"), 15, "0")).alias(ROW_KEY))
    return df.withColumn(ROW_KEY, F.monotonically_increasing_id())


def read_csv(spark: SparkSession, path: str | None) -> DataFrame | None:
    """A CSV file with a header; None for no path. Missing-value tokens become null, blank headers are
    named by their place, and each column becomes the first of bigint, double and boolean that all its
    values can be read as, or stays string. Dates stay strings."""
    if not path:
        return None
    raw = spark.read.csv(path, header=True, inferSchema=False)
    names = [f"Unnamed: {k}" if c == f"_c{k}" else c for k, c in enumerate(raw.columns)]
    return infer_types(raw.toDF(*names))


def infer_types(raw: DataFrame) -> DataFrame:
    """String columns typed by one aggregate over all of them."""
    held = raw.select(*(F.when(~F.col(f"`{c}`").isin(*MISSING_TOKENS), F.col(f"`{c}`")).alias(c) for c in raw.columns))
    tests = []
    for k, c in enumerate(held.columns):
        x = F.col(f"`{c}`")
        tests += [
            F.count(x).alias(f"n{k}"),
            F.count(F.when(x.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(x).try_cast("bigint"))).alias(f"i{k}"),
            F.count(x.try_cast("double")).alias(f"d{k}"),
            F.count(F.when(F.lower(x).isin("true", "false"), x)).alias(f"b{k}"),
        ]
    seen = held.agg(*tests).first() if tests else {}
    out = []
    for k, c in enumerate(held.columns):
        x, n = F.col(f"`{c}`"), seen[f"n{k}"]
        if n and seen[f"i{k}"] == n:
            out.append(F.trim(x).try_cast("bigint").alias(c))
        elif seen[f"d{k}"] == n:
            out.append(x.try_cast("double").alias(c))
        elif seen[f"b{k}"] == n:
            out.append(F.lower(x).try_cast("boolean").alias(c))
        else:
            out.append(x.alias(c))
    return held.select(*out)


def read_dataset(spark: SparkSession, train: str, validation: str | None = None, test: str | None = None) -> Dataset:
    """One file (to be split), or a file each for train, optional validation and test."""
    whole = read_csv(spark, train)
    if whole is None:
        raise ValueError("no training file given")
    return Dataset(whole, read_csv(spark, validation), read_csv(spark, test))


def normalized(df: DataFrame) -> DataFrame:
    """NaN as null, decimals as doubles; columns that can't be features raise."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c), c.cast("double"))
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
            raise ValueError(f"column {f.name!r} is of type {f.dataType.simpleString()}, which can be neither target nor feature")
        out.append(c.alias(f.name))
    return df.select(*out)


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_number(f.dataType)]


def default_target(df: DataFrame) -> str | None:
    """The last numeric column."""
    return (numeric_columns(df) or [None])[-1]


def preview(df: DataFrame, order: list[str], rows: int = 10) -> DataFrame:
    return df.orderBy(*order).limit(rows)


def shapes(data: Dataset) -> DataFrame:
    """split, n_rows, n_cols of each table of a dataset."""
    parts = [("train", data.train), ("validation", data.validation), ("test", data.test)]
    frames = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("split"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_cols")) for name, df in parts if df is not None]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
