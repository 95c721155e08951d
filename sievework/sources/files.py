"""Readers and writers for CSV, JSON and Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievework.functions.exprs import nan_to_null
from sievework.operators.convert import coerce_by_name
from sievework.operators.schema import unique_names
from sievework.session import union_rows

# Separators in the order in which they are tried.
SEPARATORS = (",", ";", "\t", "|")


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: StructType | str | None = None,
    sep: str = ",",
    encoding: str = "UTF-8",
    multiline: bool = False,
) -> DataFrame:
    """CSV with a header line; quotes inside quoted values are doubled.

    Give a schema for large inputs: inference reads them twice.  ``multiline`` lets quoted values
    hold line breaks; a file is then read by one task.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
    reader = reader.option("escape", '"').option("multiLine", multiline)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return nan_to_null(reader.csv(path if isinstance(path, str) else list(path)))


def csv_dialect(spark: SparkSession, path: str) -> tuple[str, str]:
    """(separator, encoding): the first separator that splits the header line; UTF-8 unless
    some line holds bytes that are no UTF-8."""
    lines = spark.read.text(path)
    broken = lines.where(~F.is_valid_utf8("value")).limit(1).count() > 0
    first = lines.first()
    header = first["value"] if first else ""
    sep = next((s for s in SEPARATORS if s in header), ",")
    return sep, "ISO-8859-1" if broken else "UTF-8"


def has_quoted_breaks(spark: SparkSession, path: str) -> bool:
    """Whether some line ends inside quotes: it holds an odd number of them."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_csv_any(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Separator, encoding and line breaks inside quotes are found out from the file."""
    sep, encoding = csv_dialect(spark, path)
    return read_csv(spark, path, schema, sep, encoding, has_quoted_breaks(spark, path))


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """JSON lines (splittable) or one array per file, told apart by the first character."""
    first = spark.read.text(path).where(F.trim("value") != "").first()
    is_array = first is not None and first["value"].lstrip().startswith("[")
    reader = spark.read.option("multiLine", is_array)
    return nan_to_null((reader.schema(schema) if schema is not None else reader).json(path))


def read_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return nan_to_null(spark.read.parquet(*([path] if isinstance(path, str) else path)))


def load(spark: SparkSession, path: str, kind: str, schema: StructType | str | None = None) -> DataFrame:
    """Read by kind and make columns with number-like names numeric."""
    if kind == "csv":
        df = read_csv_any(spark, path, schema)
    elif kind == "json":
        df = read_json(spark, path, schema)
    elif kind == "parquet":
        df = read_parquet(spark, path)
    else:
        raise ValueError(f"unsupported kind: {kind}")
    return coerce_by_name(df.toDF(*unique_names(df.columns)))


def union_batches(batches: Sequence[DataFrame]) -> DataFrame:
    """Row-wise union by column name."""
    return union_rows(batches)


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    """Quotes inside values are doubled, as other readers expect."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("compression", compression).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line; NULL fields are written."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_compressed(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Gzip Parquet keeps the types; gzip CSV is the plain-text alternative."""
    if kind == "parquet":
        df.write.mode("overwrite").option("compression", "gzip").parquet(path)
    else:
        write_csv(df, path, "gzip")
