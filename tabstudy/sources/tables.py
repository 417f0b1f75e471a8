"""Reading delimited text and parquet, orientation, previews, and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File extension to format; anything else is read as csv.
FORMATS = {"csv": "csv", "tsv": "tsv", "txt": "tsv", "parquet": "parquet"}
REPLACEMENT_CHARACTER = "�"


def detect_format(name: str) -> str:
    tail = name.rstrip("/").rsplit("/", 1)[-1]
    return FORMATS.get(tail.rsplit(".", 1)[-1].lower(), "csv") if "." in tail else "csv"


def unique_names(names: list[str]) -> list[str]:
    """String names with ``_1``, ``_2`` ... appended to repeats."""
    seen: dict[str, int] = {}
    out = []
    for name in (str(n) for n in names):
        if name in seen:
            seen[name] += 1
            out.append(f"{name}_{seen[name]}")
        else:
            seen[name] = 0
            out.append(name)
    return out


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def _delimited(spark: SparkSession, path: str, sep: str, encoding: str | None, schema) -> DataFrame:
    def read(enc: str) -> DataFrame:
        reader = spark.read.options(header=True, sep=sep, encoding=enc)
        return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)

    if encoding:
        return read(encoding)
    df = read("UTF-8")
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    damaged = F.lit(False)
    for c in texts:
        damaged = damaged | F.coalesce(F.col(f"`{c}`").contains(REPLACEMENT_CHARACTER), F.lit(False))
    bad_header = any(REPLACEMENT_CHARACTER in c for c in df.columns)
    if bad_header or (texts and df.where(damaged).limit(1).count()):
        return read("ISO-8859-1")
    return df


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, schema=None) -> DataFrame:
    """CSV in UTF-8, or Latin-1 when UTF-8 cannot decode it.  Pass a schema to skip inference."""
    return _delimited(spark, path, ",", encoding, schema)


def read_tsv(spark: SparkSession, path: str, encoding: str | None = None, schema=None) -> DataFrame:
    return _delimited(spark, path, "\t", encoding, schema)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_table(spark: SparkSession, path: str, fmt: str | None = None, transposed: bool = False,
               encoding: str | None = None, schema=None, index_column: str | None = None) -> DataFrame:
    """One entry for every format: unique string names, NaN read as null, optional transpose."""
    kind = fmt or detect_format(path)
    if kind == "parquet":
        df = read_parquet(spark, path)
    elif kind == "tsv":
        df = read_tsv(spark, path, encoding, schema)
    else:
        df = read_csv(spark, path, encoding, schema)
    names = unique_names(df.columns)
    df = nan_to_null(df.toDF(*names) if names != df.columns else df)
    return transpose(df, index_column) if transposed else df


def preview(df: DataFrame, n: int, order_by: str) -> DataFrame:
    return df.orderBy(order_by).limit(n)


def transpose(df: DataFrame, header_column: str | None = None) -> DataFrame:
    """Rows become columns; values of ``header_column`` (default: the first) name the new columns.

    A result column per input row only makes sense for short tables; Spark bounds it by
    ``spark.sql.transposeMaxValues``.
    """
    header = header_column or df.columns[0]
    texts = df.select(F.col(header).cast("string").alias(header),
                      *[F.col(c).cast("string").alias(c) for c in df.columns if c != header])
    flipped = texts.transpose(header)
    return flipped.toDF(*unique_names(["field", *flipped.columns[1:]]))


def orientation(df: DataFrame) -> DataFrame:
    """(n_rows, n_columns, probably_transposed)."""
    wide = len(df.columns)
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(wide).alias("n_columns"),
        ((F.lit(wide) > 2 * F.col("n_rows")) & F.lit(wide > 10)).alias("probably_transposed"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
