"""File sources and sinks: vector CSV, whole-text files and tables that are replaced as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .versions import current_version, publish, read_current


# A missing text and an empty one are kept apart, and outer spaces are data.
_FAITHFUL = {"header": True, "escape": '"', "nullValue": "\0",
             "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_vector_csv(df: DataFrame, path: str, vector_col: str = "embedding") -> None:
    """A CSV without an index; the vector is written as a JSON list literal.

    Texts come back as they were: with their outer spaces, and empty or NULL (a
    NUL character in the file). A text of one NUL character would come back as NULL.
    """
    (df.withColumn(vector_col, F.to_json(F.col(vector_col).cast("array<double>")))
       .write.mode("overwrite").options(**_FAITHFUL, emptyValue='""').csv(path))


def read_vector_csv(spark: SparkSession, path: str, schema: T.StructType,
                    vector_col: str = "embedding") -> DataFrame:
    """S3 + F4: read (fields, vector-as-string) back; a malformed vector becomes NULL."""
    string_schema = T.StructType([
        T.StructField(f.name, T.StringType() if f.name == vector_col else f.dataType, True)
        for f in schema.fields])
    df = spark.read.schema(string_schema).options(**_FAITHFUL, emptyValue="", multiLine=True).csv(path)
    return df.withColumn(vector_col, parse_vector(F.col(vector_col)))


def read_vector_csv_checked(spark: SparkSession, path: str, schema: T.StructType,
                            vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """S3 + F4 with malformed vectors kept apart: (rows, spoilt rows with the vector's text in ``spoilt_text``).

    An absent vector (no text) is no fault. A vector whose text is no list of numbers is one.
    """
    string_schema = T.StructType([
        T.StructField(f.name, T.StringType() if f.name == vector_col else f.dataType, True) for f in schema.fields])
    read = (spark.read.schema(string_schema).options(**_FAITHFUL, emptyValue="", multiLine=True).csv(path)
            .withColumnRenamed(vector_col, "spoilt_text")
            .withColumn(vector_col, parse_vector(F.col("spoilt_text"))))
    elements = F.coalesce(F.exists(vector_col, lambda x: x.isNull()), F.lit(True))  # NULL: no list at all
    rows, spoilt = _divided(read, F.col("spoilt_text").isNotNull() & elements)
    return rows.select(*schema.names), spoilt.select(*[c for c in schema.names if c != vector_col], "spoilt_text")


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType, header: bool = True,
                     multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """S1 for CSV sheets with spoilt lines kept apart: (rows, spoilt lines as ``spoilt_line`` and ``source_file``).

    A line is spoilt if it has too few or too many cells, or a cell that is not of its column's type; it is kept as it
    stands, and no part of it becomes a row. Empty lines are neither. The files are parsed once: both results are read
    from what was written then, each from its own folder. ``multi_line`` permits line ends inside quotes; without it a
    quote that is never closed spoils its own line only, and a large file is read by many tasks.
    """
    noted = T.StructType([*schema.fields, T.StructField("spoilt_line", T.StringType(), True)])
    read = (spark.read.schema(noted).options(header=header, multiLine=multi_line, escape='"', mode="PERMISSIVE",
                                             columnNameOfCorruptRecord="spoilt_line").csv(path)
            .withColumn("source_file", F.col("_metadata.file_path")))
    rows, spoilt = _divided(read, F.col("spoilt_line").isNotNull())
    return rows.select(*schema.names), spoilt.select("spoilt_line", "source_file")


def _divided(df: DataFrame, spoilt: Column) -> tuple[DataFrame, DataFrame]:
    """``df`` written once in two folders: rows where ``spoilt`` is false, and where it is true."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "checked")
    df.withColumn("_spoilt", spoilt.cast("int")).write.partitionBy("_spoilt").parquet(path)
    schema = T.StructType([*df.schema.fields, T.StructField("_spoilt", T.IntegerType(), True)])
    written = spark.read.schema(schema).parquet(path)
    return tuple(written.filter(F.col("_spoilt") == side).drop("_spoilt") for side in (0, 1))


def parse_vector(c: Column) -> Column:
    """a JSON/Python list literal of numbers to ``array<double>``; NULL when malformed."""
    return F.from_json(c, "array<double>")


def read_wholetext(spark: SparkSession, path: str) -> DataFrame:
    """Each file as one string, with its path."""
    return (spark.read.text(path, wholetext=True)
            .select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text")))


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace one named table with ``df`` in one step (see ``versions``); read it with ``read_current``."""
    publish(df, path, partition_by)


def table_exists(spark: SparkSession, path: str) -> bool:
    """True once a version of the table at ``path`` has been written to its end."""
    return current_version(spark, path) is not None


def build_once(spark: SparkSession, path: str, build) -> DataFrame:
    """Read the persisted table if it exists, else build it, write it and read it.

    Like the analysed application, an existing table is reused as-is (not re-filtered); a build that failed has left
    none. Reading back the written table also cuts the lineage.
    """
    if not table_exists(spark, path):
        replace_table(build(), path)
    return read_current(spark, path)


def write_results(tables: dict[str, DataFrame], base_path: str) -> dict[str, str]:
    """Persist a set of named result tables, each replacing its own; returns the tables' folders."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{base_path.rstrip('/')}/{name}"
        replace_table(df, paths[name])
    return paths
