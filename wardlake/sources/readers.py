"""Readers: clinical CSV exports, user uploads, question sets and chunk files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLINICAL_TABLES = ["patients", "encounters", "conditions", "observations", "procedures"]
CHUNK_SCHEMA = (
    "chunk_id string, doc_id string, source string, title string, url string, text string, citation string"
)
QUESTION_SET_SCHEMA = (
    "description string, questions array<struct<id: bigint, question: string, "
    "relevant_doc_ids: array<string>, topic: string>>"
)


def _text_schema(columns: Sequence[str], extra: Sequence[str] = ()) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in [*columns, *extra]])


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file or folder, from its first line only."""
    return spark.read.option("header", True).csv(path).columns


# How fields are quoted, in all CSV files read or written: a quote inside a quoted field is doubled.
# Written instants keep their microseconds.
INSTANTS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
QUOTING = {"header": True, "encoding": "UTF-8", "quote": '"', "escape": '"'}


def read_csv_table(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, multi_line: bool = False
) -> DataFrame:
    """One CSV table, all columns text. Lines with too many fields are dropped, short ones padded with NULL.

    ``multi_line`` allows line ends inside quoted fields; such a file is read by one task.
    """
    return _with_overflow(spark, path, columns, multi_line).where(~F.col("__overflow")).drop("__overflow")


def dropped_lines(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, multi_line: bool = False
) -> DataFrame:
    """How many lines ``read_csv_table`` leaves out."""
    return _with_overflow(spark, path, columns, multi_line).agg(F.count_if("__overflow").alias("dropped"))


def _with_overflow(spark: SparkSession, path: str, columns: Sequence[str] | None, multi_line: bool) -> DataFrame:
    """One column more than the table has: a line that fills it has too many fields."""
    columns = list(columns or csv_header(spark, path))
    raw = (
        spark.read.schema(_text_schema(columns, ["__surplus"]))
        .options(**QUOTING, mode="PERMISSIVE", multiLine=multi_line)
        .csv(path)
    )
    return raw.select(*columns, F.col("__surplus").isNotNull().alias("__overflow"))


def read_tables(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    """All connected tables; any missing file fails here, before work starts."""
    return {name: read_csv_table(spark, path) for name, path in paths.items()}


def read_upload(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A user's file by extension: CSV, JSON (records or lines) or Parquet.

    Uploaded CSV may hold line ends inside quoted fields, for which every file is read by one task; without
    ``multi_line`` large files are split.
    """
    lowered = path.lower().rstrip("/")
    if lowered.endswith(".csv"):
        return spark.read.options(**QUOTING, inferSchema=True, multiLine=multi_line).csv(path)
    if lowered.endswith((".jsonl", ".ndjson")):
        return spark.read.json(path)
    if lowered.endswith(".json"):
        return spark.read.option("multiLine", True).json(path)
    if lowered.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file type: {path}")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**INSTANTS, ignoreNullFields=False).json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk records from JSON lines; blank lines are skipped by the reader."""
    return spark.read.schema(CHUNK_SCHEMA).json(path)


def read_questions(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Nested question sets, one row per question.

    Large sets are one JSON object per line, so files stay splittable; ``multi_line`` reads a single
    pretty-printed object.
    """
    sets = spark.read.schema(QUESTION_SET_SCHEMA).option("multiLine", multi_line).json(path)
    return sets.select(F.explode("questions").alias("q")).select("q.id", "q.question", "q.relevant_doc_ids", "q.topic")


def write_csv(df: DataFrame, path: str) -> None:
    """Metric tables as CSV with a header."""
    df.write.mode("overwrite").options(**QUOTING, **INSTANTS).csv(path)


def text_columns(df: DataFrame) -> list[Column]:
    return [F.col(c).cast("string").alias(c) for c in df.columns]
