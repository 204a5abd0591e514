"""Reading and writing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.session import cut


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header, or Parquet (S1, S2). A schema spares the pass that infers one."""
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt == "csv":
        options = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "inferSchema": schema is None}
        return reader.options(**options).csv(path)
    return reader.format(fmt).load(path)


def read_many(spark: SparkSession, folder: str, pattern: str, fmt: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    """All files of a folder whose names fit, with the name kept as ``file_name`` (S4). A table that is a folder of files
    itself counts as one file: its rows have its name."""
    reader = spark.read.option("header", True).format(fmt)
    rows = (reader.schema(schema) if schema else reader).load(f"{folder.rstrip('/')}/{pattern}")
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    above = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).depth()
    steps = F.split(F.regexp_replace("_metadata.file_path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "/")  # the first is empty
    own = F.url_decode(F.replace(F.get(steps, F.lit(above + 1)), F.lit("+"), F.lit("%2B")))
    return rows.withColumn("file_name", F.when(F.size(steps) == above + 2, F.col("_metadata.file_name")).otherwise(own))


def read_json_docs(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """One row per JSON document, and the names of files that are none (S5). Bad files stop nothing.

    The rows are written as a table, which both results read."""
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    reader = spark.read.schema(wide).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    rows = reader.option("pathGlobFilter", pattern).json(folder).withColumn("file_name", F.col("_metadata.file_name"))
    rows = cut(rows)
    return rows.where("_bad is null").drop("_bad"), rows.where("_bad is not null").select("file_name", "_bad")


def read_registry(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The rows of an append-only log, one JSON object a line."""
    return spark.read.schema(schema).json(path)


def lookup_vectors(df: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Each row with its vector, or null (S7): a join, of which Spark broadcasts a small side."""
    return df.join(store.select(key, "vector"), key, "left")


def read_records(spark: SparkSession, path: str, separator: str = "$$$$\n") -> DataFrame:
    """``position, record, file_name`` of delimited text files, positions from 0 without gaps (S8): files by folder, then by name, then by place.

    Spark cuts a file into blocks and packs these in an order of its own, so a record's place is named by what it carries itself:
    its file, where its block starts, and its number within the block. Blocks are counted, and a running sum over a row per
    block gives what lies before each. A null or blank record uses up its position and is left out.
    """
    block = [F.col(f"_metadata.{c}") for c in ("file_path", "file_block_start")]
    rows = spark.read.option("lineSep", separator).text(path).select(F.col("value").alias("record"), F.col("_metadata.file_name").alias("file_name"), block[0].alias("file"), block[1].alias("start"), F.monotonically_increasing_id().alias("id"))
    rows = cut(rows)
    blocks = rows.groupBy("file", "start").agg(F.min("file_name").alias("name"), F.count("*").alias("n"), F.min("id").alias("first"))
    folder = F.regexp_replace("file", "[^/]*$", "")  # before the name, which may be drawn by whoever wrote the file
    before = Window.orderBy(folder, "name", "file", "start").rowsBetween(Window.unboundedPreceding, -1)  # a row per block of a file
    offsets = blocks.select("file", "start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # A block is read by one task from its start on, so its ids follow one another.
    numbered = rows.join(offsets, ["file", "start"]).withColumn("position", F.col("offset") + F.col("id") - F.col("first"))
    return numbered.where(F.col("record").rlike(r"\S")).select("position", "record", "file_name")


def label_by_position(df: DataFrame, cut: int, position: str = "position") -> DataFrame:
    """Label 1 before ``cut``, else 0. Records dropped later have used up their position."""
    return df.withColumn("label", F.when(F.col(position) < cut, 1).otherwise(0))


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table from values in the program."""
    return spark.createDataFrame(list(rows), schema)


def pick_partition(df: DataFrame, column: str, prefer: str) -> DataFrame:
    """The rows of the preferred partition if there is one, else of the first in order."""
    rank = F.struct((F.col(column) != prefer).alias("other"), F.col(column).alias("name"))
    best = df.where(F.col(column).isNotNull()).agg(F.min(rank)["name"].alias("__best"))
    return df.join(F.broadcast(best), F.col(column) == F.col("__best")).drop("__best")  # one row


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """CSV with a header, or Parquet (K1, K2)."""
    df.write.mode(mode).options(**({"header": True, "escape": '"'} if fmt == "csv" else {})).format(fmt).save(path)


def write_split(df: DataFrame, path: str, by: Sequence[str] = ("split",), mode: str = "error") -> None:
    """One folder per split, so that a reader of one split prunes the others (K2)."""
    df.write.mode(mode).partitionBy(*by).parquet(path)


def write_if_any(df: DataFrame, path: str, fmt: str = "parquet") -> bool:
    """Write only a table that has rows; whether it had (K3)."""
    if df.isEmpty():
        return False
    write_table(df, path, fmt)
    return True


def replace_table(df: DataFrame, path: str) -> None:
    """Overwrite the table that ``df`` may read from: write beside it, then swap the folders (K4)."""
    spark = df.sparkSession
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    new, old = (spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + end) for end in (".new", ".old"))
    fs.delete(new, True), fs.delete(old, True)
    df.write.parquet(new.toString())
    if fs.exists(to):
        fs.rename(to, old)
    fs.rename(new, to)
    fs.delete(old, True)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Each row as one JSON document (K5)."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)


def append_registry(df: DataFrame, path: str) -> None:
    """Add rows to a log of JSON lines (K6)."""
    df.write.mode("append").json(path)


def render_lines(df: DataFrame, fmt: str, *columns: Column) -> DataFrame:
    """A line of text per row, ``line`` (K7)."""
    return df.select(F.format_string(fmt, *columns).alias("line"))


def write_nested(df: DataFrame, path: str) -> None:
    """Nested arrays and structs as Parquet (K8)."""
    df.write.parquet(path)
